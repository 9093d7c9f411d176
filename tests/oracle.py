"""Runs a query and its SQL over the same Parquet tables and compares rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(where: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{where}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    names = sorted(df.columns)
    got = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = [tuple(_cell(r[i]) for i in at) for r in res.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-4 * max(1, abs(x))) for x, y in zip(a, b)):
            return f"{dict(zip(names, a))} and {dict(zip(names, b))}"
    return ""

"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distance verified.

Fingerprints are cut into m blocks; two that differ in at most r bits agree in at least m - r whole blocks, so every
choice of m - r blocks is a join key and no close pair is missed. Copies share a fingerprint and are one node: the join
works on distinct fingerprints. Inside a join key only links that join two groups are passed on (a spanning forest), so
dense groups of near copies never become all pairs, while no connection between different fingerprints is lost.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; texts under the shingle
width have one shingle, the whole sequence; repeated rows are copies; null ids have no id of their own
(the component is the smallest id that isn't null, null if there is none) but link what they stand between;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import connected_components, numbered, of_row, shuffle_partitions, written

#: Shingles whose bits are summed at once; bounds the scratch memory of very long texts.
STEP = 1 << 16


def fingerprint(words: list[bytes], width: int = 4, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all shingles."""
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = start + size
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], seed) for a, b in zip(start[: n - k + 1].tolist(), end[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), STEP):
        part = h[i : i + STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint((x.as_py() or "").encode("utf-8", "replace").lower().split(), width, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` bigint, fp bigint")


def n_blocks(n: int, radius: int, bits: int = 64) -> int:
    """Fewest blocks whose keys are long enough that n random fingerprints share few: 2^key bits >= n / 4."""
    for m in range(radius + 1, 13):
        if bits * (m - radius) // m >= np.log2(max(n, 2)) - 2:
            return m
    return 12


def block_keys(fp: Column, blocks: int, radius: int, bits: int = 64) -> Column:
    """Array of hashes, one for each choice of blocks - radius blocks; equal where the blocks chosen are equal."""
    cut = [bits * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cut, cut[1:])]
    return F.array(*[F.xxhash64(F.lit(i), *[part[j] for j in chosen]) for i, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def spanning_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest over all pairs of one key within the radius.

    Rows are compared with the one s places further on for s = 1, 2, ... while keys are equal; a link is kept if it joins
    two groups so far. Memory is that of the rows, whatever the size of a key.
    """
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    group = np.arange(len(key))
    out_a, out_b = [], []
    live = np.arange(len(key))
    s = 1
    while True:
        live = live[live + s < len(key)]
        live = live[key[live] == key[live + s]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + s]) <= radius]
        a, b = group[near], group[near + s]
        near, a, b = near[a != b], a[a != b], b[a != b]
        if len(near):
            out_a.append(near)
            out_b.append(near + s)
        while len(a):  # hook the larger label under the smaller, then shorten all paths
            np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
            while not (group == (up := group[group])).all():
                group = up
            a, b = group[a], group[b]
            a, b = a[a != b], b[a != b]
        s += 1
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(out_a)], order[np.concatenate(out_b)]


def links(reps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the ids of distinct fingerprints (id, fp) that hold all of their connections."""
    spark = reps.sparkSession
    blocks = blocks or n_blocks(reps.count(), radius)
    keyed = reps.select("id", "fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        ids, fp, key = (rows[c].to_numpy() for c in ("id", "fp", "key"))
        a, b = spanning_links(key, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return keyed.repartition(shuffle_partitions(spark), "key").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) for each row."""
    fp = written(fingerprints(docs, id_col, text, width, seed), "fingerprints")
    reps = written(fp.groupBy("fp").agg(F.min(id_col).alias("low")), "representatives")
    groups = written(connected_components(links(reps.select(F.col("fp").alias("id"), "fp"), radius)), "fingerprint-components")  # nodes are fingerprints
    groups = groups.withColumnRenamed("node", "fp")
    low = groups.join(reps, "fp").groupBy("component").agg(F.min("low").alias("lowest"))
    of_fp = reps.join(groups, "fp", "left").join(low, "component", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    return fp.join(of_fp, "fp", "left").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of each component, that of the smallest id (null ids last); all columns stay."""
    names = docs.columns
    docs = numbered(docs, "simhash-rows")
    groups = simhash_components(docs.select("row", of_row(text).alias("text")), "row", "text", radius).select("row", "component_id")
    order = F.struct(F.col("id").isNull(), "id", "row")
    heads = docs.select("row", of_row(id_col).alias("id")).join(groups, "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return docs.join(heads, "row", "left_semi").select(*[of_row(c).alias(c) for c in names])

"""Scores of many maps at once against the single-map operators, shifts against loops, planted grids."""

import hashlib
from math import cos, pi, sin

import numpy as np
import pytest

from tracklane.operators import map_scores as MS
from tracklane.operators import maps as M


def planted(w, h, scale, angle, centre):
    y, x = np.mgrid[:h, :w]
    k = 4 * pi / 3**0.5 / scale
    return sum(np.cos(k * ((x - centre[0]) * cos(angle + i * pi / 3) + (y - centre[1]) * sin(angle + i * pi / 3))) for i in range(3)) + 1.5


@pytest.fixture(scope="module")
def some_maps():
    rng = np.random.default_rng(0)
    maps = rng.gamma(0.6, 1, (10, 9, 8))
    maps = np.concatenate([maps, [planted(8, 9, s, a, (3, 4)) for s, a in ((3, 0), (4, 0.3), (5, 0.6))]])
    maps[0, :, 5] = maps[3, 2, :4] = np.nan
    maps[10:] += rng.random((3, 9, 8)) * 0.1
    wall = np.full((9, 8), 0.01)
    wall[:, :2] = 1
    return np.concatenate([maps, [wall, np.zeros((9, 8))]])


def bins_of(spark, maps):
    return spark.createDataFrame([(i, x, y, float(v)) for i, m in enumerate(maps) for y, line in enumerate(m) for x, v in enumerate(line) if v == v], "u long, xb long, yb long, v double")


def test_dense_scores_equal_those_of_single_maps(spark, some_maps):
    bins = bins_of(spark, some_maps)
    dense = MS.scored_maps(MS.dense_maps(bins, ["u"], "v", (0, 7), (0, 8)), ["u"], (0, 7), (0, 8), 0.4, 3, 2).collect()
    assert len(dense) == len(some_maps)
    fields = MS.labelled_fields(bins, ["u"], "v", 0.4, 3)
    border = {r.u: r.score for r in MS.wall_border_score(bins, fields, ["u"], "v", (0, 7), (0, 8), 2).collect()}
    grid = {r.u: r.score for r in M.grid_score(MS.sharpened(bins, ["u"], "v"), ["u"], "v", tie=1e-9).collect()}
    for r in dense:
        assert (r.border is None) == (border.get(r.u) is None) and (r.border is None or r.border == pytest.approx(border[r.u], abs=1e-9))
        assert (r.grid is None) == (grid.get(r.u) is None) and (r.grid is None or r.grid == pytest.approx(grid[r.u], abs=1e-6))
    assert sum(r.grid is not None for r in dense) > 5 and border[13] > 0.7  # the wall


def test_labelled_fields_by_flood_fill(spark, some_maps):
    maps = some_maps[:13]
    got = {}
    for r in MS.labelled_fields(bins_of(spark, maps), ["u"], "v", 0.5, 4).collect():
        got.setdefault((r.u, r.field), set()).add((r.xb, r.yb))
    want = {}
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for u, m in enumerate(maps):
        cells = {(x, y) for y in range(9) for x in range(8) if m[y, x] == m[y, x]}
        over = {(x, y) for x, y in cells if m[y, x] >= 0.5 * np.nanmax(m)}
        wide = {(x + i, y + j) for x, y in over for i, j in around}
        closed = {c for c in wide if all((c[0] + i, c[1] + j) in wide for i, j in around)} & cells
        left = {(x + i, y + j) for x, y in closed for i, j in around} & cells
        while left:
            field, todo = set(), [left.pop()]
            while todo:
                x, y = todo.pop()
                field.add((x, y))
                new = {(x + i, y + j) for i, j in around} & left
                left -= new
                todo += new
            if len(field) >= 4:
                want[u, min(x * 1_000_000 + y for x, y in field)] = field
    assert got == want


def test_shifted_maps_equal_rolled_series(spark):
    rng = np.random.default_rng(6)
    n = 60
    v, x, y = rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n), rng.integers(0, 2, n)
    df = spark.createDataFrame([(3, i, float(v[i]), int(x[i]), int(y[i])) for i in range(n)], "u long, t long, v double, xb long, yb long")
    for block in (None, 7):
        got = {(r.rep, getattr(r, "part", 0), r.xb, r.yb): r.m for r in MS.shifted_maps(df, ["u"], ["t"], "v", 5, 9, 2, block).collect()}
        want = {}
        for rep in range(6):
            by = int(hashlib.md5(f"9|3|{rep}".encode()).hexdigest()[:8], 16) % n if rep else 0
            moved = np.roll(v, by)
            for part in range(2 if block else 1):
                for c in {*zip(x.tolist(), y.tolist())}:
                    at = [i for i in range(n) if (x[i], y[i]) == c and (not block or i // block % 2 == part)]
                    if len(at) >= 2:
                        want[rep, part, *c] = moved[at].mean()
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_significance_of_a_place_cell(spark):
    rows = [(u, i, float(10 * (i % 30 < 3) if u else (i * 7919) % 11), i % 30 // 6, i % 6 // 3) for u in range(2) for i in range(600)]
    df = spark.createDataFrame(rows, "u long, t long, v double, xb long, yb long")
    maps = MS.shifted_maps(df, ["u"], ["t"], "v", 60, 1, 2)
    from pyspark.sql import functions as F

    peak = maps.groupBy("u", "rep").agg(F.max(F.when((F.col("xb") == 0) & (F.col("yb") == 0), F.col("m"))).alias("s"))
    got = {r.u: (r.real, r.p) for r in MS.significance(peak, ["u"], "s").collect()}
    assert got[1][0] == 10.0 and got[1][1] < 0.2 and 0.02 < got[0][1] < 0.98


def test_grid_fit_finds_the_planted_pattern(spark):
    made = [(3.3, 0.2), (4.6, 0.7), (2.6, 0.45)]
    maps = [planted(11, 11, s, a, (5, 5)) for s, a in made] + [np.full((11, 11), 2.0)]
    got = {r.u: r for r in MS.grid_fit(bins_of(spark, maps), ["u"], "v", (2.0, 0.5, 8), 6).collect()}
    assert set(got) == {0, 1, 2}  # a flat map has no peak
    for u, (s, a) in enumerate(made):
        turn = (got[u].angle - a) % (pi / 3)
        assert got[u].scale == pytest.approx(s, abs=0.05) and min(turn, pi / 3 - turn) < 0.03 and got[u].r > 0.99

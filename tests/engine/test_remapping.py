"""Kendall on replicates, combined p-values, draw sizes, sub-segments and cluster counts against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import models as P
from tracklane.operators import resample as B


def test_kendall_of_pairs_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(6)), float(rng.randrange(5))) for g in range(6) for _ in range(rng.randrange(1, 25))] + [(7, 1.0, 1.0), (8, 1.0, 2.0), (8, 1.0, 3.0), (9, None, 1.0)]
    got = {r.g: (r.n, r.tau) for r in A.kendall_of_pairs(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g in {r[0] for r in rows} - {9}:
        v = [r[1:] for r in rows if r[0] == g]
        s = p = q = 0
        for i, a in enumerate(v):
            for b in v[:i]:
                s, p, q = s + sign(a[0] - b[0]) * sign(a[1] - b[1]), p + abs(sign(a[0] - b[0])), q + abs(sign(a[1] - b[1]))
        assert got[g] == (len(v), pytest.approx(s / math.sqrt(p * q)) if p and q else None)
    assert 9 not in got


def test_combined_p_has_the_tail_of_chi_squared(spark):
    ps = {1: [0.3], 2: [0.5, 0.01, 0.2], 3: [1.0, 1.0], 4: [0.0, 0.5], 5: [0.02] * 40}
    rows = [(g, p) for g, v in ps.items() for p in v] + [(2, None)]
    got = {r.g: (r.n, r.p) for r in A.combined_p(spark.createDataFrame(rows, "g int, p double"), ["g"], "p", 50).collect()}
    for g, v in ps.items():
        h = sum(-math.log(max(p, 1e-300)) for p in v)
        want = sum(math.exp(k * math.log(max(h, 1e-300)) - h - math.lgamma(k + 1)) for k in range(len(v)))
        assert got[g] == (len(v), pytest.approx(min(1, want), rel=1e-9, abs=1e-12))
    assert got[1][1] == pytest.approx(0.3)


def test_draws_of_every_size(spark):
    rows = [("c", "F", i) for i in range(10)] + [("c", "O", 100 + i) for i in range(5)] + [("d", "F", i) for i in range(3)]
    t = spark.createDataFrame(rows, "cond string, st string, tr int")
    for size, want in (("min", (5, 3)), ("max", (10, 3)), ("mean", (7, 3)), (4, (4, 4))):
        draws = B.balanced_draws(t, ["cond"], ["st"], "tr", 3, 1, size)
        got = {(r.cond, r.st, r.rep): r["count"] for r in draws.groupBy("cond", "st", "rep").count().collect()}
        assert got == {(c, s, k): want[c == "d"] for c, s in (("c", "F"), ("c", "O"), ("d", "F")) for k in range(3)}
        assert draws.filter("(st = 'O') <> (tr >= 100)").count() == 0


def test_sparse_tails_join_the_last_full_piece(spark):
    counts = {"a": [5, 9, 4, 0, 2, 1], "b": [2, 1], "c": [0, 6, 6]}
    rows = [(z, b * 10 + 0.5) for z, v in counts.items() for b, n in enumerate(v) for _ in range(n)]
    got = {(r.z, r["sub"]): (r.lo, r.hi, r.n) for r in M.sub_segments(spark.createDataFrame(rows, "z string, x double"), ["z"], F.col("x"), 10.0, 4).collect()}
    assert got == {("a", 0): (0, 10, 5), ("a", 1): (10, 20, 9), ("a", 2): (20, 60, 7), ("b", 0): (0, 20, 3), ("c", 1): (10, 20, 6), ("c", 2): (20, 30, 6)}


def test_three_planted_clusters_are_best(spark):
    rng = np.random.default_rng(1)
    centre = [(0, 5), (6, 0), (-6, 0)]
    pts = [(i, [float(v) for v in rng.normal(centre[i % 3], 0.3)]) for i in range(150)]
    t = P.repeated_clusterings(spark.createDataFrame(pts, "id long, v array<double>"), "id", "v", 2, 2, 2, [2, 3]).collect()
    assert len(t) == 2 * 2 * 2 * 2 * 2 and {r.split for r in t} == {"train", "test"}
    for m in ("kmeans", "bisecting"):
        best = min(r.mse for r in t if r.method == m and r.k == 3 and r.split == "test")
        assert best < 0.4 < 3 < min(r.mse for r in t if r.method == m and r.k == 2 and r.split == "test")
    assert {(r.repeat, r.fold): r.n for r in t if r.method == "kmeans" and r.k == 3 and r.split == "test"} == {(r.repeat, r.fold): r.n for r in t if r.method == "bisecting" and r.k == 3 and r.split == "test"}

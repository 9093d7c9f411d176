"""Replicates inside a unit's task: hashes against hashlib, statistics against loops, and plans that shuffle no draws."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane import catalog
from tracklane.functions import digest as D
from tracklane.operators import map_scores as MS
from tracklane.operators import maps as M
from tracklane.operators import replicates as V
from tracklane.operators import resample as B

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("wide", [False, True])
def test_hashes_equal_hashlib(wide):
    for head, first, second in (("7|12", range(12), range(130)), ("x" * 60, range(3), range(4)), ("5|4-NOT SPECIFIED|F", range(2), np.array([-5, 0, 123456789012])), ("13|0", range(120), None)):
        got = D.md5_grid(head, first, second, wide)
        for i, a in enumerate(first):
            for j, b in enumerate([None] if second is None else second):
                key = f"{head}|{a}" + ("" if b is None else f"|{b}")
                assert int(got[i, j]) == int(hashlib.md5(key.encode()).hexdigest()[: 16 if wide else 8], 16)


def test_taus_equal_all_pairs():
    rng = np.random.default_rng(3)
    x, y = (np.where(rng.random((4, 9)) < 0.2, np.nan, rng.integers(0, 5, (4, 9)).astype(float)) for _ in range(2))

    def tau(a, b):
        at = [i for i in range(9) if not (math.isnan(a[i]) or math.isnan(b[i]))]
        s = p = q = 0
        for i in at:
            for j in at:
                if i < j:
                    c, d = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
                    s, p, q = s + c * d, p + abs(c), q + abs(d)
        return len(at), s / math.sqrt(p * q)

    n, t = V.crossed_taus(x, y)
    for i in range(4):
        for j in range(4):
            assert (n[i, j], t[i, j]) == (tau(x[i], y[j])[0], pytest.approx(tau(x[i], y[j])[1]))
    assert np.allclose(V.paired_taus(x, y)[1], np.diag(t)) and np.allclose(V.paired_taus(x, y)[0], np.diag(n))


def test_correlations_of_weighted_pairs_equal_numpy():
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=12), rng.normal(size=12), rng.integers(0, 3, (5, 12)).astype(float)
    known = np.arange(12) != 3
    n, r = V.weighted_correlations(w, x, y, known)
    for k in range(5):
        at = np.repeat(np.arange(12), (w[k] * known).astype(int))
        assert n[k] == len(at) and r[k] == pytest.approx(np.corrcoef(x[at], y[at])[0, 1])
    assert np.allclose(V.weighted_correlations(w, np.tile(x, (5, 1)), np.tile(y, (5, 1)), np.tile(known, (5, 1)))[1], r)


def test_values_that_do_not_vary_are_equal_to_their_replicates(spark):
    """As in SQL: NaN equals NaN. Spark's own correlation ends with a division by zero there."""
    rows = [(1, z, 1.0, float(i)) for i, z in enumerate("abcd")] + [(2, "a", 1.0, 2.0), (3, "a", None, 1.0)]
    got = {r.u: (r.real, r.p) for r in V.replicated_levels(spark.createDataFrame(rows, "u int, z string, a double, b double"), "u", "z", "a", "b", "permuted", 1, 5, {"r": V.correlation()}).collect()}
    assert math.isnan(got[1][0]) and math.isnan(got[2][0]) and got[1][1] == got[2][1] == 1.0 and got[3] == (None, 0.0)


def test_draws_of_trials_equal_those_of_rows(spark):
    rng = random.Random(2)
    o = [(1, tr, rng.choice("FO")) for tr in range(30)]
    draws = B.balanced_draws(spark.createDataFrame(o, "u long, tr long, st string"), ["u"], ["st"], "tr", 4, 23).collect()
    strata = [np.array([tr for _, tr, st in o if st == s]) for s in "FO"]
    for rep, w in enumerate(zip(*next(V.strata_draws([V.prefix(23, 1, s) for s in "FO"], strata, 4)))):
        for s, trials, n in zip("FO", strata, w):
            assert sorted(r.tr for r in draws if r.rep == rep and r.st == s) == np.repeat(trials, n.astype(int)).tolist()


MOVED = (
    "i10_kendall", "i10_subsampled_correlation", "i1_permutation_test", "i1_two_sided", "i3_bootstrap_correlation", "u1_named_statistic", "i12_all_pairs_replicates", "i12_kendall", "i11_bootstrap_map_correlation",
    "i11_kendall", "i13_remapping_table", "i13_test_vs_null", "i14_segment_rate_bootstrap", "i23_subject_bootstrap", "i14_segment_tests", "i4_bootstrap_difference", "i2_shift_permutation", "i2_map_shift", "j14_map_significance",
)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["j7_encoder_scores", "j7_encoder_coefs"])
def test_encoders_shuffle_rows_and_not_features(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", MOVED)
def test_no_plan_makes_rows_of_replicates(spark, name):
    assert "Generate" not in catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("members", [4, 1000])
def test_totals_of_draws_equal_their_rows(spark, members):
    """Strata in ranges of few members and whole ones: what draws add up to without a row for each."""
    rng = random.Random(7)
    t = spark.createDataFrame([(rng.choice("ab"), rng.choice("FOP"), 1000 + i) for i in range(60)], "cond string, st string, tr long")
    rows = {s: B.balanced_draws(t, ["cond"], ["st"], "tr", 7, 5, s).collect() for s in ("min", "max", "mean", 3)}
    want: dict = {}
    for r in rows["min"]:
        n, ids = want.get((r.cond, r.st, r.rep), (0, 0))
        want[r.cond, r.st, r.rep] = n + 1, ids + r.tr
    assert {(r.cond, r.st, r.rep): (r.n, r.ids) for r in V.draw_totals(t, ["cond"], ["st"], "tr", 7, 5, members, 3).collect()} == want
    got = {(r.cond, r.st, r["size"]): (r.draws, r["items"], r.ids) for r in V.draws_of_sizes(t, ["cond"], ["st"], "tr", 7, 5, {str(s): s for s in rows}, members).collect()}
    for s, drawn in rows.items():
        for c, o in {(r.cond, r.st) for r in drawn}:
            trs = [r.tr for r in drawn if (r.cond, r.st) == (c, o)]
            assert got[c, o, str(s)] == (len(trs), len(set(trs)), sum(trs))
    counts = {}
    for r in V.draw_counts(t, ["cond"], ["st"], "tr", 7, 5, members, 3).collect():
        for k, n in enumerate(np.frombuffer(bytes(r.counts), np.uint8)):
            counts[r.cond, r.tr, r.block * 3 + k] = int(n)
    for (c, tr, rep), n in counts.items():
        assert n == sum((r.cond, r.tr, r.rep) == (c, tr, rep) for r in rows["min"])


def test_shifted_maps_in_a_task_equal_those_of_rows(spark):
    rng = random.Random(9)
    rows = [(u, i, rng.choice([0.0, 1.0, 2.0, 5.0]), rng.randrange(4), rng.randrange(1, 4)) for u in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "u long, i long, fr double, xb long, yb long")
    moved = MS.shifted_maps(df, ["u"], ["i"], "fr", 12, 37, 2, 5)
    g = M.map_similarity(moved, ["u", "rep"], ["xb", "yb"], "m", F.col("part") == 0, F.col("part") == 1).filter("n >= 3").select("u", "rep", F.round("r", 9).alias("score"))
    stable = {r.u: (r.real, r.p, r.significant) for r in MS.significance(g, ["u"], "score").collect()}
    assert {r.u: (r.real, r.p, r.significant) for r in MS.stability_tests(df, "u", ["i"], "fr", 12, 37, 2, 5).collect()} == stable
    dense = MS.dense_maps(MS.shifted_maps(df, ["u"], ["i"], "fr", 12, 37, 2), ["u", "rep"], "m", (0, 3), (1, 3))
    border = MS.scored_maps(dense, ["u", "rep"], (0, 3), (1, 3), 0.75, 2, 1).select("u", "rep", F.round("border", 9).alias("score"))
    want = {("border", r.u): (r.real, r.p, r.significant) for r in MS.significance(border, ["u"], "score").collect()} | {("stability", u): v for u, v in stable.items()}
    got = {(r.analysis, r.u): (r.real, r.p, r.significant) for r in MS.map_tests(df, "u", ["i"], "fr", 12, 37, 2, 5, (0, 3), (1, 3), 0.75, 2, 1).collect() if r.analysis != "grid"}
    assert got == want and want

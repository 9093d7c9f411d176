"""Models without SQL against hand-written fits and separable cases."""

import hashlib
import statistics

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tracklane.operators import maps as M
from tracklane.operators import models as P
from tracklane.operators import resample as B
from tracklane.operators import storage


def test_poisson_regression_against_newton(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for u in range(3):
        x = rng.uniform(-1, 1, (200, 2))
        y = rng.poisson(np.exp(0.5 + x @ np.array([0.8 - u, 0.3])))
        rows += [(u, int(b), float(a[0]), float(a[1])) for a, b in zip(x, y)]
        m, beta = np.column_stack([np.ones(200), x]), np.array([np.log(y.mean()), 0, 0])
        for _ in range(30):
            mu = np.exp(m @ beta)
            beta = beta + np.linalg.solve(m.T @ (m * mu[:, None]), m.T @ (y - mu))
        want[u] = beta
    rows += [(9, 0, 0.1, 0.2), (9, 0, 0.3, 0.1), (0, None, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "u long, y int, a double, b double")
    got = {r["u"]: r["coef"] for r in P.poisson_regression(df, ["u"], "y", ["a", "b"]).collect()}
    assert set(got) == {0, 1, 2}  # no mean, no model
    for u, beta in want.items():
        assert np.allclose(got[u], beta, atol=1e-4)


def test_decoders_find_what_separates(spark):
    rows = [(i, i % 3, float(i % 3) + 0.01 * (i % 7), float(i % 5), i % 4) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y int, good double, bad double, fold int")
    out = P.decoders(df, "y", "fold", 4, {"good": ["good"], "bad": ["bad"]}, reg=0.001)
    acc = {r["experiment"]: (r["n"], r["a"]) for r in out.groupBy("experiment").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("a")).collect()}
    assert acc["good"][0] == acc["bad"][0] == 240 and acc["good"][1] > 0.95 and acc["bad"][1] < 0.6


def test_cross_validation_takes_any_estimator(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2), i % 2 if i % 4 < 2 else 1 - i % 2) for i in range(40)], "y double, x double, fold int").withColumn("features", P.array_to_vector(F.array("x")))
    assert P.cross_validated(df, "fold", 2, LogisticRegression(labelCol="y")).filter("y = prediction").count() == 40


def test_cluster_count_and_components(spark):
    rng = np.random.default_rng(1)
    pts = [(i, [float(v) for v in rng.normal(10 * (i % 3), 0.1, 4)], i % 2) for i in range(90)]
    df = P.reduced(spark.createDataFrame(pts, "id long, v array<double>, fold int"), "v", 1, "pc")
    err = {r["k"]: r["e"] for r in P.cluster_errors(df, "pc", "fold", 2, range(2, 4)).groupBy("k").agg(F.avg("error").alias("e")).collect()}
    assert err[3] < 1 < err[2]


def test_border_score_of_a_wall_and_a_centre(spark):
    wall = [(1, 0, y, 1.0) for y in range(5)]
    centre = [(2, 2, 2, 1.0)]
    got = {r["u"]: r["score"] for r in M.border_score(spark.createDataFrame(wall + centre, "u long, xb long, yb long, m double"), ["u"], "m", (0, 4), (0, 4)).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(-1.0)}


def test_materialized_builds_once_for_each_set_of_parameters(spark, tmp_path):
    calls = []

    def build(n, k):
        calls.append((n, k))
        return spark.range(n).withColumn("k", F.lit(k))

    ask = lambda **p: storage.materialized(build, spark, str(tmp_path), "t", p, {"n": 2, "k": 1}).count()
    assert [ask(), ask(n=2), ask(n=3), ask(n=3, k=1)] == [2, 2, 3, 3] and calls == [(2, 1), (3, 1)]


def test_named_statistics_of_hashed_relabelling(spark):
    a, b = [3.0, 1.0, 4.0, 1.5, 9.0], [2.0, 6.0, 5.0, 3.0, 5.5]
    df = spark.createDataFrame([(7, i, x, y) for i, (x, y) in enumerate(zip(a, b))], "u long, z long, a double, b double")
    mixed = B.permuted(df, ["u"], ["z"], "b", 6, 5, "other").withColumn("gap", F.abs(F.col("a") - F.col("other")))
    for name, stat in (("max", max), ("median", statistics.median), ("mean", statistics.mean)):
        got = {r["rep"]: r["v"] for r in mixed.groupBy("rep").agg(P.STATISTICS[name]("gap").alias("v")).collect()}
        for rep in range(7):
            order = sorted(range(1, 6), key=lambda i: (hashlib.md5(f"5|7|{rep}|{i}".encode()).hexdigest() if rep else f"{i:012}", i))
            assert got[rep] == pytest.approx(stat([abs(x - b[i - 1]) for x, i in zip(a, order)]))

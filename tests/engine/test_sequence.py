"""Hand-sized cases: unfinished trials, ties, missing values, empty tables."""

from tracklane.operators import aggregate as A
from tracklane.operators import sequence as Q


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_trials_without_outcome_and_empty(spark):
    schema = "s string, t double, ev string"
    e = spark.createDataFrame([("a", 0.0, "noise"), ("a", 1.0, "L"), ("a", 2.0, "ok"), ("a", 3.0, "R"), ("a", 4.0, "bad"), ("a", 5.0, "ok"), ("a", 6.0, "L")], schema)
    cut = lambda d: Q.trials(d, ["s"], "t", "ev", {"L": "L", "R": "R"}, "ok", "bad", "dec")
    got = {r.trial: r for r in cut(e).collect()}
    assert [got[i].correct for i in range(3)] == [1, 0, None]
    assert [got[i].tE for i in range(3)] == [3.0, 6.0, 6.0]
    assert cut(e.limit(0)).count() == 0


def test_nearest_takes_the_earlier_on_ties(spark):
    axis = spark.createDataFrame([("a", 1.0), ("a", 9.0)], "s string, t double")
    points = spark.createDataFrame([("a", 0.0, 10.0), ("a", 2.0, 20.0)], "s string, t double, v double")
    assert rows(Q.nearest(axis, points, ["s"], "t", "v")) == [("a", 1.0, 10.0), ("a", 9.0, 20.0)]


def test_fill_and_merge(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("a", 4, 8.0)], "s string, i int, v double")
    assert [r.filled for r in Q.fill(d, ["s"], ["i"], "v", "mean").orderBy("i").collect()] == [4.0, 4.0, 6.0, 8.0]
    m = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 5, 6)], "s string, x int, y int")
    assert rows(Q.merge_intervals(m, ["s"], "x", "y")) == [("a", 0, 3, 2), ("a", 5, 6, 1)]


def test_ranks_with_ties_and_kendall(spark):
    d = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 2.0, 1.0), ("g", 3, 2.0, 5.0)], "g string, i int, x double, y double")
    assert sorted(r.k for r in A.average_ranks(d, ["g"], "x", "k").collect()) == [1.0, 2.5, 2.5]
    assert abs(A.kendall(d, ["g"], "i", "x", "y").first().tau - 0.5) < 1e-9

"""Scores against table values, hand-sized cases and a drawn grid."""

import math

import pytest
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import sequence as Q


def test_student_tail_at_table_values(spark):
    rows = [(12.7062, 1), (-4.30265, 2), (2.57058, 5), (2.08596, 20), (1.98397, 100), (1.96008, 50000), (0.0, 7)]
    got = spark.createDataFrame(rows, "t double, df long").select(S.student_tail("t", "df").alias("p")).collect()
    assert [round(r.p, 4) for r in got] == [0.05] * 6 + [1.0]


def test_auc_counts_ties_half(spark):
    rows = [("a", 0.9, 0.1), ("a", 0.5, 0.5), ("b", 0.5, 0.5), ("b", 0.2, 0.8), ("c", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "y string, p double, q double")
    assert A.auc_one_vs_one(df, [], "y", {"a": "p", "b": "q"}).first().auc == pytest.approx(3.5 / 4)


def test_log_loss_clips_and_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 0.5)], "y string, p double, q double")
    r = A.log_loss(df, [], "y", {"a": "p", "b": "q"}).first()
    assert r.loss == pytest.approx(math.log(2) / 2, abs=1e-9) and r.chance == pytest.approx(math.log(2)) and r.score == pytest.approx(0.5, abs=1e-9)


def test_rows_near_events_are_left_out_on_both_sides(spark):
    df = spark.createDataFrame([(1, float(t), t == 5) for t in range(10)] + [(2, 5.0, False)], "s long, t double, e boolean")
    assert sorted((r.s, r.t) for r in Q.outside_events(df, ["s"], "t", F.col("e"), 2.0).collect()) == [(1, 0.0), (1, 1.0), (1, 2.0), (1, 8.0), (1, 9.0), (2, 5.0)]


def test_closing_fills_a_hole_and_keeps_the_size(spark):
    bins = [(x, y, 0.0 if (x, y) == (3, 3) or not (2 <= x <= 4 and 2 <= y <= 4) else 1.0) for x in range(7) for y in range(7)]
    got = M.field_mask(spark.createDataFrame(bins, "xb long, yb long, v double").withColumn("u", F.lit(1)), ["u"], "v", 0.5)
    assert {(r.xb, r.yb) for r in got.collect()} == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)}


def test_median_takes_a_spike_away(spark):
    bins = spark.createDataFrame([(1, x, y, 100.0 if (x, y) == (2, 2) else 1.0) for x in range(5) for y in range(5)], "u long, xb long, yb long, v double")
    at = {(r.xb, r.yb): r.v for r in M.median_smooth(bins, ["u"], "v").collect()}
    assert at[2, 2] == 1.0 and at[0, 0] == 0.0 and at[1, 0] == 1.0


def test_grid_score_tells_hexagons_from_squares(spark):
    side, gap = 41, 10.0

    def hexagonal(x, y):
        wave = 4 * math.pi / 3**0.5 / gap
        return sum(math.cos(wave * (x * math.cos(a) + y * math.sin(a))) for a in (math.pi / 6, math.pi / 2, 5 * math.pi / 6)) / 4.5 + 1 / 3

    def square(x, y):
        return (2 + math.cos(2 * math.pi * x / gap) + math.cos(2 * math.pi * y / gap)) / 4

    for_each = {"hexagons": hexagonal, "squares": square}
    rows = [(n, x, y, f(x - 20, y - 20) ** 4) for n, f in for_each.items() for x in range(side) for y in range(side)]
    got = {r.u: r for r in M.grid_score(spark.createDataFrame(rows, "u string, xb long, yb long, v double"), ["u"], "v").collect()}
    assert got["hexagons"].score > 0.5 and abs(got["hexagons"].scale - gap) < 1 and got["hexagons"].phase < 0.15
    assert got["squares"].score < 0


def test_medians_from_counts_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g in range(4) for v in rng.integers(0, 9, 5 + g) / 2] + [(9, 1.5), (8, None)]
    got = {r.g: (r.med, r.mad) for r in A.mad(spark.createDataFrame(rows, "g long, v double"), ["g"], "v").collect()}
    for g in {g for g, v in rows if v is not None}:
        v = np.array([x for h, x in rows if h == g and x is not None])
        assert got[g] == (np.median(v), np.median(np.abs(v - np.median(v))))
    assert 8 not in got


@pytest.mark.parametrize("ranges", [2, 7, 200])
def test_exact_quantiles_equal_numpy(spark, ranges):
    import numpy as np

    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=300), np.full(200, 0.25)])  # a value that holds two fifths of the rows
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for parts in (2, 3, 10):
        assert A.exact_quantiles(df, "v", parts, ranges) == pytest.approx(np.quantile(v, [i / parts for i in range(1, parts)]).tolist())


def test_quantile_groups_of_few_rows(spark):
    one = spark.createDataFrame([(2.0,), (None,)], "v double")
    assert sorted(r.part for r in A.quantile_groups(one, "v", 3, "part").collect()) == [0, 0]
    assert A.quantile_groups(one.filter("v > 5"), "v", 3, "part").count() == 0
    many = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert [r.part for r in A.quantile_groups(many, "v", 3, "part").orderBy("v").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]

"""Student's tail against its finite series, at whole and other degrees of freedom, and under clashing names."""

import math

import pytest
from pyspark.sql import functions as F

from tracklane.functions import scalar as S


def series(t, df):
    th = math.atan(abs(t) / math.sqrt(df))
    s, c = math.sin(th), math.cos(th)
    if df == 1:
        return 1 - 2 * th / math.pi
    o = df % 2
    term = total = c if o else 1.0
    for k in range(1, (df - 2 - o) // 2 + 1):
        term *= c * c * (2 * k - 1 + o) / (2 * k + o)
        total += term
    return 1 - (2 / math.pi * (th + s * total) if o else s * total)


def test_student_tail_at_any_degrees_of_freedom(spark):
    rows = [(float(t), d) for t in (0, 0.01, 0.5, 1, 2, -3, 7, 50, 1e4) for d in (1, 2, 3, 7, 99, 1000, 1001, 5000, 100_000)]
    got = spark.createDataFrame(rows, "t double, df int").select("t", "df", S.student_tail("t", "df").alias("p")).collect()
    assert all(r.p == pytest.approx(series(r.t, r.df), abs=1e-10) for r in got)
    between = spark.createDataFrame([(1.5, 6.5), (1.5, 6.0), (1.5, 7.0), (1.5, 0.0), (1.5, None)], "t double, df double").select(S.student_tail("t", "df").alias("p")).collect()
    assert between[1].p > between[0].p > between[2].p and between[3].p is None and between[4].p is None


def test_student_tail_beside_a_column_of_the_same_name(spark):
    df = spark.createDataFrame([(0.4024389, 550)], "t double, df int")
    both = df.select(F.round("t", 1).alias("t"), F.lit(3).alias("df"), S.student_tail("t", "df").alias("p")).first()
    assert both.p == pytest.approx(series(0.4024389, 550), abs=1e-10)

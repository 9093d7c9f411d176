import random

from tracklane.operators import maps, resample


def test_greedy_matching_against_a_loop(spark):
    rng = random.Random(4)
    pairs = [(block, a, 100 + b, float(rng.randrange(12))) for block in range(4) for a in range(9) for b in range(7)]
    want = set()
    for block in range(4):
        used = set()
        for d, a, b in sorted((d, a, b) for k, a, b, d in pairs if k == block):
            if a not in used and b not in used:
                used |= {a, b}
                want.add((block, a, b, d))
    df = spark.createDataFrame(pairs, "block int, a int, b int, dist double")
    assert {tuple(r) for r in resample.greedy_matching(df, ["block"], "a", "b", "dist").collect()} == want
    assert resample.greedy_matching(df.filter("false"), ["block"], "a", "b", "dist").count() == 0


def test_fields_join_touching_bins(spark):
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 5, 5), (1, 8, 1), (1, 8, 2), (2, 0, 0), (2, 0, 1)]
    got = {(r["u"], r["field"], r["n"]) for r in maps.fields(spark.createDataFrame(rows, "u int, xb int, yb int"), ["u"], 2).collect()}
    assert got == {(1, 0, 3), (1, 8_000_001, 2), (2, 0, 2)}


def test_balanced_draws_have_the_size_of_the_smallest_stratum(spark):
    rows = [("c", "F", i) for i in range(10)] + [("c", "O", i) for i in range(4)]
    draws = resample.balanced_draws(spark.createDataFrame(rows, "cond string, st string, tr int"), ["cond"], ["st"], "tr", 3, 1)
    assert {(r["st"], r["rep"]): r["count"] for r in draws.groupBy("st", "rep").count().collect()} == {(s, r): 4 for s in "FO" for r in range(3)}
    assert draws.filter("st = 'O' and tr > 3").count() == 0


def test_permutation_keeps_the_values_and_replicate_0_is_real(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "u int, i int, v double")
    for f in (resample.permuted, resample.shifted):
        got = f(df, ["u"], ["i"], "v", 4, 3, "other").collect()
        assert all(r["other"] == r["v"] for r in got if r["rep"] == 0)
        for rep in range(5):
            assert sorted(r["other"] for r in got if r["rep"] == rep) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]

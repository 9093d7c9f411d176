"""Resampling and matching: draws are rows picked by a portable hash, so replicates run as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.scalar import hash_pick
from tracklane.operators.storage import cut


def balanced_draws(trials: DataFrame, keys, strata, item, reps: int, seed: int, size: str | int = "min") -> DataFrame:
    """(keys, strata, rep, item): for each replicate as many draws with replacement from every stratum.

    size: that of the smallest ("min") or largest ("max") stratum of the group, "mean" of the two rounded down, or a number.
    """
    t = trials.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, *strata).orderBy(item)) - 1)
    counts = trials.groupBy(*keys, *strata).agg(F.count("*").alias("_n"))
    of_group = counts.groupBy(*keys).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    wanted = {"min": F.col("_lo"), "max": F.col("_hi"), "mean": F.floor((F.col("_lo") + F.col("_hi")) / 2)}.get(size, F.lit(size))
    draws = counts.join(of_group, keys).withColumn("_size", wanted.cast("int")).filter("_size > 0")
    draws = draws.select(*keys, *strata, "_n", "_size", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(*keys, *strata, "_n", "rep", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_i"))
    pick = hash_pick(F.concat_ws("|", F.lit(str(seed)), *keys, *strata, "rep", "_i"), F.col("_n"))
    draws = draws.select(*keys, *strata, "rep", pick.cast("int").alias("_i"))
    return draws.join(t.select(*keys, *strata, "_i", item), [*keys, *strata, "_i"]).drop("_i")


def permuted(df: DataFrame, keys, order: list[str], value, reps: int, seed: int, out: str) -> DataFrame:
    """The rows once for each replicate, with the values of the group in hashed order: replicate 0 is the real one."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order)))
    many = d.select(*keys, "_i", value, F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    mixed = F.when(F.col("rep") == 0, F.lpad(F.col("_i").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys, "rep", "_i")))
    other = many.select(*keys, "rep", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(mixed, "_i")).alias("_i"), F.col(value).alias(out))
    return other.join(d.hint("shuffle_hash"), [*keys, "_i"])  # the rows themselves are not copied for each replicate


def shifted(df: DataFrame, keys, order: list[str], value, reps: int, seed: int, out: str) -> DataFrame:
    """Like permuted, but the values are shifted around the group by a hashed number of rows."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    many = d.select(*keys, "_i", "_n", value, F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    by = F.when(F.col("rep") == 0, F.lit(0)).otherwise(hash_pick(F.concat_ws("|", F.lit(str(seed)), *keys, "rep"), F.col("_n")))
    other = many.select(*keys, "rep", F.pmod(F.col("_i") + by, F.col("_n")).cast("int").alias("_i"), F.col(value).alias(out))
    return other.join(d.hint("shuffle_hash"), [*keys, "_i"])


def achieved_level(stats: DataFrame, keys, value) -> DataFrame:
    """(keys, real, p): share of the replicates 1 .. whose statistic is at least that of replicate 0."""
    real = F.max(F.when(F.col("rep") == 0, F.col(value))).over(Window.partitionBy(*keys))
    d = stats.withColumn("real", real).filter("rep > 0")
    return d.groupBy(*keys).agg(F.first("real").alias("real"), F.avg((F.col(value) >= F.col("real")).cast("double")).alias("p"))


def two_sided(levels: DataFrame, p, alpha: float, out: str) -> DataFrame:
    """Appends whether the real value lies outside the replicates: p within alpha / 2 of 0 or of 1."""
    return levels.withColumn(out, (F.col(p) <= alpha / 2) | (F.col(p) >= 1 - alpha / 2))


def median_slope(points: DataFrame, keys, item, x, y) -> DataFrame:
    """Repeated-median line of each group: pairs inside a group, for groups of zones or sessions."""
    a = points.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = points.select(*keys, F.col(item).alias("_j"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    pairs = a.join(b, keys).filter("_i <> _j and _x <> _u")
    per = pairs.groupBy(*keys, "_i").agg(F.median((F.col("_v") - F.col("_y")) / (F.col("_u") - F.col("_x"))).alias("_s"))
    slope = per.groupBy(*keys).agg(F.median("_s").alias("slope"))
    return points.join(slope, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.median(F.col(y) - F.col("slope") * F.col(x)).alias("icpt"))


def greedy_matching(pairs: DataFrame, keys, a, b, dist) -> DataFrame:
    """(keys, a, b, dist): one-to-one pairs in order of distance within each block; ties by a, then b.

    Each round takes the pairs that are the nearest of both members and drops all pairs of the members taken. The
    nearest pair left in a block is always taken, so rounds end; each is cut from its lineage on shared storage.
    """
    left, done = pairs.select(*keys, a, b, dist), None
    while True:
        rank = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(dist, a, b))
        best = cut(left.withColumns({"_a": rank(a), "_b": rank(b)}).filter("_a = 1 and _b = 1").drop("_a", "_b"))
        if best.isEmpty():
            return best if done is None else done
        done = best if done is None else done.unionByName(best)
        left = cut(left.join(best.select(*keys, a), [*keys, a], "left_anti").join(best.select(*keys, b), [*keys, b], "left_anti"))

"""Window and sequence operators: partitioned by session, never ordered globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def velocity(df: DataFrame, keys, order, x, y, step: float) -> DataFrame:
    """Appends speed and heading from the previous sample; 0 at the first."""
    w = over(keys, order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumns({"speed": F.coalesce(F.hypot(dx, dy) / step, F.lit(0.0)), "heading": F.coalesce(F.atan2(dy, dx), F.lit(0.0))})


def switches(df: DataFrame, keys, order, cue, correct) -> DataFrame:
    """sw: the cue differs from the one before; vsw: and the trial before was correct."""
    w = over(keys, order)
    sw = F.coalesce((F.col(cue) != F.lag(cue).over(w)).cast("long"), F.lit(0))
    return df.withColumn("sw", sw).withColumn("vsw", F.coalesce(F.lag(correct).over(w) * F.col("sw"), F.lit(0)))


def fill(df: DataFrame, keys, order, value, method: str = "last", out: str = "filled") -> DataFrame:
    """Fills nulls by the last, the next or the mean of both known values; 0 where there is none."""
    w = over(keys, order)
    last = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = {"last": last, "next": following, "mean": (F.coalesce(last, following) + F.coalesce(following, last)) / 2}[method]
    return df.withColumn(out, F.coalesce(F.col(value), got, F.lit(0.0)))


def rolling_median(df: DataFrame, keys, order, value, before: int, after: int, out: str = "med") -> DataFrame:
    """Median over a bounded frame of rows."""
    frame = over(keys, order).rowsBetween(-before, after)
    a = F.array_sort(F.collect_list(value).over(frame))
    df = df.withColumn("_a", a)
    n = F.size("_a")
    mid = (F.get(F.col("_a"), F.floor((n - 1) / 2).cast("int")) + F.get(F.col("_a"), F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(out, mid).drop("_a")


def runs(df: DataFrame, keys, order, value) -> DataFrame:
    """Appends the number of the run of equal values (from 1)."""
    w = over(keys, order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    return df.withColumn("_new", first).withColumn("run", F.sum("_new").over(w).cast("long")).drop("_new")


def run_table(df: DataFrame, keys, t, value) -> DataFrame:
    """One row for each run: start, end, number of samples."""
    return runs(df, keys, [t], value).groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(t).alias("t0"), F.max(t).alias("tE"), F.count("*").alias("n"))


def merge_intervals(df: DataFrame, keys, start, end) -> DataFrame:
    """Overlapping or touching intervals become one."""
    w = over(keys, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_g").agg(F.min(start).alias("t0"), F.max(end).alias("tE"), F.count("*").alias("n")).drop("_g")


def trials(events: DataFrame, keys, t, event, cues: dict[str, str], right: str, wrong: str, decision: str) -> DataFrame:
    """Trials from cue events: the next cue bounds a trial; the earliest end event decides its outcome.

    `cues` maps event names to cue codes. Returns keys, trial (from 0), t0, tE, cue, tD (first decision), tR (first outcome),
    correct (null if there is no outcome).
    """
    w = over(keys, [t, event])
    is_cue = F.col(event).isin(list(cues))
    numbered = events.withColumn("trial", F.sum(F.when(is_cue, 1).otherwise(0)).over(w) - 1).filter("trial >= 0")
    cue = F.coalesce(*[F.when(F.col(event) == k, F.lit(v)) for k, v in cues.items()])
    outcome = F.when(F.col(event).isin(right, wrong), F.struct(F.col(t).alias("t"), (F.col(event) == right).cast("long").alias("ok")))
    per = numbered.groupBy(*keys, "trial").agg(
        F.min(F.when(is_cue, F.col(t))).alias("t0"), F.max(F.when(is_cue, cue)).alias("cue"), F.max(t).alias("_last"),
        F.min(F.when(F.col(event) == decision, F.col(t))).alias("tD"), F.min(outcome).alias("_o"),
    )
    after = F.lead("t0").over(over(keys, ["trial"]))
    return per.select(*keys, F.col("trial").cast("long").alias("trial"), "t0", F.coalesce(after, F.col("_last")).alias("tE"), "cue", "tD", F.col("_o.t").alias("tR"), F.col("_o.ok").alias("correct"))


def asof(left: DataFrame, right: DataFrame, keys, t, value, out: str) -> DataFrame:
    """Last value of right at or before t, without an inequality join: union, then last over the window."""
    cols = left.columns
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)}).unionByName(
        right.select(*keys, t, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = over(keys, [t, "_side"]).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", True).over(w)).filter("_side = 1").select(*cols, out)


def nearest(axis: DataFrame, points: DataFrame, keys, t, value) -> DataFrame:
    """Value of the nearest point on a new axis; the earlier one on ties."""
    both = axis.select(*keys, t, F.lit(None).cast("struct<t:double,v:double>").alias("_p"), F.lit(1).alias("_axis")).unionByName(
        points.select(*keys, t, F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_p"), F.lit(0).alias("_axis"))
    )
    back = F.last("_p", True).over(over(keys, [t, "_axis"]).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_p", True).over(over(keys, [t, F.desc("_axis")]).rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"_b": back, "_a": ahead}).filter("_axis = 1")
    pick = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col(t) - F.col("_b.t") <= F.col("_a.t") - F.col(t)), F.col("_b.v")).otherwise(F.col("_a.v"))
    return got.select(*keys, t, pick.alias(value))


def tolerance_join(a: DataFrame, b: DataFrame, keys, t: str, width: float) -> DataFrame:
    """Pairs of rows of a and b (columns ta, tb and the rest) within the tolerance; an equi join on time buckets."""
    a = a.withColumn("_k", F.explode(F.array(*[F.floor(F.col(t) / width) + i for i in (-1, 0, 1)]))).withColumnRenamed(t, "ta")
    b = b.withColumn("_k", F.floor(F.col(t) / width)).withColumnRenamed(t, "tb")
    return a.join(b, [*keys, "_k"]).filter(F.abs(F.col("ta") - F.col("tb")) <= width).drop("_k")


def first_after(a: DataFrame, b: DataFrame, keys, t: str, low: float, high: float) -> DataFrame:
    """For each row of a the first b in [t + low, t + high], null if none; linear, by the next b in time order."""
    shifted = a.withColumn("_from", F.col(t) + low)
    both = shifted.select(*keys, F.col("_from").alias("_o"), F.col(t).alias("ta"), F.lit(None).cast("double").alias("_b"), F.lit(0).alias("_s")).unionByName(
        b.select(*keys, F.col(t).alias("_o"), F.lit(None).cast("double").alias("ta"), F.col(t).cast("double").alias("_b"), F.lit(1).alias("_s"))
    )
    nxt = F.first("_b", True).over(over(keys, ["_o", "_s"]).rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumn("_n", nxt).filter("_s = 0")
    return got.select(*keys, "ta", F.when(F.col("_n") <= F.col("ta") + high, F.col("_n")).alias("tb"))


def fold_of(position, block: int, folds: int) -> Column:
    return (F.floor(F.col(position) / block) % folds).cast("long")


def kernel_smooth(df: DataFrame, keys, sample, values: list[str], weights: list[float]) -> DataFrame:
    """Convolves sparse samples with a symmetric kernel scaled to 1; samples outside the recorded range are dropped.

    Each row is written once for each offset of the kernel and summed again: no join, work by non-empty samples.
    """
    half, total = len(weights) // 2, sum(weights)
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_lo": F.min(sample).over(w), "_hi": F.max(sample).over(w)})
    cells = [F.struct((F.col(sample) + (i - half)).alias("_at"), *[(F.col(v) * (k / total)).alias(f"_{v}") for v in values]) for i, k in enumerate(weights)]
    d = d.select(*keys, "_lo", "_hi", F.inline(F.array(*cells))).filter("_at between _lo and _hi")
    return d.groupBy(*keys, F.col("_at").alias(sample)).agg(*[F.sum(f"_{v}").alias(v) for v in values])


def lag_features(df: DataFrame, keys, sample, zone, n, max_lag: int) -> DataFrame:
    """(keys, sample, zone, w): zones of the samples before, weighted by 1 / lag for lags 1 .. max_lag - 1, scaled by the row's maximum."""
    cells = [F.struct((F.col(sample) + i).alias("_at"), (F.col(n) / i).alias("_w")) for i in range(1, max_lag)]
    g = df.select(*keys, zone, F.inline(F.array(*cells))).groupBy(*keys, F.col("_at").alias(sample), zone).agg(F.sum("_w").alias("w"))
    return g.withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy(*keys, sample)))


def neighbour_features(df: DataFrame, keys, sample, zone, n, max_lag: int, decay: str, ahead: bool = False) -> DataFrame:
    """Like lag_features with the decay `inverse` (1 / lag), `linear` (1 - lag / max_lag) or `constant`, of the samples before or ahead."""
    weight = {"inverse": lambda i: 1 / i, "linear": lambda i: 1 - i / max_lag, "constant": lambda i: 1.0}[decay]
    cells = [F.struct((F.col(sample) + (-i if ahead else i)).alias("_at"), (F.col(n) * weight(i)).alias("_w")) for i in range(1, max_lag)]
    g = df.select(*keys, zone, F.inline(F.array(*cells))).groupBy(*keys, F.col("_at").alias(sample), zone).agg(F.sum("_w").alias("w"))
    return g.withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy(*keys, sample)))


def outside_events(df: DataFrame, keys, t, event, pad: float) -> DataFrame:
    """Rows further than `pad` from every row of their group where `event` holds."""
    w = Window.partitionBy(*keys).orderBy(t)
    at = F.when(event, F.col(t))
    d = df.withColumns({"_before": F.max(at).over(w), "_after": F.min(at).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    near = F.coalesce(F.col(t) - F.col("_before") <= pad, F.lit(False)) | F.coalesce(F.col("_after") - F.col(t) <= pad, F.lit(False))
    return d.filter(~near).drop("_before", "_after")


def interval_summary(df: DataFrame, keys, t, order) -> DataFrame:
    """(keys, n, rate, cv): rows, rate over the time spanned, coefficient of variation of the intervals between rows."""
    g = df.withColumn("_d", F.col(t) - F.lag(t).over(over(keys, order)))
    span = F.max(t) - F.min(t)
    return g.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") / F.when(span > 0, span)).alias("rate"), (F.stddev_pop("_d") / F.when(F.avg("_d") > 0, F.avg("_d"))).alias("cv"))

"""Maps of bins or zones: comparison of two maps, neighbourhoods, fields, Gaussian cluster geometry."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.storage import cut


def map_similarity(maps: DataFrame, keys, zone: list[str], value, first: Column, second: Column) -> DataFrame:
    """(keys, n, r): correlation of two maps over the zones that both have; one grouped pass pairs the zones."""
    both = maps.groupBy(*keys, *zone).agg(F.max(F.when(first, F.col(value))).alias("_a"), F.max(F.when(second, F.col(value))).alias("_b")).dropna(subset=["_a", "_b"])
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r"))


def neighbours(bins: DataFrame, reach: int, x: str = "xb", y: str = "yb") -> DataFrame:
    """Each bin once for every cell (cx, cy) within reach, itself included; no join."""
    cells = [F.struct((F.col(x) + i).alias("cx"), (F.col(y) + j).alias("cy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return bins.select("*", F.inline(F.array(*cells)))


def labelled_bins(bins: DataFrame, keys, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, x, y, field): each bin with the first bin of its group of touching bins.

    The smallest bin number spreads to the neighbours until nothing changes: rounds are bounded by the bins of one map.
    """
    at = bins.select(*keys, x, y, (F.col(x) * 1_000_000 + F.col(y)).alias("field"))
    before = None
    while True:
        low = neighbours(at, 1, x, y).groupBy(*keys, F.col("cx").alias(x), F.col("cy").alias(y)).agg(F.min("field").alias("_low"))
        at = cut(at.join(low, [*keys, x, y]).select(*keys, x, y, F.col("_low").alias("field")))
        now = at.agg(F.sum("field")).first()[0]
        if now == before:
            return at
        before = now


def fields(bins: DataFrame, keys, least: int, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, field, n, cx, cy): groups of touching bins with at least `least` bins, named by their first bin."""
    at = labelled_bins(bins, keys, x, y)
    return at.groupBy(*keys, "field").agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy")).filter(F.col("n") >= least)


def median_smooth(bins: DataFrame, keys, value, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, x, y, v): median of the nine cells around every cell near a bin; cells without a bin are 0, values are not negative."""
    g = neighbours(bins.select(*keys, x, y, value), 1, x, y).groupBy(*keys, F.col("cx").alias(x), F.col("cy").alias(y)).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return g.select(*keys, x, y, F.when(F.size("_v") >= 5, F.element_at("_v", F.greatest(F.size("_v") - 4, F.lit(1)))).otherwise(0.0).alias("v"))


def dilated(bins: DataFrame, keys, x: str = "xb", y: str = "yb") -> DataFrame:
    return neighbours(bins.select(*keys, x, y), 1, x, y).select(*keys, F.col("cx").alias(x), F.col("cy").alias(y)).distinct()


def eroded(bins: DataFrame, keys, x: str = "xb", y: str = "yb") -> DataFrame:
    """Cells whose nine cells are all bins."""
    g = neighbours(bins.select(*keys, x, y), 1, x, y).groupBy(*keys, F.col("cx").alias(x), F.col("cy").alias(y)).count()
    return g.filter("count = 9").drop("count")


def field_mask(bins: DataFrame, keys, value, share: float, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, x, y): bins of at least `share` of their map's maximum, closed (dilated, then eroded) inside the map's bins."""
    top = bins.groupBy(*keys).agg(F.max(value).alias("_top"))
    over = bins.join(top, keys).filter(F.col(value) >= share * F.col("_top"))
    return eroded(dilated(over, keys, x, y), keys, x, y).join(bins.select(*keys, x, y), [*keys, x, y], "left_semi")


def autocorrelation(bins: DataFrame, keys, value, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, dx, dy, s): sums of products of bins apart by (dx, dy); pairs of bins of one map, a number fixed by the arena."""
    a, b = (bins.select(*keys, F.col(x).alias(f"{n}x"), F.col(y).alias(f"{n}y"), F.col(value).alias(f"{n}v")) for n in "ab")
    return a.join(b, keys).groupBy(*keys, (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")).agg(F.sum(F.col("av") * F.col("bv")).alias("s"))


def grid_score(bins: DataFrame, keys, value, floor: float = 0.01, inner: float = 0.5, outer: float = 2.0, x: str = "xb", y: str = "yb", tie: float = 0.0, digits: int | None = None) -> DataFrame:
    """(keys, score, scale, phase) from the map's autocorrelation.

    Peaks are cells above `floor` of the centre and not below any of their eight neighbours. The six nearest to the centre
    (ties by dx, dy) give the scale, their mean distance, and the phase, the smallest angle from the x axis. The ring of
    inner .. outer scales is turned by 30 .. 150 degrees onto the nearest cell (0 outside the map) and correlated with
    itself, where both vary: the score is the mean at 60 and 120 less that at 30, 90 and 150 degrees. Maps with under two peaks have none.
    For values that are not whole, sums are rounded to `digits` and cells within `tie` of their neighbours count as peaks.
    """
    ac = autocorrelation(bins, keys, value, x, y)
    ac = cut(ac if digits is None else ac.withColumn("s", F.round("s", digits)))
    near = neighbours(ac, 1, "dx", "dy").groupBy(*keys, F.col("cx").alias("dx"), F.col("cy").alias("dy")).agg(F.max("s").alias("_top"))
    centre = ac.filter("dx = 0 and dy = 0").select(*keys, F.col("s").alias("_s0"))
    peaks = ac.filter("dx <> 0 or dy <> 0").join(near, [*keys, "dx", "dy"]).join(centre, keys).filter((F.col("s") >= F.col("_top") - tie) & (F.col("s") > floor * F.col("_s0")))
    order = Window.partitionBy(*keys).orderBy(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), "dx", "dy")
    angle = F.abs(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")))
    scale = peaks.withColumn("_k", F.row_number().over(order)).filter("_k <= 6").groupBy(*keys).agg(F.avg(F.hypot("dx", "dy")).alias("scale"), F.min(angle).alias("phase"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")
    ring = ac.join(scale, keys).filter(F.hypot("dx", "dy").between(inner * F.col("scale"), outer * F.col("scale"))).select(*keys, "dx", "dy", "s")
    turns = [F.struct(F.lit(i).alias("_i"), _nearest(F.col("dx") * cos(i * pi / 6) - F.col("dy") * sin(i * pi / 6)).alias("_tx"), _nearest(F.col("dx") * sin(i * pi / 6) + F.col("dy") * cos(i * pi / 6)).alias("_ty")) for i in range(1, 6)]
    other = ac.select(*keys, F.col("dx").alias("_tx"), F.col("dy").alias("_ty"), F.col("s").alias("_u"))
    corr = ring.select(*keys, "s", F.inline(F.array(*turns))).join(other, [*keys, "_tx", "_ty"], "left").groupBy(*keys, "_i").agg(_corr(F.col("s"), F.coalesce("_u", F.lit(0.0))).alias("_r"))
    even = F.col("_i") % 2 == 0
    score = corr.groupBy(*keys).agg((F.avg(F.when(even, F.col("_r"))) - F.avg(F.when(~even, F.col("_r")))).alias("score"))
    return score.join(scale, keys).select(*keys, "score", "scale", "phase")


def _corr(a: Column, b: Column) -> Column:
    """Correlation, null where one side does not vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def _nearest(c: Column) -> Column:
    return F.floor(c + 0.5 + 1e-9).cast("long")


def border_score(bins: DataFrame, keys, value, across: tuple[int, int], along: tuple[int, int], x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, coverage, distance, score) of bins above threshold: (coverage - distance) / (coverage + distance).

    Coverage is the largest share of a wall that one field touches; distance the mean distance to the nearest wall,
    weighted by the value and divided by half the shorter side.
    """
    (x0, x1), (y0, y1) = across, along
    wide, high = x1 - x0 + 1, y1 - y0 + 1
    at = labelled_bins(bins, keys, x, y)
    walls = [F.countDistinct(F.when(F.col(c) == v, F.col(o))) / n for c, v, o, n in ((x, x0, y, high), (x, x1, y, high), (y, y0, x, wide), (y, y1, x, wide))]
    touched = at.groupBy(*keys, "field").agg(F.greatest(*walls).alias("_c")).groupBy(*keys).agg(F.max("_c").alias("coverage"))
    near = F.least(F.col(x) - x0, x1 - F.col(x), F.col(y) - y0, y1 - F.col(y)) / ((min(wide, high) - 1) / 2)
    gap = bins.groupBy(*keys).agg((F.sum(near * F.col(value)) / F.sum(value)).alias("distance"))
    total = F.col("coverage") + F.col("distance")
    return touched.join(gap, keys).select(*keys, "coverage", "distance", F.when(total > 0, (F.col("coverage") - F.col("distance")) / total).alias("score"))


def grid_sweep(bins: DataFrame, keys, value, scales: int, angles: int, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, sc, an, mse): maps scaled to 0..1 against hexagonal patterns around their peak.

    Pattern sc has the scale 2 + sc / 2 bins, an the angle of 5 an degrees. The sweep multiplies bins by a constant number
    of rows; they are summed before the shuffle.
    """
    tops = bins.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(x)).alias("_x"), (-F.col(y)).alias("_y"))).alias("_p"), F.min(value).alias("_lo"))
    rows = bins.join(tops, keys) if keys else bins.crossJoin(F.broadcast(tops))  # without keys one row
    rows = rows.select(*keys, ((F.col(value) - F.col("_lo")) / (F.col(f"_p.{value}") - F.col("_lo"))).alias("_v"), (F.col(x) + F.col("_p._x")).alias("_dx"), (F.col(y) + F.col("_p._y")).alias("_dy"))
    rows = rows.withColumn("sc", F.explode(F.sequence(F.lit(0), F.lit(scales - 1)).cast("array<bigint>"))).withColumn("an", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)).cast("array<bigint>")))
    wave = 4 * pi / 3**0.5 / (2 + 0.5 * F.col("sc"))
    turn = lambda i: F.cos(wave * (F.col("_dx") * F.cos(F.col("an") * (pi / 36) + i * pi / 3) + F.col("_dy") * F.sin(F.col("an") * (pi / 36) + i * pi / 3)))
    gap = F.col("_v") - (turn(0) + turn(1) + turn(2) + 1.5) / 4.5
    return rows.groupBy(*keys, "sc", "an").agg(F.avg(gap * gap).alias("mse"))


def moments(points: DataFrame, keys, x, y) -> DataFrame:
    """(keys, n, mx, my, vx, vy, c, det): mean and covariance of the points of a cluster in a plane."""
    g = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    return g.withColumn("det", F.col("vx") * F.col("vy") - F.col("c") * F.col("c"))


def gaussian_divergence(m: DataFrame, keys, cluster) -> DataFrame:
    """(keys, a, b, kld): divergence of the Gaussian of cluster b from that of cluster a, pairs inside a key."""
    names = ["n", "mx", "my", "vx", "vy", "c", "det"]
    a = m.select(*keys, F.col(cluster).alias("a"), *names)
    b = m.select(*keys, F.col(cluster).alias("b"), *[F.col(n).alias(f"q{n}") for n in names])
    p = a.join(b, keys).filter("a <> b")
    dx, dy = F.col("qmx") - F.col("mx"), F.col("qmy") - F.col("my")
    trace = (F.col("qvy") * F.col("vx") + F.col("qvx") * F.col("vy") - 2 * F.col("qc") * F.col("c")) / F.col("qdet")
    square = (F.col("qvy") * dx * dx - 2 * F.col("qc") * dx * dy + F.col("qvx") * dy * dy) / F.col("qdet")
    return p.select(*keys, "a", "b", (0.5 * (trace + square - 2 + F.ln(F.col("qdet") / F.col("det")))).alias("kld"))


def sub_segments(samples: DataFrame, keys, along: Column, length: float, least: int) -> DataFrame:
    """(keys, sub, lo, hi, n): the sub-segments of each zone: pieces of `length` along its axis, of which those at the far end
    that hold under `least` samples together are part of the last one before them.

    Samples are counted by piece first; the window runs over pieces. A zone with too few samples is one sub-segment.
    """
    piece = F.floor(along / length).cast("long")
    by = samples.groupBy(*keys, piece.alias("_b")).agg(F.count("*").alias("_n"))
    behind = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_b")))
    last = by.withColumn("_behind", behind).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_behind") >= least, F.col("_b"))), F.min("_b")).alias("_last"), F.max("_b").alias("_end"))
    kept = F.least("_b", "_last")
    g = by.join(last, keys).groupBy(*keys, kept.alias("sub")).agg(F.sum("_n").alias("n"), F.first("_last").alias("_last"), F.first("_end").alias("_end"))
    return g.select(*keys, "sub", (F.col("sub") * length).alias("lo"), ((F.when(F.col("sub") == F.col("_last"), F.col("_end")).otherwise(F.col("sub")) + 1) * length).alias("hi"), "n")

"""Scores of rate maps: labelled fields, borders, grids, best hexagonal patterns, and all of them under shifts of the activity."""

from __future__ import annotations

from collections.abc import Iterator
from math import cos, pi, sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.digest import picks
from tracklane.functions.scalar import hash_pick
from tracklane.operators import replicates as V
from tracklane.operators.maps import dilated, field_mask, labelled_bins
from tracklane.operators.storage import cut


def labelled_fields(bins: DataFrame, keys, value, share: float, least: int, grow: bool = True, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, x, y, field): bins of fields, named by their first bin.

    Bins of at least `share` of their map's maximum are closed, grown by one bin (if asked for), joined over the eight
    neighbours and kept in fields of at least `least` bins. Bins that the map lacks belong to no field.
    """
    mask = field_mask(bins, keys, value, share, x, y)
    if grow:
        mask = dilated(mask, keys, x, y).join(bins.select(*keys, x, y), [*keys, x, y], "left_semi")
    at = labelled_bins(mask, keys, x, y)
    large = at.groupBy(*keys, "field").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return at.join(large, [*keys, "field"]).select(*keys, x, y, "field")


def field_table(bins: DataFrame, fields: DataFrame, keys, value, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, field, n, peak, cx, cy): size, largest value and centre of mass of each field."""
    v = F.col(value)
    g = fields.join(bins.select(*keys, x, y, value), [*keys, x, y]).groupBy(*keys, "field")
    centre = lambda c: F.sum(v * F.col(c)) / F.nullif(F.sum(v), F.lit(0.0))
    return g.agg(F.count("*").alias("n"), F.max(v).alias("peak"), centre(x).alias("cx"), centre(y).alias("cy"))


def wall_border_score(bins: DataFrame, fields: DataFrame, keys, value, across: tuple[int, int], along: tuple[int, int], width: int, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, coverage, distance, score) with score = (coverage - distance) / (coverage + distance).

    Coverage is the largest share of a wall's strip, `width` bins deep, that one field covers; distance the mean distance
    of field bins to the nearest wall, weighted by the value, 0 at a wall and 1 in the middle. Maps without a field have no row.
    """
    (x0, x1), (y0, y1) = across, along
    wide, high = x1 - x0 + 1, y1 - y0 + 1
    strips = ((F.col(x) > x1 - width, high), (F.col(y) > y1 - width, wide), (F.col(x) < x0 + width, high), (F.col(y) < y0 + width, wide))
    at = fields.join(bins.select(*keys, x, y, value), [*keys, x, y])
    covered = F.greatest(*[F.sum(F.when(inside, 1).otherwise(0)) / (length * width) for inside, length in strips])
    near = F.least(F.col(x) - x0, x1 - F.col(x), F.col(y) - y0, y1 - F.col(y)) / ((min(wide, high) - 1) // 2)
    g = at.groupBy(*keys, "field").agg(covered.alias("_c"), F.sum(near * F.col(value)).alias("_d"), F.sum(value).alias("_v"))
    g = g.groupBy(*keys).agg(F.max("_c").alias("coverage"), (F.sum("_d") / F.nullif(F.sum("_v"), F.lit(0.0))).alias("distance"))
    total = F.col("coverage") + F.col("distance")
    return g.select(*keys, "coverage", "distance", F.when(total > 0, (F.col("coverage") - F.col("distance")) / total).alias("score"))


def sharpened(bins: DataFrame, keys, value, centre: float = 0.5, slope: float = 10.0) -> DataFrame:
    """Values as a share of their map's maximum, through a sigmoid that lifts peaks from the ground."""
    top = bins.groupBy(*keys).agg(F.max(value).alias("_top")).filter("_top > 0")
    return bins.join(top, keys).withColumn(value, 1 / (1 + F.exp(-slope * (F.col(value) / F.col("_top") - centre)))).drop("_top")


# ---- shifts of whole series ----


def shifted_maps(samples: DataFrame, keys: list[str], order: list[str], value, reps: int, seed: int, least: int, block: int | None = None, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, rep, [part,] x, y, m): rate maps of the series with its values shifted around by a hashed number of samples.

    Replicate 0 is the real one. A shift changes no occupancy, so that is counted once, and samples of value 0 are not
    moved: what a replicate costs is its non-zero samples. Bins of under `least` samples have no rate. With `block` the
    series is parted into alternate blocks of so many samples, each part with a map of its own.
    """
    w = Window.partitionBy(*keys)
    parts = ["part"] if block else []
    d = samples.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    if block:
        d = d.withColumn("part", (F.floor(F.col("_i") / block) % 2).cast("int"))
    d = cut(d.select(*keys, *parts, x, y, F.col(value).cast("double").alias("_v"), "_i", "_n"))
    occupied = d.groupBy(*keys, *parts, x, y).agg(F.count("*").alias("_o")).filter(F.col("_o") >= least)
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep")
    by = F.when(F.col("rep") == 0, F.lit(0)).otherwise(hash_pick(F.concat_ws("|", F.lit(str(seed)), *keys, "rep"), F.col("_n")))
    moved = d.filter("_v <> 0").select(*keys, "_v", "_i", "_n", rep).select(*keys, "rep", "_v", F.pmod(F.col("_i") + by, F.col("_n")).cast("int").alias("_i"))
    sums = moved.join(d.select(*keys, *parts, x, y, "_i").hint("shuffle_hash"), [*keys, "_i"]).groupBy(*keys, "rep", *parts, x, y).agg(F.sum("_v").alias("_s"))
    at = [*keys, "rep", *parts, x, y]
    return occupied.select("*", rep).join(sums, at, "left").select(*at, (F.coalesce("_s", F.lit(0.0)) / F.col("_o")).alias("m"))


def dense_maps(maps: DataFrame, keys, value, across: tuple[int, int], along: tuple[int, int], out: str = "map", x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, map): one row for each map, its bins of the arena as an array, row by row (null where there is no bin)."""
    wide, high = across[1] - across[0] + 1, along[1] - along[0] + 1
    inside = F.col(x).between(*across) & F.col(y).between(*along)
    cell = ((F.col(y) - along[0]) * wide + F.col(x) - across[0]).cast("int")
    g = maps.filter(inside).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(cell, F.col(value)))).alias("_m"))  # the bins of one arena
    return g.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(wide * high - 1)), lambda i: F.col("_m")[i]).alias(out))


def _touching(mask: np.ndarray) -> np.ndarray:
    """Labels of the groups of touching cells (eight neighbours) of each map (k, h, w): the group's largest cell number + 1, 0 outside."""
    k, h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)))
        new = np.where(mask, np.max([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0), 0)
        if (new == label).all():
            return label
        label = new


def _around(mask: np.ndarray, every: bool) -> np.ndarray:
    """Cells of which any (or every) one of the nine around them is set; nothing is set outside."""
    k, h, w = mask.shape
    p = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    return (np.all if every else np.any)([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)


def border_scores(maps: np.ndarray, share: float, least: int, width: int) -> np.ndarray:
    """Border scores of maps (k, height, width; NaN for no bin): labelled_fields() and wall_border_score() of many maps at once."""
    k, h, w = maps.shape
    there = ~np.isnan(maps)
    v = np.where(there, maps, 0.0)
    top = np.where(there, maps, -np.inf).max(axis=(1, 2), keepdims=True)
    over = there & (v >= share * top)
    closed = _around(_around(np.pad(over, ((0, 0), (2, 2), (2, 2))), False), True)[:, 2:-2, 2:-2] & there
    label = _touching(_around(closed, False) & there)
    yy, xx = np.mgrid[:h, :w]
    near = np.minimum.reduce([xx, w - 1 - xx, yy, h - 1 - yy]) / ((min(w, h) - 1) // 2)
    strips = ((xx >= w - width, h), (yy >= h - width, w), (xx < width, h), (yy < width, w))
    out = np.full(k, np.nan)
    for m in range(k):
        best, weight, total = -1.0, 0.0, 0.0
        for f in np.unique(label[m][label[m] > 0]):
            field = label[m] == f
            if field.sum() >= least:
                best = max(best, *((field & s).sum() / (n * width) for s, n in strips))
                weight, total = weight + (v[m] * near)[field].sum(), total + v[m][field].sum()
        if best >= 0 and total > 0 and best + weight / total > 0:
            out[m] = (best - weight / total) / (best + weight / total)
    return out


def grid_scores(maps: np.ndarray, floor: float = 0.01, inner: float = 0.5, outer: float = 2.0, centre: float = 0.5, slope: float = 10.0) -> np.ndarray:
    """Grid scores of maps (k, height, width; NaN for no bin): sharpened() and maps.grid_score() of many maps at once."""
    k, h, w = maps.shape
    v = np.where(np.isnan(maps), -np.inf, maps)
    top = v.max(axis=(1, 2), keepdims=True)
    with np.errstate(all="ignore"):
        v = np.where(np.isnan(maps) | (top <= 0), 0.0, 1 / (1 + np.exp(-slope * (np.where(np.isnan(maps), 0, maps) / top - centre))))
    there = (~np.isnan(maps)).astype(float)
    full = (2 * h - 1, 2 * w - 1)
    size = (2 * h, 2 * w)

    def correlated(a: np.ndarray) -> np.ndarray:
        f = np.fft.rfft2(a, size)
        return np.roll(np.fft.irfft2(f * np.conj(f), size), (h - 1, w - 1), axis=(1, 2))[:, : full[0], : full[1]]

    ac, pairs = correlated(v), correlated(there) > 0.5
    dy, dx = np.mgrid[-(h - 1) : h, -(w - 1) : w]
    r = np.hypot(dx, dy)
    turned = [(np.floor(dx * cos(i * pi / 6) - dy * sin(i * pi / 6) + 0.5 + 1e-9).astype(int), np.floor(dx * sin(i * pi / 6) + dy * cos(i * pi / 6) + 0.5 + 1e-9).astype(int)) for i in range(1, 6)]
    p = np.pad(np.where(pairs, ac, -np.inf), ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    highest = np.max([p[:, i : i + full[0], j : j + full[1]] for i in range(3) for j in range(3)], axis=0)
    zero = ac[:, h - 1, w - 1]
    order = np.lexsort((dy.ravel(), dx.ravel(), (dx * dx + dy * dy).ravel()))
    out = np.full(k, np.nan)
    for m in range(k):
        tie = 1e-9 * max(zero[m], 1e-300)  # products are summed in another order than in Spark
        peak = pairs[m] & (ac[m] >= highest[m] - tie) & (ac[m] > floor * zero[m]) & (r > 0)
        six = order[peak.ravel()[order]][:6]
        if len(six) < 2:
            continue
        scale = r.ravel()[six].mean()
        ring = pairs[m] & (r >= inner * scale) & (r <= outer * scale)
        if not ring.any():
            continue
        rs = []
        for tx, ty in turned:
            x, y = tx[ring] + w - 1, ty[ring] + h - 1
            ok = (x >= 0) & (x < full[1]) & (y >= 0) & (y < full[0])
            other = np.where(ok, ac[m][np.where(ok, y, 0), np.where(ok, x, 0)] * pairs[m][np.where(ok, y, 0), np.where(ok, x, 0)], 0.0)
            a = ac[m][ring]
            spread = a.std() * other.std()
            rs.append(((a - a.mean()) * (other - other.mean())).mean() / spread if spread > 0 else np.nan)
        even, odd = [x for x in rs[1::2] if x == x], [x for x in rs[::2] if x == x]
        if even and odd:
            out[m] = np.mean(even) - np.mean(odd)
    return out


def scored_maps(dense: DataFrame, keys, across: tuple[int, int], along: tuple[int, int], share: float = 0.3, least: int = 4, width: int = 2, column: str = "map") -> DataFrame:
    """(keys, border, grid): scores of one map a row, a batch of maps at a time; null where a map has no score."""
    wide, high = across[1] - across[0] + 1, along[1] - along[0] + 1

    @F.pandas_udf("border double, grid double")
    def scores(maps: pd.Series) -> pd.DataFrame:
        m = np.array([np.array(x, dtype=float) for x in maps], dtype=float).reshape(-1, high, wide)
        told = pd.DataFrame({"border": border_scores(m, share, least, width), "grid": grid_scores(m)}).astype(object)
        return told.where(told.notna(), None)

    return dense.select(*keys, scores(column).alias("_s")).select(*keys, "_s.border", "_s.grid")


def significance(stats: DataFrame, keys, value, alpha: float = 0.02) -> DataFrame:
    """(keys, real, p, significant): where the real value (rep 0) stands among the replicates that have one; two-sided.

    Keys whose real map has no score, or no replicate with one, have no row.
    """
    real = stats.filter("rep = 0").select(*keys, F.col(value).alias("real")).filter("real is not null")
    p = stats.filter("rep > 0").filter(F.col(value).isNotNull()).join(real, keys).groupBy(*keys).agg(F.first("real").alias("real"), F.avg((F.col(value) >= F.col("real")).cast("double")).alias("p"))
    return p.withColumn("significant", (F.col("p") <= alpha / 2) | (F.col("p") >= 1 - alpha / 2))


def _shifts(unit, table: pa.Table, order: list[str], value: str, reps: int, seed: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """The unit's rows in order, its values and whether they are known, and (k, rows) the place that each row's value comes
    from, for the series as it is and then shifted around, some replicates at a time."""
    table = table.sort_by([(c, "ascending") for c in order])
    v, known = V.column(table, value)
    n = len(v)
    for part in V.some(range(reps + 1), n):
        by = np.zeros((len(part), 1), np.int64)
        later = range(max(part.start, 1), part.stop)
        by[len(part) - len(later) :] = picks(V.prefix(seed, unit), later, None, n)
        yield table, v, known, (np.arange(n) - by) % n


def _mean_maps(v: np.ndarray, known: np.ndarray, index: np.ndarray, cell: np.ndarray, cells: int, least: int) -> np.ndarray:
    """(k, cells): means of the values that each replicate has in a cell of `least` rows or more, else NaN; rows outside have cell -1."""
    at = np.flatnonzero(cell >= 0)
    flat = (np.arange(len(index))[:, None] * cells + cell[at]).ravel()
    total = lambda x: np.bincount(flat, x[index[:, at]].ravel(), minlength=len(index) * cells).reshape(len(index), cells)
    rows = np.bincount(cell[at], minlength=cells)
    count = np.broadcast_to(rows, (len(index), cells)) if known.all() else total(known.astype(float))
    with np.errstate(all="ignore"):
        return np.where((rows >= least) & (count > 0), total(v * known) / count, np.nan)


def _bins_of(table: pa.Table, x: str, y: str) -> tuple[np.ndarray, int]:
    (a, in_x), (b, in_y) = V.column(table, x), V.column(table, y)
    _, at = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    return np.where(in_x & in_y, at.ravel(), -1), int(at.max()) + 1


def _stabilities(v, known, index, cell, cells, least: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, r): bins of both and correlation of the maps of alternate blocks of each replicate."""
    part = np.arange(len(v)) // block % 2
    return V.paired_correlations(*(_mean_maps(v, known, index, np.where(part == k, cell, -1), cells, least) for k in (0, 1)))


def stability_tests(samples: DataFrame, key: str, order: list[str], value: str, reps: int, seed: int, least: int, block: int, alpha: float = 0.02, x: str = "xb", y: str = "yb") -> DataFrame:
    """(key, real, p, significant): correlation of the maps of alternate blocks against that of series shifted around.

    The maps of shifted_maps() and their comparison, all in the task of a unit. Replicates with three bins or more count; NaN
    is equal to itself and above all numbers.
    """

    def kernel(unit, table: pa.Table) -> list[dict]:
        n, r = V.joined(_stabilities(v, known, index, *_bins_of(t, x, y), least, block) for t, v, known, index in _shifts(unit, table, order, value, reps, seed))
        r = V.rounded(r, 9)
        others = r[1:][n[1:] >= 3]
        return [{"real": float(r[0]), "p": V.mean(V.at_least(others, r[0]))}] if n[0] >= 3 and len(others) else []

    out = V.per_unit(samples.select(key, *dict.fromkeys([*order, value, x, y])), key, kernel, real="double", p="double")
    return out.withColumn("significant", (F.col("p") <= alpha / 2) | (F.col("p") >= 1 - alpha / 2))


def map_tests(samples: DataFrame, key: str, order: list[str], value: str, reps: int, seed: int, least: int, block: int, across: tuple[int, int], along: tuple[int, int], share: float, field: int, width: int, alpha: float = 0.02, x: str = "xb", y: str = "yb") -> DataFrame:
    """(key, analysis, real, p, significant): border score, grid score and stability of a unit against series shifted around.

    As significance() of scored_maps() and of compared shifted_maps(), all in the task of a unit: scores that are unknown
    don't count, and an analysis whose real score is unknown has no row.
    """
    wide, high = across[1] - across[0] + 1, along[1] - along[0] + 1

    def scores(t, v, known, index) -> tuple:
        (a, in_x), (b, in_y) = V.column(t, x), V.column(t, y)
        inside = in_x & in_y & (a >= across[0]) & (a <= across[1]) & (b >= along[0]) & (b <= along[1])
        cell = np.where(inside, (b - along[0]) * wide + a - across[0], -1).astype(np.int64)
        maps = _mean_maps(v, known, index, cell, wide * high, least).reshape(-1, high, wide)
        empty = np.isnan(maps).all(axis=(1, 2))  # no map, no score
        border, grid = np.full(len(maps), np.nan), np.full(len(maps), np.nan)
        if not empty.all():
            border[~empty], grid[~empty] = border_scores(maps[~empty], share, field, width), grid_scores(maps[~empty])
        n, r = _stabilities(v, known, index, *_bins_of(t, x, y), least, block)
        return border, grid, np.where(n >= 3, r, np.nan)

    def kernel(unit, table: pa.Table) -> list[dict]:
        out = []
        for name, s in zip(("border", "grid", "stability"), V.joined(scores(*x) for x in _shifts(unit, table, order, value, reps, seed))):
            s = V.rounded(s, 9)
            others = s[1:][~np.isnan(s[1:])]
            if not np.isnan(s[0]) and len(others):
                out.append({"analysis": name, "real": float(s[0]), "p": V.mean(others >= s[0])})
        return out

    out = V.per_unit(samples.select(key, *dict.fromkeys([*order, value, x, y])), key, kernel, analysis="string", real="double", p="double")
    return out.withColumn("significant", (F.col("p") <= alpha / 2) | (F.col("p") >= 1 - alpha / 2))


# ---- best hexagonal pattern ----


def _pattern(wave: Column, angle: Column) -> Column:
    turn = lambda i: F.cos(wave * (F.col("_dx") * F.cos(angle + i * pi / 3) + F.col("_dy") * F.sin(angle + i * pi / 3)))
    return (turn(0) + turn(1) + turn(2) + 1.5) / 4.5


def grid_fit(bins: DataFrame, keys: list[str], value, scales: tuple[float, float, int], angles: int, rounds: int = 2, zoom: int = 4, x: str = "xb", y: str = "yb") -> DataFrame:
    """(keys, scale, angle, mse, r): the hexagonal pattern around the map's peak that is nearest to the map scaled to 0 .. 1.

    scales: first, step and number of the first sweep's scales, which has `angles` angles over 60 degrees. Each later round
    sweeps the neighbourhood of the best so far in steps `zoom` times as fine. Sweeps are rows, a constant number for each
    bin; the best of a key (ties by scale, then angle) is kept by an aggregate. r is the correlation with that pattern.
    """
    top = bins.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(x)).alias("_x"), (-F.col(y)).alias("_y"))).alias("_p"), F.min(value).alias("_lo")).filter(F.col(f"_p.{value}") > F.col("_lo"))
    rows = cut(bins.join(top, keys).select(*keys, ((F.col(value) - F.col("_lo")) / (F.col(f"_p.{value}") - F.col("_lo"))).alias("_v"), (F.col(x) + F.col("_p._x")).alias("_dx"), (F.col(y) + F.col("_p._y")).alias("_dy")))
    first, step, count = scales
    turn = pi / 3 / angles
    grid = [(F.lit(first + i * step), F.lit(j * turn)) for i in range(count) for j in range(angles)]
    best = None
    for n in range(rounds + 1):
        if n:
            step, turn = step / zoom, turn / zoom
            near = range(-zoom + 1, zoom)
            grid = [(F.col("scale") + i * step, F.col("angle") + j * turn) for i in near for j in near]
        at = rows if best is None else rows.join(best.select(*keys, "scale", "angle"), keys)
        tried = at.select(*keys, "_v", "_dx", "_dy", F.inline(F.array(*[F.struct(s.cast("double").alias("_s"), a.cast("double").alias("_a")) for s, a in grid])))
        gap = F.col("_v") - _pattern(4 * pi / 3**0.5 / F.col("_s"), F.col("_a"))
        errors = tried.groupBy(*keys, "_s", "_a").agg(F.avg(gap * gap).alias("mse"))
        order = F.struct(F.round("mse", 9), F.round("_s", 6), F.round("_a", 6))
        best = cut(errors.groupBy(*keys).agg(F.min_by(F.struct("_s", "_a", "mse"), order).alias("_b")).select(*keys, F.col("_b._s").alias("scale"), F.col("_b._a").alias("angle"), "_b.mse"))
    fit = rows.join(best, keys).withColumn("_f", _pattern(4 * pi / 3**0.5 / F.col("scale"), F.col("angle")))
    return best.join(fit.groupBy(*keys).agg(F.corr("_v", "_f").alias("r")), keys)

"""Grouped statistics in closed form; every one is a single shuffle on its keys unless it says otherwise."""

from __future__ import annotations

from functools import reduce
from math import log, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_performance(trials: DataFrame, keys) -> DataFrame:
    """Trial counts and shares correct: all, switch, valid switch, by cue. Unknown outcomes count in no average."""
    ratio = lambda c: F.sum(F.col("correct") * F.col(c)) / F.when(F.sum(c) != 0, F.sum(c))
    return trials.groupBy(*keys).agg(
        F.count("*").alias("n_trials"), F.sum("sw").alias("n_sw"), F.sum("vsw").alias("n_vsw"), F.avg("correct").alias("pct_correct"),
        ratio("sw").alias("pct_sw_correct"), ratio("vsw").alias("pct_vsw_correct"),
        F.avg(F.when(F.col("cue") == "L", F.col("correct"))).alias("pct_L_correct"), F.avg(F.when(F.col("cue") == "R", F.col("correct"))).alias("pct_R_correct"),
    )


def average_ranks(df: DataFrame, keys, value, out: str) -> DataFrame:
    """Appends the average rank of a value within its group; rows are counted by value, so that the window runs over distinct values."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    rank = F.sum("_k").over(Window.partitionBy(*keys).orderBy(value)) - (F.col("_k") - 1) / 2
    ranks = by.select(*keys, F.col(value).alias("_value"), rank.alias(out))
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys] + [F.col(f"_l.{value}").eqNullSafe(F.col("_r._value"))]
    return df.alias("_l").join(ranks.alias("_r"), on).select("_l.*", f"_r.{out}")


def pearson(df: DataFrame, keys, x, y) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, keys, x, y) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("r"), F.count("*").alias("n"))


def kendall(df: DataFrame, keys, item, x, y) -> DataFrame:
    """Tau-b by pairs inside a group; for groups of zones, not of samples."""
    a = df.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = df.select(*keys, F.col(item).alias("_j"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    p = a.join(b, keys).filter("_i < _j")
    sx, sy = F.signum(F.col("_x") - F.col("_u")), F.signum(F.col("_y") - F.col("_v"))
    g = p.groupBy(*keys).agg(F.sum(sx * sy).alias("_s"), F.sum(F.abs(sx)).alias("_nx"), F.sum(F.abs(sy)).alias("_ny"))
    return g.select(*keys, F.when((F.col("_nx") > 0) & (F.col("_ny") > 0), F.col("_s") / F.sqrt(F.col("_nx") * F.col("_ny"))).alias("tau"))


def kendall_of_pairs(df: DataFrame, keys, x, y) -> DataFrame:
    """(keys, n, tau): tau-b of the pairs of each group, for very many small groups (the zones of one replicate's maps).

    A group's pairs are one array, compared inside the expression: no row is made for two pairs.
    """
    g = df.dropna(subset=[x, y]).groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("_v"))
    step = "aggregate(slice(_v, i + 2, size(_v)), a, (t, w) -> named_struct('s', t.s + sign(_v[i].x - w.x) * sign(_v[i].y - w.y), 'p', t.p + abs(sign(_v[i].x - w.x)), 'q', t.q + abs(sign(_v[i].y - w.y))))"
    sums = F.expr(f"aggregate(sequence(0, size(_v) - 1), named_struct('s', 0D, 'p', 0D, 'q', 0D), (a, i) -> {step})")
    g = g.select(*keys, F.size("_v").cast("bigint").alias("n"), sums.alias("_t"))
    return g.select(*keys, "n", F.when((F.col("_t.p") > 0) & (F.col("_t.q") > 0), F.col("_t.s") / F.sqrt(F.col("_t.p") * F.col("_t.q"))).alias("tau"))


def combined_tail(h, n, most: int) -> Column:
    """Upper tail exp(-h) sum(h^k / k!) over k < n of chi squared 2 h with 2 n degrees of freedom, n at most `most`."""
    logs, total = [], 0.0
    for k in range(most):
        logs.append(total)
        total += log(k + 1)
    given = F.array(F.struct(F.col(h).alias("_h"), F.col(n).alias("n")))
    terms = F.transform(given, lambda v: F.aggregate(F.sequence(F.lit(0), v["n"].cast("int") - 1), F.lit(0.0), lambda a, k: a + F.exp(k * F.ln(F.greatest(v["_h"], F.lit(1e-300))) - v["_h"] - F.get(F.array(*[F.lit(x) for x in logs]), k))))
    return F.least(F.lit(1.0), terms[0])


def combined_p(df: DataFrame, keys, p, most: int) -> DataFrame:
    """(keys, n, chi2, p): Fisher's combination of the p-values of a group, of which there are at most `most`.

    The tail of chi squared with 2 n degrees of freedom is exp(-h) sum(h^k / k!) over k < n, h half of chi2; terms are formed
    in logarithms. p-values of 0 count as 1e-300.
    """
    g = df.filter(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(-F.ln(F.greatest(F.col(p), F.lit(1e-300)))).alias("_h"))
    return g.select(*keys, "n", (2 * F.col("_h")).alias("chi2"), combined_tail("_h", "n", most).alias("p"))


def mann_whitney(df: DataFrame, keys, value, first: Column) -> DataFrame:
    """U of the rows where `first` holds against the others, and z without tie correction.

    Rows are counted by value first, so that the window ranks distinct values only.
    """
    by = df.groupBy(*keys, value).agg(F.sum(F.when(first, 1).otherwise(0)).alias("_n1"), F.sum(F.when(first, 0).otherwise(1)).alias("_n2"))
    n = F.col("_n1") + F.col("_n2")
    rank = F.sum(n).over(Window.partitionBy(*keys).orderBy(value)) - (n - 1) / 2
    g = by.withColumn("_r", F.col("_n1") * rank).groupBy(*keys).agg(F.sum("_n1").alias("n1"), F.sum("_n2").alias("n2"), F.sum("_r").alias("_r1"))
    g = g.withColumn("u", F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return g.withColumn("z", F.when(sd > 0, (F.col("u") - F.col("n1") * F.col("n2") / 2) / sd)).drop("_r1")


def t_test(df: DataFrame, keys, value, first: Column, welch: bool = False) -> DataFrame:
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    g = df.groupBy(*keys).agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2"))
    if welch:
        sd = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    else:
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
        sd = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return g.withColumn("t", F.when(sd > 0, (F.col("m1") - F.col("m2")) / sd)).select(*keys, "n1", "n2", "t")


def circular(df: DataFrame, keys, angle, weight) -> DataFrame:
    """Weighted circular mean, resultant length, variance, standard deviation; Rayleigh z and p."""
    g = df.groupBy(*keys).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.cos(angle)).alias("c"), F.sum(F.col(weight) * F.sin(angle)).alias("s"))
    length = F.hypot("c", "s") / F.col("w")
    std = F.sqrt(-2 * F.ln(F.when(F.col("r") > 0, F.least("r", F.lit(1.0)))))
    big = F.col("w") * F.col("r")
    return (
        g.withColumn("r", length).withColumn("mean", F.pmod(F.atan2("s", "c"), F.lit(2 * pi))).withColumn("var", 1 - F.col("r")).withColumn("std", std)
        .withColumn("z", big * big / F.col("w")).withColumn("p", F.exp(F.sqrt(1 + 4 * F.col("w") + 4 * (F.col("w") * F.col("w") - big * big)) - (1 + 2 * F.col("w"))))
        .drop("c", "s")
    )


def binned_circular(df: DataFrame, keys, angle, weight, width: float | None = None, axial: int = 1) -> DataFrame:
    """(keys, r, mean, var, std) with the bias of bins of `width` radians taken out of r; axial data have their angles multiplied first.

    The mean stays in the multiplied angle, like the length.
    """
    g = circular(df.withColumn("_angle", F.col(angle) * axial), keys, "_angle", weight)
    r = F.col("r") * (width / 2 / sin(width / 2) if width else 1.0)
    return g.withColumn("r", r).select(*keys, "r", "mean", (1 - F.col("r")).alias("var"), F.sqrt(-2 * F.ln(F.when((F.col("r") > 0) & (F.col("r") <= 1), F.col("r")))).alias("std"))


def one_sample_t(df: DataFrame, keys, value, mean: float) -> DataFrame:
    """(keys, n, t) of the group's mean against a given one; t is null without spread."""
    sd = F.stddev_samp(value)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), ((F.avg(value) - mean) / F.when(sd > 0, sd / F.sqrt(F.count(value)))).alias("t"))


def median_of_counts(by: DataFrame, keys, value, count, out: str) -> DataFrame:
    """(keys, out): median of each group of (keys, value, count), the values of a group distinct and not null.

    A running count over the sorted values finds the middle: the sort spills, no group's values are held in memory.
    """
    w = Window.partitionBy(*keys)
    upto, n = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum(count).over(w)
    at = by.select(*keys, F.col(value).cast("double").alias("_v"), upto.alias("_upto"), n.alias("_n"))
    first = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    return at.groupBy(*keys).agg(((first(F.floor((F.col("_n") - 1) / 2)) + first(F.floor(F.col("_n") / 2))) / 2).alias(out))


def mad(df: DataFrame, keys, value) -> DataFrame:
    """Median and median absolute deviation of the values that aren't null; a group without any has no row.

    Rows are counted by value once, both medians read the counts.
    """
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_k"))
    med = median_of_counts(by, keys, "_value", "_k", "med")
    off = by.join(med, keys).groupBy(*keys, F.abs(F.col("_value") - F.col("med")).alias("_off")).agg(F.sum("_k").alias("_k"))
    return med.join(median_of_counts(off, keys, "_off", "_k", "mad"), keys).select(*keys, "med", "mad")


def exact_quantiles(df: DataFrame, value, parts: int, ranges: int = 200) -> list[float]:
    """The parts - 1 inner quantiles of a numeric column, interpolated between neighbours; empty without values.

    Values are counted, cut into ranges by approximate quantiles (the cuts decide only where the work is done), and a
    running count inside each range goes on from the total of the ranges below: no task sees all values. The driver reads
    the cuts and two values for each quantile.
    """
    by = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    cuts = sorted(set(by.approxQuantile("_v", [i / ranges for i in range(1, ranges)], 1 / (2 * ranges))))
    if not cuts:
        return []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("_v")))
    by = by.withColumn("_b", place)
    totals = by.groupBy("_b").agg(F.sum("_k").alias("_t"))
    below = totals.withColumn("_below", F.sum("_t").over(Window.orderBy("_b")) - F.col("_t"))  # a row for each range
    upto = F.sum("_k").over(Window.partitionBy("_b").orderBy("_v")) + F.col("_below")
    ranked = by.join(below.select("_b", "_below"), "_b").select("_v", upto.alias("_upto"))
    n = totals.agg(F.sum("_t")).first()[0]
    at = [(n - 1) * i / parts for i in range(1, parts)]
    wanted = sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at})
    found = ranked.agg(*[F.min(F.when(F.col("_upto") > k, F.col("_v"))).alias(f"_{k}") for k in wanted]).first()
    low_high = [(found[f"_{int(x)}"], found[f"_{min(int(x) + 1, n - 1)}"], x - int(x)) for x in at]
    return [a + (b - a) * share for a, b, share in low_high]


def spatial_information(df: DataFrame, keys, zone, rate, occupancy) -> DataFrame:
    """Sum of f log2(f / p) over zones, f and p the shares of rate and occupancy; zones without rate are skipped."""
    w = Window.partitionBy(*keys)
    share = df.withColumn("_f", F.col(rate) / F.sum(rate).over(w)).withColumn("_p", F.col(occupancy) / F.sum(occupancy).over(w))
    return share.groupBy(*keys).agg(F.sum(F.when((F.col("_f") > 0) & (F.col("_p") > 0), F.col("_f") * F.log2(F.col("_f") / F.col("_p")))).alias("info"))


def regression_metrics(df: DataFrame, keys, y, pred) -> DataFrame:
    """R2, MSE, RMSE, NRMSE, Poisson deviance and D2 in one pass over sums."""
    err = F.col(y) - F.col(pred)
    dev = F.when((F.col(pred) > 0) & (F.col(y) > 0), F.col(y) * F.ln(F.col(y) / F.col(pred)) - err).when(F.col(pred) > 0, F.col(pred)).otherwise(F.col(y))
    ylny = F.when(F.col(y) > 0, F.col(y) * F.ln(F.col(y))).otherwise(0.0)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(err * err).alias("sse"), F.var_pop(y).alias("vy"), F.avg(y).alias("my"), (2 * F.sum(dev)).alias("deviance"), F.sum(ylny).alias("sl"), F.sum(y).alias("sy"))
    null = 2 * (F.col("sl") - F.col("sy") * F.ln("my"))
    return g.select(
        *keys, "n", F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("n") * F.col("vy"))).alias("r2"), (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        F.when(F.col("my") != 0, F.sqrt(F.col("sse") / F.col("n")) / F.col("my")).alias("nrmse"), "deviance", F.when(null > 0, 1 - F.col("deviance") / null).alias("d2"),
    )


def adjusted_metrics(df: DataFrame, keys, y, pred, features: int) -> DataFrame:
    """(keys, n, adj_r2, adj_d2, chi2): R2 and D2 adjusted for the number of features, Pearson's chi squared of the predictions above 0."""
    err = F.col(y) - F.col(pred)
    chi2 = df.groupBy(*keys).agg(F.sum(F.when(F.col(pred) > 0, err * err / F.col(pred))).alias("chi2"))
    left = F.col("n") - features - 1
    adjust = lambda c: F.when(left > 0, 1 - (1 - F.col(c)) * (F.col("n") - 1) / left)
    return regression_metrics(df, keys, y, pred).select(*keys, "n", adjust("r2").alias("adj_r2"), adjust("d2").alias("adj_d2")).join(chi2, keys)


def log_loss(df: DataFrame, keys, y, probabilities: dict) -> DataFrame:
    """(keys, n, loss, chance, score): mean -ln of the true class's probability, entropy of the class shares, 1 - loss / chance.

    `probabilities` names the column of each class; probabilities are clipped to 1e-10 .. 1 - 1e-10.
    """
    p = F.coalesce(*[F.when(F.col(y) == c, F.col(name)) for c, name in probabilities.items()])
    by = df.withColumn("_l", -F.ln(F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10)))).groupBy(*keys, y).agg(F.sum("_l").alias("_l"), F.count("*").alias("_n"))
    g = by.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_l").alias("_l"), F.sum(F.col("_n") * F.ln("_n")).alias("_h"))
    loss, chance = F.col("_l") / F.col("n"), F.ln("n") - F.col("_h") / F.col("n")
    return g.select(*keys, "n", loss.alias("loss"), chance.alias("chance"), F.when(chance > 0, 1 - loss / chance).alias("score"))


def auc_one_vs_one(df: DataFrame, keys, y, probabilities: dict) -> DataFrame:
    """(keys, auc): mean over ordered pairs of classes (a, b) of the area under the curve of a's probability among rows of a and b.

    Rows are counted by probability first; the window runs over distinct values of a pair. Pairs without rows of both
    classes are left out.
    """
    classes = list(probabilities)
    pairs = [F.when(F.col(y).isin(a, b), F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.col(probabilities[a]).alias("_p"))) for a in classes for b in classes if a != b]
    rows = df.select(*keys, F.col(y).alias("_y"), F.inline(F.array_compact(F.array(*pairs))))
    own = (F.col("_y") == F.col("_a")).cast("long")
    by = rows.groupBy(*keys, "_a", "_b", "_p").agg(F.sum(own).alias("_pos"), F.sum(1 - own).alias("_neg"))
    below = F.sum("_neg").over(Window.partitionBy(*keys, "_a", "_b").orderBy("_p")) - F.col("_neg") / 2
    area = by.withColumn("_won", F.col("_pos") * below).groupBy(*keys, "_a", "_b").agg((F.sum("_won") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("_auc"))
    return area.groupBy(*keys).agg(F.avg("_auc").alias("auc"))


def bin_encoding(df: DataFrame, keys, fold, bin_, value) -> DataFrame:
    """(keys, fold, n, mse, deviance, coef) of one-hot models fitted on the other folds and scored on their own.

    The least-squares coefficient of a bin is its mean there and the Poisson coefficient the mean's logarithm (coef is
    their average over the rows); deviance is Poisson's. Rows whose bin the other folds lack are not scored. Totals less
    those of the fold: no row is copied for each fold.
    """
    per = df.groupBy(*keys, bin_, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    tot = per.groupBy(*keys, bin_).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    rest = F.col("_tn") - F.col("_n")
    model = per.join(tot, [*keys, bin_]).filter(rest > 0).select(*keys, bin_, fold, ((F.col("_ts") - F.col("_s")) / rest).alias("_m"))
    y, m = F.col(value), F.col("_m")
    dev = F.when((m > 0) & (y > 0), y * F.ln(y / m) - (y - m)).when(m > 0, m).otherwise(y)
    scored = df.join(model, [*keys, bin_, fold]).groupBy(*keys, fold)
    return scored.agg(F.count("*").alias("n"), F.avg((y - m) * (y - m)).alias("mse"), (2 * F.sum(dev)).alias("deviance"), F.avg(F.ln(F.when(m > 0, m))).alias("coef"))


def weighted_levels(df: DataFrame, keys, level, total, count, least: int) -> DataFrame:
    """Rolls sums and counts up to a coarser zone; null where there are fewer than `least` samples."""
    g = df.groupBy(*keys, level).agg(F.sum(total).alias("s"), F.sum(count).alias("n"))
    return g.select(*keys, level, "n", F.when(F.col("n") >= least, F.col("s") / F.col("n")).alias("m"))


def quantile_groups(df: DataFrame, value, parts: int, out: str) -> DataFrame:
    """Appends the quantile group (0 ..) of a value: how many of the exact quantiles it exceeds; nulls exceed none."""
    above = [F.when(F.col(value) > e, 1).otherwise(0) for e in exact_quantiles(df, value, parts)]
    return df.withColumn(out, sum(above, F.lit(0)).cast("long"))


def kolmogorov_smirnov(df: DataFrame, keys, value, first: Column) -> DataFrame:
    """Largest distance of the two empirical distributions within each group."""
    d = df.withColumn("_a", F.when(first, 1).otherwise(0))
    by = d.groupBy(*keys, value).agg(F.sum("_a").alias("_n1"), F.sum(1 - F.col("_a")).alias("_n2"))
    w, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(value)
    f1, f2 = F.sum("_n1").over(run) / F.sum("_n1").over(w), F.sum("_n2").over(run) / F.sum("_n2").over(w)
    return by.withColumn("_d", F.abs(f1 - f2)).groupBy(*keys).agg(F.max("_d").alias("ks"))


def pivot_mean(df: DataFrame, keys, names: list[str], value, wanted: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(F.concat_ws("-", *names) if len(names) > 1 else names[0], wanted).agg(F.avg(value))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def benjamini_hochberg(df: DataFrame, keys, p) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values within each family."""
    w = Window.partitionBy(*keys)
    m = F.count("*").over(w)
    d = df.withColumn("_m", m).withColumn("_k", F.row_number().over(w.orderBy(p)))
    up = w.orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    down = w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1.0)
    return d.withColumns({
        "bonferroni": F.least(one, F.col(p) * F.col("_m")), "holm": F.least(one, F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(down)), "bh": F.least(one, F.min(F.col(p) * F.col("_m") / F.col("_k")).over(up)),
    }).drop("_m", "_k")

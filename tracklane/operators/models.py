"""Models over many units at once: Poisson regression, decoders by fold, reduction and choice of a cluster count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.storage import cut

#: Metrics by name, as aggregates of truth and prediction.
METRICS = {
    "mse": lambda y, p: F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))),
    "mae": lambda y, p: F.avg(F.abs(F.col(y) - F.col(p))),
    "corr": lambda y, p: F.corr(y, p),
    "bias": lambda y, p: F.avg(F.col(p) - F.col(y)),
}
#: Statistics of one column by name, for resampling tests.
STATISTICS = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "max": F.max}


def metrics(df: DataFrame, keys, y: str, pred: str, names: list[str]) -> DataFrame:
    """One grouped pass gives all named metrics; an unknown name is a KeyError."""
    return df.groupBy(*keys).agg(*[METRICS[n](y, pred).alias(n) for n in names])


def poisson_regression(df: DataFrame, keys: list[str], y: str, features: list[str], rounds: int = 6, ridge: float = 1e-6) -> DataFrame:
    """(keys, coef): log-linear Poisson coefficients, intercept first, of every group at once.

    A round of reweighted least squares is one grouped aggregate of p(p+1)/2 + p sums with map-side combining; only the
    small systems are solved in Python. The start is the logarithm of the mean; groups without a positive mean are left out.
    Rows with a null in a feature or in y are ignored. ridge keeps constant features solvable.
    """
    p = len(features) + 1
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{i + 1}") for i, f in enumerate(features)]).dropna(subset=["_y", *[f"_x{i + 1}" for i in range(p - 1)]])
    rows = rows.withColumn("_x0", F.lit(1.0))
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(a, b):
            m = np.zeros((p, p))
            for (i, j), x in zip(upper, u):
                m[i, j] = m[j, i] = x
            out.append(np.linalg.solve(m + ridge * np.eye(p), np.asarray(v, dtype=float)).tolist())
        return pd.Series(out)

    coef = rows.groupBy(*keys).agg(F.avg("_y").alias("_m")).filter("_m > 0").select(*keys, F.array(F.ln("_m"), *[F.lit(0.0)] * (p - 1)).alias("coef"))
    for _ in range(rounds):
        eta = sum((F.get("coef", F.lit(i)) * F.col(f"_x{i}") for i in range(1, p)), F.get("coef", F.lit(0)))
        at = rows.join(coef, keys).withColumn("_eta", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))).withColumn("_mu", F.exp("_eta"))
        z = F.col("_mu") * F.col("_eta") + F.col("_y") - F.col("_mu")
        sums = at.groupBy(*keys).agg(F.array(*[F.sum(F.col("_mu") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in upper]).alias("a"), F.array(*[F.sum(z * F.col(f"_x{i}")) for i in range(p)]).alias("b"))
        coef = cut(sums.select(*keys, solved("a", "b").alias("coef")))
    return coef


def balanced(df: DataFrame, keys: list[str], label: str, out: str) -> DataFrame:
    """Appends n / (classes * n of the class) within keys; the class counts are one row for each key and class."""
    by = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    total = by.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = by.join(total, keys) if keys else by.crossJoin(total)
    return df.join(weights.select(*keys, label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(out)), [*keys, label])


def cross_validated(df: DataFrame, fold: str, folds: int, estimator) -> DataFrame:
    """Rows of df with the columns that `estimator`, fitted on the other folds, adds to the rows of each fold."""
    parts = [estimator.fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decoders(df: DataFrame, label: str, fold: str, folds: int, experiments: dict[str, list[str]], reg: float = 0.01) -> DataFrame:
    """(rows of df, experiment, prediction, p): multinomial logistic decoders with balanced class weights.

    The label is a class number from 0. The driver loops over experiments and folds only; every fit is distributed.
    """
    base = cut(balanced(df, [fold], label, "_w").withColumn(label, F.col(label).cast("double")))  # read by every fit
    out = None
    for name, features in experiments.items():
        rows = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip").transform(base)
        model = LogisticRegression(featuresCol="_f", labelCol=label, weightCol="_w", family="multinomial", regParam=reg, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="prediction")
        got = cross_validated(rows, fold, folds, model).withColumn("p", F.array_max(vector_to_array("_p"))).withColumn("experiment", F.lit(name))
        got = got.select(*df.columns, "experiment", "prediction", "p")
        out = got if out is None else out.unionByName(got)
    return out


def reduced(df: DataFrame, vector: str, k: int, out: str) -> DataFrame:
    """Appends the first k principal components of an array column; each has its largest loading positive."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.argmax(np.abs(loads[:, i])), i] >= 0 else -1.0 for i in range(k)]
    return model.transform(rows).withColumn(out, F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(s) for s in signs]), lambda a, b: a * b)).drop("_v", "_pc")


def cluster_errors(df: DataFrame, point: str, fold: str, folds: int, counts: range, seed: int = 7) -> DataFrame:
    """(k, fold, n, error): mean squared distance of held-out points to the nearest of k centres fitted on the others."""
    rows = df.withColumn("_v", array_to_vector(point))
    out = None
    for k in counts:
        for f in range(folds):
            model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows.filter(F.col(fold) != f))
            centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
            gap = F.aggregate(F.zip_with(F.col(point), F.get(centres, F.col("_c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
            got = model.transform(rows.filter(F.col(fold) == f)).agg(F.count("*").alias("n"), F.avg(gap).alias("error")).select(F.lit(k).cast("long").alias("k"), F.lit(f).cast("long").alias("fold"), "n", "error")
            out = got if out is None else out.unionByName(got)
    return out


def repeated_clusterings(df: DataFrame, item: str, point: str, dims: int, repeats: int, folds: int, counts: list[int], rounds: int = 8) -> DataFrame:
    """(method, repeat, k, fold, split, n, mse, cosine): how well k clusters fitted on the other folds describe training and held-out points.

    Folds are dealt anew for each repeat by a hash of item. "kmeans": all repeats, folds and counts advance together; a round
    is one grouped aggregate over points and experiments, from k training points of the smallest hash. "bisecting" is
    Spark's estimator, a fit for each. mse: mean squared distance to the nearest centre; cosine: mean cosine distance to it.
    """
    at = lambda v: [F.get(v, F.lit(i)) for i in range(dims)]
    gap = lambda a, b: sum(((x - y) * (x - y) for x, y in zip(at(a), at(b))), F.lit(0.0))
    size = lambda a: F.sqrt(sum((x * x for x in at(a)), F.lit(0.0)))
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    points = df.select(F.col(item).alias("_id"), F.col(point).alias("_v"), repeat).withColumn("_own", F.pmod(F.xxhash64("_id", "repeat"), F.lit(folds)).cast("int"))
    points = cut(points)
    rows = points.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts])))
    keys = ["repeat", "fold", "k"]
    train = rows.filter("_own <> fold")
    # the k smallest of a bounded heap a group: max(counts) rows each
    start = points.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("_own <> fold").withColumn("_h", F.xxhash64("_id", "repeat", "fold"))
    start = start.withColumn("_r", F.row_number().over(Window.partitionBy("repeat", "fold").orderBy("_h", "_id"))).filter(F.col("_r") <= max(counts))
    start = start.withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts]))).filter("_r <= k")
    centres = cut(start.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("_c")))
    nearest = lambda: F.array_min(F.transform("_c", lambda c, i: F.struct(F.round(gap(F.col("_v"), c), 12).alias("d"), i.alias("i"))))
    for _ in range(rounds):
        own = train.join(F.broadcast(centres), keys).withColumn("_i", nearest()["i"])  # repeats x folds x counts rows of k centres
        means = own.groupBy(*keys, "_i").agg(F.array(*[F.avg(F.get("_v", F.lit(i))) for i in range(dims)]).alias("_m"))
        moved = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_m"))).alias("_new"))
        centres = cut(centres.join(moved, keys).select(*keys, F.transform("_c", lambda c, i: F.coalesce(F.col("_new")[i], c)).alias("_c")))

    def described(scored: DataFrame, by: list[str]) -> DataFrame:
        near = scored.withColumn("_b", nearest()).withColumn("_a", F.get("_c", F.col("_b.i")))
        cosine = 1 - sum((x * y for x, y in zip(at("_v"), at("_a"))), F.lit(0.0)) / F.nullif(size("_v") * size("_a"), F.lit(0.0))
        split = F.when(F.col("_own") == F.col("fold"), F.lit("test")).otherwise(F.lit("train"))
        return near.groupBy(*by, split.alias("split")).agg(F.count("*").alias("n"), F.avg("_b.d").alias("mse"), F.avg(cosine).alias("cosine"))

    out = described(rows.join(F.broadcast(centres), keys), keys).withColumn("method", F.lit("kmeans"))
    fits = []
    vectors = points.withColumn("_x", array_to_vector("_v"))
    for r in range(repeats):
        for f in range(folds):
            part = vectors.filter((F.col("repeat") == r) & (F.col("_own") != f)).cache()
            for k in counts:
                model = BisectingKMeans(k=k, seed=7, featuresCol="_x", predictionCol="_p").fit(part)
                fits.append((r, f, k, [[float(x) for x in c] for c in model.clusterCenters()]))
            part.unpersist()
    halves = df.sparkSession.createDataFrame(fits, "repeat int, fold int, k int, _c array<array<double>>")
    out = out.unionByName(described(rows.join(F.broadcast(halves), keys), keys).withColumn("method", F.lit("bisecting")))
    return out.select("method", *keys, "split", "n", "mse", "cosine")

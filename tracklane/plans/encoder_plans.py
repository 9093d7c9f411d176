"""Encoders and decoders by fold: scores, coefficients, elastic nets on position components, stacked decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import encoding as E
from tracklane.operators import storage
from tracklane.plans.contrast_plans import BINS, _bins
from tracklane.plans.model_plans import LAGGED, LAGS, _beside
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, activity

R = lambda c: F.round(c, 6)
R5 = lambda c: F.round(c, 5)
FOLDS = 5

GRID = LAGGED.replace("SELECT u, fr, st,", "SELECT tr, u, fr, st,") + f", e AS (SELECT u, lag, tr%{FOLDS} AS fold, fr, UNNEST(['zone','zone x outcome']) AS variant, UNNEST([zone, zone || ':' || st]) AS f FROM v WHERE zone IS NOT NULL), k AS (SELECT UNNEST(range(0,{FOLDS})) AS fold), c AS (SELECT e.u, lag, variant, f, k.fold, AVG(fr) AS coef FROM e JOIN k ON e.fold<>k.fold GROUP BY 1,2,3,4,5)"


def _folded(spark, d):
    return _beside(spark, d).withColumn("fold", F.col("tr") % FOLDS)


_SCORE = "COUNT(*) AS n, ROUND(CASE WHEN VAR_POP(fr)>1e-9*AVG(fr*fr) THEN 1-SUM((fr-coef)*(fr-coef))/(COUNT(*)*VAR_POP(fr)) END,5) AS r2, ROUND(SQRT(AVG((fr-coef)*(fr-coef))),5) AS rmse"


@query("j7_encoder_scores", f"WITH {ACT}, {GRID} SELECT e.u, e.lag, e.variant, c.fold, CASE WHEN e.fold=c.fold THEN 'test' ELSE 'train' END AS split, {_SCORE} FROM e JOIN c ON e.u=c.u AND e.lag=c.lag AND e.variant=c.variant AND e.f=c.f GROUP BY 1,2,3,4,5")
def j7_scores(spark, d):
    """Training and held-out scores of every unit, lag, feature set and fold; all from sums by feature and fold."""
    g = E.unit_encoder_scores(_folded(spark, d), "u", "fold", "fr", LAGS, "st", FOLDS)
    return g.select("u", "lag", "variant", "fold", "split", "n", R5("r2").alias("r2"), R5("rmse").alias("rmse"))


@query("j7_encoder_coefs", f"WITH {ACT}, {GRID} SELECT u, lag, variant, f, COUNT(*) AS folds, ROUND(AVG(coef),6) AS coef, ROUND(STDDEV_POP(coef),6) AS sd FROM c GROUP BY 1,2,3,4")
def j7_coefs(spark, d):
    """Coefficients averaged over the folds that have one, and their spread."""
    g = E.unit_encoder_coefficients(_folded(spark, d), "u", "fold", "fr", LAGS, "st", FOLDS)
    return g.select("u", "lag", "variant", "f", "folds", R("coef").alias("coef"), R("sd").alias("sd"))


@query("j4_feature_covariance", f"WITH {ACT}, {BINS}, b AS (SELECT a.xb, a.yb, a.n, c.xb AS cx, c.yb AS cy, EXP(-((a.xb-c.xb)*(a.xb-c.xb)+(a.yb-c.yb)*(a.yb-c.yb))/2.0) AS w FROM g a JOIN g c ON ABS(a.xb-c.xb)<=2 AND ABS(a.yb-c.yb)<=2) SELECT p.cx AS ax, p.cy AS ay, q.cx AS bx, q.cy AS by, ROUND(SUM(p.n*p.w*q.w)/(SELECT SUM(n) FROM g),9) AS m FROM b p JOIN b q ON p.xb=q.xb AND p.yb=q.yb GROUP BY 1,2,3,4")
def j4_covariance(spark, d):
    """Mean products of the Gaussian bumps of two bins over all samples."""
    bins = _bins(spark, d).withColumn("arena", F.lit(0))
    return E.feature_moments(bins, E.position_bumps(bins, ["arena"], 2, 1.0), ["arena"], "n").select("ax", "ay", "bx", "by", F.round("m", 9).alias("m"))


COMPONENTS = 6


def _components(spark, d):
    return E.position_components(_bins(spark, d).withColumn("arena", F.lit(0)), ["arena"], "n", COMPONENTS)


@query("j4_position_components")
def j4_components(spark, d):
    """The first components of the position features of each bin."""
    _, pc = _components(spark, d)
    return pc.select("xb", "yb", *[R(F.get("pc", F.lit(i))).alias(f"pc{i + 1}") for i in range(COMPONENTS)])


def _encoded(spark, d):
    """Elastic nets of every unit's activity on position components, and the loadings."""
    loads, pc = _components(spark, d)
    a = activity(spark, d).select("u", (F.col("tr") % FOLDS).alias("fold"), "fr", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb"))
    a = a.join(pc.select("xb", "yb", *[F.get("pc", F.lit(i)).alias(f"f{i}") for i in range(COMPONENTS)]), ["xb", "yb"])
    return E.elastic_net(a, ["u"], "fold", "fr", [f"f{i}" for i in range(COMPONENTS)]), loads


@query("j3_elastic_net")
def j3_net(spark, d):
    """Coefficients and scores of every unit and fold."""
    net, _ = _encoded(spark, d)
    return net.select("u", "fold", "n", R("intercept").alias("intercept"), *[R(F.get("coef", F.lit(i))).alias(f"c{i + 1}") for i in range(COMPONENTS)], R5("train_r2").alias("train_r2"), R5("test_r2").alias("test_r2"), R5("test_rmse").alias("test_rmse"))


@query("j3_encoding_maps")
def j3_maps(spark, d):
    """Coefficients of the elastic nets mapped back from components to bins, averaged over folds."""
    net, loads = _encoded(spark, d)
    mean = net.groupBy("u").agg(*[F.avg(F.get("coef", F.lit(i))).alias(f"c{i}") for i in range(COMPONENTS)])
    at = loads.select(F.col("cx").alias("xb"), F.col("cy").alias("yb"), "load")
    back = sum((F.col(f"c{i}") * F.get("load", F.lit(i)) for i in range(1, COMPONENTS)), F.col("c0") * F.get("load", F.lit(0)))
    # every unit has every bin of the arena, a fixed number
    return mean.withColumn("bins", F.lit(0)).join(at.withColumn("bins", F.lit(0)), "bins").select("u", "xb", "yb", R(back).alias("coef"))


DECODER_FOLDS = 3


def _stacked(spark, d):
    a = activity(spark, d).select("tr", "ln", "u", "st", "cond", (F.col("tr") % DECODER_FOLDS).alias("fold"), F.substring("z", 7, 1).alias("zone"), (F.col("fr") / 50).alias("fr"))
    return E.stacked_predictions(a, ["u"], "fold", "zone", "fr", DECODER_FOLDS)


@query("j5_stacked_features", f"WITH {ACT}, a AS (SELECT tr, ln, u, SUBSTR(z,7,1) AS zone, tr%{DECODER_FOLDS} AS fold, fr/50 AS fr FROM act), k AS (SELECT i AS outer_fold, j AS fold FROM range(0,{DECODER_FOLDS}) x(i), range(0,{DECODER_FOLDS}) y(j)), c AS (SELECT a.u, a.zone, k.outer_fold, k.fold, AVG(fr) AS m FROM a JOIN k ON a.fold<>k.outer_fold AND a.fold<>k.fold GROUP BY 1,2,3,4), b AS (SELECT a.u, k.outer_fold, k.fold, AVG(fr) AS m FROM a JOIN k ON a.fold<>k.outer_fold AND a.fold<>k.fold GROUP BY 1,2,3), r AS (SELECT a.u, k.outer_fold, a.fold, a.fr, COALESCE(c.m,b.m) AS pred FROM a JOIN k ON a.fold=k.fold LEFT JOIN c ON c.u=a.u AND c.zone=a.zone AND c.outer_fold=k.outer_fold AND c.fold=a.fold LEFT JOIN b ON b.u=a.u AND b.outer_fold=k.outer_fold AND b.fold=a.fold) SELECT u, outer_fold AS \"outer\", fold, COUNT(*) AS n, ROUND(AVG(pred),6) AS pred, ROUND(AVG((fr-pred)*(fr-pred)),6) AS mse FROM r GROUP BY 1,2,3")
def j5_features(spark, d):
    """Held-out predictions of zone encoders for each outer fold: rows, mean prediction, mean squared residual."""
    return _stacked(spark, d).groupBy("u", "outer", "fold").agg(F.count("*").alias("n"), R(F.avg("pred")).alias("pred"), R(F.avg(F.col("resid") * F.col("resid"))).alias("mse"))


@query("j5_target_decoders")
def j5_targets(spark, d):
    """Five targets decoded from activity, from encoders' held-out predictions and from their residuals; scores by fold.

    zone: first digit of the zone; cue, goal: of the condition; decision: way out or back; reward: the outcome.
    """
    targets = {"zone": (F.col("zone").cast("int") - 1, 5), "cue": ((F.col("cond") >= "3").cast("int"), 2), "decision": ((F.col("ln") > 3).cast("int"), 2), "reward": ((F.col("st") == "F").cast("int"), 2), "goal": (F.substring("cond", 1, 1).cast("int") - 1, 5)}
    rows = _stacked(spark, d).filter("pred is not null").select("outer", "fold", "fr", "pred", "resid", *[y.alias(f"y_{t}") for t, (y, _) in targets.items()])
    by = E.decoded_scores(storage.cut(rows), "outer", "fold", {t: (f"y_{t}", k) for t, (_, k) in targets.items()}, {"activity": "fr", "encoder": "pred", "residual": "resid"})
    g = by.groupBy("target", "features", "fold").agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("acc"), F.avg(F.col("ok") / F.col("n")).alias("bacc"), (F.sum("loss") / F.sum("n")).alias("loss"))
    return g.select("target", "features", "fold", "n", *[F.round(c, 4).alias(c) for c in ("acc", "bacc", "loss")])

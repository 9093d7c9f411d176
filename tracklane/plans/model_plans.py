"""Models, decoders, cluster selection, spatial scores, stored results and exports."""

from __future__ import annotations

import uuid
from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import models as P
from tracklane.operators import replicates as V
from tracklane.operators import storage
from tracklane.plans.contrast_plans import BINS, REPS, _bins
from tracklane.plans.event_plans import TRIALS, _trials
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, EV, TRK, activity, events, read, tracking

R = lambda c: F.round(c, 6)


@query("a8_unit_tables", f"WITH {EV} SELECT s, {', '.join(f'COUNT(CASE WHEN id%4={i} THEN 1 END) AS tt{i}' for i in range(4))} FROM ev GROUP BY s")
def a8(spark, d):
    tt = F.concat(F.lit("tt"), (F.col("id") % 4).cast("string"))
    return events(spark, d).select("s", tt.alias("tt")).groupBy("s").pivot("tt", [f"tt{i}" for i in range(4)]).agg(F.count(F.lit(1))).na.fill(0)


@query("a9_stored_rates", f"WITH {ACT} SELECT u, z, COUNT(*) AS n, ROUND(AVG(fr),6) AS m FROM act WHERE fr>=5 GROUP BY u, z")
def a9(spark, d):
    """Zone rates stored under the parameters that differ from the defaults; asked for twice, written once."""

    def rates(least, digits):
        return activity(spark, d).filter(F.col("fr") >= least).groupBy("u", "z").agg(F.count("*").alias("n"), F.round(F.avg("fr"), digits).alias("m"))

    where = f"{storage.root(spark)}/results-{uuid.uuid4().hex}"
    ask = lambda: storage.materialized(rates, spark, where, "zone_rates", {"least": 5}, {"least": 1, "digits": 6})
    ask()
    return ask()


@query("a10_exported_tables", f"WITH {TRIALS}, trk{TRK.split(', trk', 1)[1]} SELECT 'events' AS name, s, COUNT(*) AS n FROM ev GROUP BY s UNION ALL SELECT 'track', s, COUNT(*) FROM trk GROUP BY s UNION ALL SELECT 'trials', s, COUNT(*) FROM trials GROUP BY s")
def a10(spark, d):
    """Rows of each exported table and session, counted in the written files."""
    tables = {"events": events(spark, d), "track": tracking(spark, d), "trials": _trials(spark, d)}
    back = storage.exported(tables, f"{storage.root(spark)}/export-{uuid.uuid4().hex}", "s")
    counts = [t.groupBy(F.col("s").cast("long").alias("s")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "s", "n") for name, t in back.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("a11_metadata_tables", f"WITH {TRIALS}, e AS (SELECT s, COUNT(*) AS n_events, MIN(t) AS t0, MAX(t) AS t1 FROM ev GROUP BY s), p AS (SELECT s, COUNT(*) AS n_trials, AVG(correct) AS c FROM trials GROUP BY s) SELECT e.s, n_events, ROUND(t1-t0,4) AS dur, COALESCE(n_trials,0) AS n_trials, ROUND(c,6) AS pct_correct FROM e LEFT JOIN p ON e.s=p.s")
def a11(spark, d):
    e = events(spark, d).groupBy("s").agg(F.count("*").alias("n_events"), F.round(F.max("t") - F.min("t"), 4).alias("dur"))
    p = _trials(spark, d).groupBy("s").agg(F.count("*").alias("n_trials"), R(F.avg("correct")).alias("pct_correct"))
    return e.join(p, "s", "left").select("s", "n_events", "dur", F.coalesce("n_trials", F.lit(0)).alias("n_trials"), "pct_correct")


@query("j3_poisson_models")
def j3(spark, d):
    """Poisson coefficients of activity on position and line, for every unit."""
    a = activity(spark, d).withColumn("xs", F.col("x") / 50000).withColumn("ls", F.col("ln") / 4)
    c = P.poisson_regression(a, ["u"], "fr", ["xs", "ls"])
    return c.select("u", *[R(F.get("coef", F.lit(i))).alias(n) for i, n in enumerate(("b0", "bx", "bl"))])


def _decoding(spark, d):
    cls = F.when(F.col("st") == "F", 0).when(F.col("st") == "O", 1).otherwise(2)
    return activity(spark, d).select("tr", "ln", "u", cls.alias("y"), F.col("fr") / 50, F.col("x") / 50000, F.col("ln") / 4, F.pmod(F.xxhash64("tr"), F.lit(3)).alias("fold")).toDF("tr", "ln", "u", "y", "f_rate", "f_x", "f_line", "fold")


@query("j5_outcome_decoder")
def j5(spark, d):
    """Every row decoded by a model that saw no row of its fold of trials."""
    out = P.decoders(_decoding(spark, d), "y", "fold", 3, {"all": ["f_rate", "f_x", "f_line"]})
    return out.select("tr", "ln", "u", "fold", F.col("y").cast("long").alias("y"), F.col("prediction").cast("long").alias("pred"), F.round("p", 4).alias("p"))


@query("j8_decoder_grid")
def j8(spark, d):
    """Share decoded right of each experiment, fold and class."""
    out = P.decoders(_decoding(spark, d), "y", "fold", 3, {"rate": ["f_rate"], "place": ["f_x", "f_line"], "all": ["f_rate", "f_x", "f_line"]})
    return out.groupBy("experiment", "fold", F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("acc"))


LAGGED = "l AS (SELECT *, LAG(z) OVER (PARTITION BY tr ORDER BY ln, u, z, fr, x) AS before, LEAD(z) OVER (PARTITION BY tr ORDER BY ln, u, z, fr, x) AS after FROM act), v AS (SELECT u, fr, st, UNNEST(['-1','0','1']) AS lag, UNNEST([before, z, after]) AS zone FROM l)"


def _beside(spark, d):
    w = Window.partitionBy("tr").orderBy("ln", "u", "z", "fr", "x")  # no ties left, or only equal rows
    return activity(spark, d).withColumn("before", F.lag("z").over(w)).withColumn("after", F.lead("z").over(w))


LAGS = {"-1": "before", "0": "z", "1": "after"}


def _lagged(spark, d):
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(c).alias("zone")) for n, c in LAGS.items()]))
    return _beside(spark, d).select("tr", "ln", "u", "fr", "st", each).filter("zone is not null")


@query("j6_zone_features", f"WITH {ACT}, {LAGGED} SELECT st || ':' || lag || ':' || zone AS name, COUNT(*) AS n, ROUND(AVG(fr),6) AS m FROM v WHERE zone IS NOT NULL GROUP BY 1")
def j6(spark, d):
    """Zone features with lags, the outcome as interaction in the feature's name; counted and averaged."""
    return _lagged(spark, d).groupBy(F.concat_ws(":", "st", "lag", "zone").alias("name")).agg(F.count("*").alias("n"), R(F.avg("fr")).alias("m"))


@query("j7_encoder_grid", f"WITH {ACT}, {LAGGED}, e AS (SELECT u, lag, fr, UNNEST(['zone','zone x outcome']) AS variant, UNNEST([zone, zone || ':' || st]) AS f FROM v WHERE zone IS NOT NULL), g AS (SELECT u, lag, variant, f, COUNT(*) AS n, SUM(fr) AS s, SUM(fr*fr) AS q FROM e GROUP BY 1,2,3,4) SELECT u, lag, variant, COUNT(*) AS n_coef, ROUND(1-(SUM(q)-SUM(s*s/n))/(SUM(q)-SUM(s)*SUM(s)/SUM(n)),6) AS r2 FROM g GROUP BY 1,2,3 HAVING SUM(q)-SUM(s)*SUM(s)/SUM(n)>1e-6")
def j7(spark, d):
    """R2 of one-hot encoders, three lags by two feature sets, all units in one plan; sums by feature are shuffled, not rows."""
    two = F.inline(F.array(F.struct(F.lit("zone").alias("variant"), F.col("zone").alias("f")), F.struct(F.lit("zone x outcome").alias("variant"), F.concat_ws(":", "zone", "st").alias("f"))))
    g = _lagged(spark, d).select("u", "lag", "fr", two).groupBy("u", "lag", "variant", "f").agg(F.count("*").alias("n"), F.sum("fr").alias("s"), F.sum(F.col("fr") * F.col("fr")).alias("q"))
    t = g.groupBy("u", "lag", "variant").agg(F.count("*").alias("n_coef"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("e"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("all"))
    return t.filter("all > 1e-6").select("u", "lag", "variant", "n_coef", R(1 - (F.col("q") - F.col("e")) / F.col("all")).alias("r2"))


SUBS = "s AS (SELECT u, fr, AVG(fr) OVER (PARTITION BY u, FLOOR(x/10000)) AS a, AVG(fr) OVER (PARTITION BY u, ln) AS b FROM act), g AS (SELECT u, COUNT(*) AS n, VAR_POP(a) AS va, VAR_POP(b) AS vb, COVAR_POP(a,b) AS ab, COVAR_POP(a,fr) AS ay, COVAR_POP(b,fr) AS b_y, VAR_POP(fr) AS vy FROM s GROUP BY u)"


@query("j9_aggregate_model", f"WITH {ACT}, {SUBS} SELECT u, n, ROUND((ay*vb-b_y*ab)/(va*vb-ab*ab),5) AS coef_place, ROUND((b_y*va-ay*ab)/(va*vb-ab*ab),5) AS coef_line, ROUND((ay*(ay*vb-b_y*ab)+b_y*(b_y*va-ay*ab))/(va*vb-ab*ab)/vy,5) AS r2, ROUND(ay*ay/va/vy,5) AS r2_place, ROUND(b_y*b_y/vb/vy,5) AS r2_line FROM g WHERE n>10 AND va*vb-ab*ab>1e-3*va*vb AND vy>0")
def j9(spark, d):
    """Predictions of a place and a line model as features of a second regression; its coefficients beside their scores."""
    rows = activity(spark, d).select("u", "fr", "ln", S.uniform_bin("x", 0, 10000).alias("xb"))
    mean = lambda c, out: rows.groupBy("u", c).agg(F.avg("fr").alias(out))
    s = rows.join(mean("xb", "a"), ["u", "xb"]).join(mean("ln", "b"), ["u", "ln"])
    g = s.groupBy("u").agg(F.count("*").alias("n"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("ab"), F.covar_pop("a", "fr").alias("ay"), F.covar_pop("b", "fr").alias("b_y"), F.var_pop("fr").alias("vy"))
    va, vb, ab, ay, by, vy = (F.col(c) for c in ("va", "vb", "ab", "ay", "b_y", "vy"))
    det, ca, cb = va * vb - ab * ab, ay * vb - by * ab, by * va - ay * ab
    f = lambda c: F.round(c, 5)
    return g.filter((F.col("n") > 10) & (det > 1e-3 * va * vb) & (vy > 0)).select("u", "n", f(ca / det).alias("coef_place"), f(cb / det).alias("coef_line"), f((ay * ca + by * cb) / det / vy).alias("r2"), f(ay * ay / va / vy).alias("r2_place"), f(by * by / vb / vy).alias("r2_line"))


@query("j12_reduced_dimensions")
def j12(spark, d):
    pc = P.reduced(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 2, "pc")
    return pc.select("vec_id", *[R(F.get("pc", F.lit(i))).alias(f"pc{i + 1}") for i in range(2)])


@query("j13_cluster_count")
def j13(spark, d):
    """Held-out error of 2 to 5 clusters of the reduced points over three folds, averaged."""
    pc = storage.cut(P.reduced(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 2, "pc").select("pc", F.pmod(F.xxhash64("vec_id"), F.lit(3)).alias("fold")))
    return P.cluster_errors(pc, "pc", "fold", 3, range(2, 6)).groupBy("k").agg(F.sum("n").alias("n"), R(F.avg("error")).alias("error"))


@query("j14_traditional_scores", f"WITH {ACT}, k AS (SELECT *, RANK() OVER (PARTITION BY u ORDER BY fr)+(COUNT(*) OVER (PARTITION BY u, fr)-1)/2.0 AS rf, RANK() OVER (PARTITION BY u ORDER BY x)+(COUNT(*) OVER (PARTITION BY u, x)-1)/2.0 AS rx FROM act), sp AS (SELECT u, CORR(rf,rx) AS v FROM k GROUP BY u), an AS (SELECT u, SQRT(POWER(SUM(fr*COS({2 * pi}*ln/7)),2)+POWER(SUM(fr*SIN({2 * pi}*ln/7)),2))/SUM(fr) AS v FROM act GROUP BY u), m AS (SELECT u, ln, AVG(CASE WHEN tr%2=0 THEN fr END) AS a, AVG(CASE WHEN tr%2=1 THEN fr END) AS b FROM act GROUP BY u, ln), sb AS (SELECT u, CORR(a,b) AS v FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY u HAVING COUNT(*)>2) SELECT u, 'speed' AS analysis, ROUND(v,5) AS score FROM sp WHERE v IS NOT NULL UNION ALL SELECT u, 'angle', ROUND(v,5) FROM an UNION ALL SELECT u, 'stability', ROUND(v,5) FROM sb")
def j14(spark, d):
    """Long scores of each unit: rank correlation with the speed role, resultant length over angles, stability of halves."""
    a = activity(spark, d)
    speed = A.spearman(a, ["u"], "fr", "x").select("u", F.lit("speed").alias("analysis"), F.col("r").alias("score")).filter("score is not null")
    angle = A.circular(a.withColumn("ang", 2 * pi * F.col("ln") / 7), ["u"], "ang", "fr").select("u", F.lit("angle").alias("analysis"), F.col("r").alias("score"))
    halves = a.groupBy("u", "ln", (F.col("tr") % 2).alias("half")).agg(F.avg("fr").alias("m"))
    stable = M.map_similarity(halves, ["u"], ["ln"], "m", F.col("half") == 0, F.col("half") == 1).filter("n > 2").select("u", F.lit("stability").alias("analysis"), F.col("r").alias("score"))
    return speed.unionByName(angle).unionByName(stable).withColumn("score", F.round("score", 5))


@query("m2_border_score")
def m2(spark, d):
    """Border score of each unit's map, whose columns are price bins 0 to 10 and whose rows are lines 1 to 7."""
    g = activity(spark, d).groupBy("u", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.avg("fr").alias("m"))
    over = g.withColumn("mean", F.avg("m").over(Window.partitionBy("u"))).filter("m > 1.1 * mean")
    return M.border_score(over, ["u"], "m", (0, 10), (1, 7)).select("u", R("coverage").alias("coverage"), R("distance").alias("distance"), R("score").alias("score"))


SCALES, ANGLES = 12, 12


@query("m5_grid_pattern", f"WITH {ACT}, {BINS}, p AS (SELECT ARG_MAX(xb, m*1e6-xb*100-yb) AS px, ARG_MAX(yb, m*1e6-xb*100-yb) AS py, MIN(m) AS lo, MAX(m) AS hi FROM g), q AS (SELECT (m-lo)/(hi-lo) AS v, xb-px AS dx, yb-py AS dy FROM g, p), w AS (SELECT sc, an, v, (COS({4 * pi}/SQRT(3.0)/(2+0.5*sc)*(dx*COS(an*{pi / 36})+dy*SIN(an*{pi / 36})))+COS({4 * pi}/SQRT(3.0)/(2+0.5*sc)*(dx*COS(an*{pi / 36}+{pi / 3})+dy*SIN(an*{pi / 36}+{pi / 3})))+COS({4 * pi}/SQRT(3.0)/(2+0.5*sc)*(dx*COS(an*{pi / 36}+{2 * pi / 3})+dy*SIN(an*{pi / 36}+{2 * pi / 3})))+1.5)/4.5 AS f FROM q, range(0,{SCALES}) AS a(sc), range(0,{ANGLES}) AS b(an)) SELECT sc, an, ROUND(AVG((v-f)*(v-f)),6) AS mse FROM w GROUP BY sc, an")
def m5(spark, d):
    """Mean squared error of hexagonal patterns around the map's peak, over a sweep of scales and angles as rows."""
    return M.grid_sweep(_bins(spark, d), [], "m", SCALES, ANGLES).select("sc", "an", R("mse").alias("mse"))


@query("u1_named_statistic")
def u1(spark, d):
    """Largest and median difference of activity under hashed relabelling; the statistic is chosen by its name."""
    w = activity(spark, d).groupBy("u", "z").agg(F.avg("x").alias("a"), F.avg("fr").alias("b"))
    g = V.replicated_levels(w, "u", "z", "a", "b", "permuted", 5, REPS, {n: V.gap(n, 1000) for n in ("max", "median")})
    return g.select("u", "statistic", R("real").alias("real"), R("p").alias("p"))


@query("u2_named_metrics", f"WITH {ACT}, p AS (SELECT u, fr AS y, AVG(fr) OVER (PARTITION BY u, ln) AS q FROM act) SELECT u, ROUND(AVG((y-q)*(y-q)),6) AS mse, ROUND(AVG(ABS(y-q)),6) AS mae FROM p GROUP BY u")
def u2(spark, d):
    a = activity(spark, d)
    p = a.join(a.groupBy("u", "ln").agg(F.avg("fr").alias("q")), ["u", "ln"]).select("u", F.col("fr").alias("y"), "q")
    return P.metrics(p, ["u"], "y", "q", ["mse", "mae"]).select("u", R("mse").alias("mse"), R("mae").alias("mae"))

"""Remapping by Kendall's correlation on replicates, test against null, sizes of draws; sub-segments; cluster counts; any estimator; exported rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import models as P
from tracklane.operators import replicates as V
from tracklane.operators import storage
from tracklane.plans.contrast_plans import BOOTS, PAIRED, PICK, UB, UP, _boots, _paired, _segment_rows, _subsamples
from tracklane.plans.event_plans import TRIALS, _trials
from tracklane.plans.rate_plans import TT, TZ
from tracklane.plans.registry import query
from tracklane.plans.score_plans import STUDENT
from tracklane.sources.tables import ACT, TRK, activity, events, read, tracking

R5 = lambda c: F.round(c, 5)


def _tau(name: str, pairs: str, *keys: str) -> str:
    """Tables of tau-b (name: keys, k, r) over the rows (keys, z, x, y) of a table."""
    on, of = " AND ".join(f"i.{k}=j.{k}" for k in keys), ", ".join(f"i.{k}" for k in keys)
    return f"""{name}n AS (SELECT {", ".join(keys)}, COUNT(*) AS k FROM {pairs} GROUP BY ALL), {name}s AS (SELECT {of}, SUM(SIGN(i.x-j.x)*SIGN(i.y-j.y)) AS s, SUM(ABS(SIGN(i.x-j.x))) AS p, SUM(ABS(SIGN(i.y-j.y))) AS q FROM {pairs} i JOIN {pairs} j ON {on} AND i.z<j.z GROUP BY ALL),
{name} AS (SELECT {", ".join(f"n.{k}" for k in keys)}, k, CASE WHEN p>0 AND q>0 THEN s/SQRT(p*q) END AS r FROM {name}n n LEFT JOIN {name}s s ON {" AND ".join(f"n.{k}=s.{k}" for k in keys)})"""


@query("i10_kendall", f"""WITH {TZ}, o AS (SELECT DISTINCT u, tr, st FROM act WHERE st IN ('F','O')), pk AS (SELECT u, rep, tr, st, ROW_NUMBER() OVER (PARTITION BY u, st, rep ORDER BY MD5(CONCAT_WS('|','19',u,rep,tr)), tr) AS i FROM o, UNNEST(range(0,{BOOTS})) AS q(rep)), m AS (SELECT pk.u, rep, st, z, ROUND(AVG(s/n),9) AS m FROM pk JOIN tz ON tz.u=pk.u AND tz.tr=pk.tr WHERE i<=40 GROUP BY 1,2,3,4), b AS (SELECT a.u, a.rep, a.z, a.m AS x, b.m AS y FROM m a JOIN m b ON a.u=b.u AND a.rep=b.rep AND a.z=b.z AND a.st='F' AND b.st='O'), {_tau("c", "b", "u", "rep")} SELECT u, COUNT(*) AS reps, ROUND(AVG(r),5) AS tau FROM c GROUP BY u""")
def i10(spark, d):
    """Tau of the maps of two outcomes over subsamples of 40 trials, averaged over 100 replicates."""
    g = V.of_maps(activity(spark, d), _subsamples, _taus(V.paired_taus), _mean_tau("reps", 1), reps="bigint", tau="double")
    return g.select("u", "reps", R5("tau").alias("tau"))


def _taus(f):
    """Rates are rounded so that equal ones are ties."""
    return lambda x, y: f(V.rounded(x, 9), V.rounded(y, 9))


def _mean_tau(name: str, least: int):
    def told(n, tau):
        tau = tau[n >= least]
        return {name: len(tau), "tau": V.mean(tau[~np.isnan(tau)])} if len(tau) else None

    return told


_PAIRS = "ub AS (SELECT a.u, a.rep, a.z, ROUND(a.m,9) AS x, ROUND(b.m,9) AS y FROM ur a JOIN ur b ON a.u=b.u AND a.rep=b.rep AND a.z=b.z AND a.st='F' AND b.st='O')"


@query("i11_kendall", f"WITH {TZ}, {UB}, {_PAIRS}, {_tau('kt', 'ub', 'u', 'rep')} SELECT u, COUNT(*) AS reps, ROUND(AVG(r),5) AS tau FROM kt WHERE k>=5 GROUP BY u")
def i11(spark, d):
    """Tau of balanced bootstrap maps."""
    g = V.of_maps(activity(spark, d), _boots, _taus(V.paired_taus), _mean_tau("reps", 5), reps="bigint", tau="double")
    return g.select("u", "reps", R5("tau").alias("tau"))


@query("i12_kendall", f"WITH {TZ}, {UP}, ap AS (SELECT a.u, a.rep AS x_rep, b.rep AS y_rep, a.z, ROUND(a.m,9) AS x, ROUND(b.m,9) AS y FROM ur a JOIN ur b ON a.u=b.u AND a.z=b.z AND a.st='F' AND b.st='O'), {_tau('kt', 'ap', 'u', 'x_rep', 'y_rep')} SELECT u, COUNT(*) AS pairs, ROUND(AVG(r),5) AS tau FROM kt WHERE k>=5 GROUP BY u")
def i12(spark, d):
    """Tau of every replicate of one outcome with every one of the other, 25 by 25."""
    g = V.of_maps(activity(spark, d), _paired, _taus(V.crossed_taus), _mean_tau("pairs", 5), pairs="bigint", tau="double")
    return g.select("u", "pairs", R5("tau").alias("tau"))


# Two comparisons of a unit's trials: outcomes (test), even and odd trials (null).
NULLS = f"""{TZ}, b0 AS (SELECT DISTINCT u, tr, st FROM act WHERE st IN ('F','O')), b1 AS (SELECT u, tr, 'test' AS cmp, CASE WHEN st='F' THEN 'a' ELSE 'b' END AS side FROM b0 UNION ALL SELECT u, tr, 'null', CASE WHEN tr%2=0 THEN 'a' ELSE 'b' END FROM b0), b2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, cmp, side ORDER BY tr)-1 AS i, COUNT(*) OVER (PARTITION BY u, cmp, side) AS n FROM b1), b3 AS (SELECT *, (MIN(n) OVER (PARTITION BY u, cmp)+MAX(n) OVER (PARTITION BY u, cmp))//2 AS size FROM b2),
b4 AS (SELECT DISTINCT u, cmp, side, n, size FROM b3), b5 AS (SELECT u, cmp, side, rep, {PICK.format(key="'31',u,cmp,side,rep,i", n="n")} AS i FROM b4, UNNEST(range(0,{BOOTS})) AS q(rep), LATERAL (SELECT UNNEST(range(0,size)) AS i)), mp AS (SELECT d.u, d.cmp, d.side, d.rep, tz.z, ROUND(AVG(tz.s/tz.n),9) AS m FROM b5 d JOIN b2 t ON d.u=t.u AND d.cmp=t.cmp AND d.side=t.side AND d.i=t.i JOIN tz ON tz.u=t.u AND tz.tr=t.tr GROUP BY 1,2,3,4,5),
pr AS (SELECT a.u, a.cmp, a.rep, a.z, a.m AS x, b.m AS y FROM mp a JOIN mp b ON a.u=b.u AND a.cmp=b.cmp AND a.rep=b.rep AND a.z=b.z AND a.side='a' AND b.side='b'), {_tau("kt", "pr", "u", "cmp", "rep")}, rs AS (SELECT u, cmp, rep, k, SIN(r*PI()/2) AS r FROM kt WHERE k>=5)"""
_TAIL = "(0.254829592+q*(-0.284496736+q*(1.421413741+q*(-1.453152027+q*1.061405429))))"
CHI_TAIL = "LEAST(1.0,LIST_SUM(LIST_TRANSFORM(RANGE(0,n), lambda k: EXP(k*LN(GREATEST(h,1e-300))-h-LGAMMA(k+1)))))"


@query("i13_test_vs_null", f"WITH {NULLS}, zs AS (SELECT a.u, a.rep, (ATANH(a.r)-ATANH(b.r))/SQRT(1.0/(a.k-3)+1.0/(b.k-3)) AS z FROM rs a JOIN rs b ON a.u=b.u AND a.rep=b.rep WHERE a.cmp='test' AND b.cmp='null' AND ABS(a.r)<1 AND ABS(b.r)<1), zp AS (SELECT *, 1/(1+0.3275911*ABS(z)/SQRT(2)) AS q FROM zs), g AS (SELECT u, COUNT(*) AS n, AVG(z) AS zm, SUM(-LN(GREATEST(q*{_TAIL}*EXP(-z*z/2),1e-300))) AS h, COUNT(*)-1 AS df, AVG(z)/NULLIF(STDDEV_SAMP(z)/SQRT(COUNT(*)),0) AS t FROM zp GROUP BY u HAVING COUNT(*)>1), {STUDENT} SELECT u, n AS reps, ROUND(zm,5) AS z, ROUND({CHI_TAIL},6) AS zp, ROUND(t,4) AS t, ROUND(1-inner_p,6) AS tp FROM a")
def i13(spark, d):
    """z of the outcomes' correlation against that of even and odd trials on 100 balanced bootstraps: its mean, the
    replicates' p-values combined, and a t test of the replicates' z; strata draw the mean of their sizes."""
    g = V.tests_against_null(activity(spark, d), 31, BOOTS).filter("n > 1").withColumn("t", F.when(F.col("sd") > 0, F.col("z") / (F.col("sd") / F.sqrt("n"))))
    return g.select("u", F.col("n").alias("reps"), R5("z").alias("z"), F.round(A.combined_tail("h", "n", BOOTS), 6).alias("zp"), F.round("t", 4).alias("t"), F.round(S.student_tail("t", F.col("n") - 1), 6).alias("tp"))


@query("i14_segment_tests", f"WITH {TZ}, {UB}, sg AS (SELECT u, tr, SUBSTR(z,1,7) AS seg, SUM(s)/SUM(n) AS fr FROM tz GROUP BY 1,2,3), x AS (SELECT t.u, t.st, d.rep, sg.seg, sg.fr FROM ud d JOIN ub1 t ON d.u=t.u AND d.st=t.st AND d.i=t.i JOIN sg ON sg.u=t.u AND sg.tr=t.tr), y AS (SELECT u, rep, seg, {TT} FROM x GROUP BY 1,2,3), g AS (SELECT u, rep, seg, m1, m2, n1+n2-2 AS df, (m1-m2)/NULLIF(SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),0) AS t FROM y WHERE n1>1 AND n2>1 AND v1+v2>1e-9), {STUDENT}, w AS (SELECT u, seg, COUNT(*) AS n, AVG(m1) AS m1, AVG(m2) AS m2, AVG(t) AS t, SUM(-LN(GREATEST(1-inner_p,1e-300))) AS h FROM a GROUP BY 1,2) SELECT u, seg, n AS reps, ROUND(m1,5) AS m1, ROUND(m2,5) AS m2, ROUND(t,5) AS t, ROUND({CHI_TAIL},5) AS p FROM w")
def i14(spark, d):
    """Segment rates of two outcomes on balanced bootstraps: means, mean t and the replicates' p-values combined."""
    g = V.segment_tests(_segment_rows(spark, d), 23, BOOTS)
    return g.select("u", "seg", "reps", R5("m1").alias("m1"), R5("m2").alias("m2"), R5("t").alias("t"), R5(A.combined_tail("h", "reps", BOOTS)).alias("p"))


SIZES = {"min": "lo", "max": "hi", "mean": "(lo+hi)//2", "7": "7"}


@query("i5_draw_sizes", f"WITH {ACT}, t0 AS (SELECT DISTINCT cond, st, tr FROM act), t1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cond, st ORDER BY tr)-1 AS i, COUNT(*) OVER (PARTITION BY cond, st) AS n FROM t0), t2 AS (SELECT cond, MIN(n) AS lo, MAX(n) AS hi FROM t1 GROUP BY cond), k AS (" + " UNION ALL ".join(f"SELECT cond, '{s}' AS size, {e} AS want FROM t2" for s, e in SIZES.items()) + f"), d AS (SELECT size, c.cond, c.st, rep, {PICK.format(key="'41',c.cond,c.st,rep,i", n="c.n")} AS i FROM (SELECT DISTINCT cond, st, n FROM t1) c JOIN k ON c.cond=k.cond, UNNEST(range(0,{PAIRED})) AS q(rep), LATERAL (SELECT UNNEST(range(0,want)) AS i)) SELECT d.size, d.cond, d.st, COUNT(*) AS draws, COUNT(DISTINCT tr) AS trials, CAST(SUM(tr) AS BIGINT) AS ids FROM d JOIN t1 ON d.cond=t1.cond AND d.st=t1.st AND d.i=t1.i GROUP BY 1,2,3")
def i5(spark, d):
    """Balanced draws of the smallest, largest, mean and of a fixed size."""
    t = activity(spark, d).select("cond", "st", "tr").distinct()
    g = V.draws_of_sizes(t, ["cond"], ["st"], "tr", PAIRED, 41, {s: int(s) if s.isdigit() else s for s in SIZES})
    return g.withColumnRenamed("items", "trials")


LENGTH, TAIL = 8000, 60


@query("c13_merged_segments", f"WITH {ACT}, p AS (SELECT z, CAST(FLOOR((x*0.8+fr*600)/{LENGTH}) AS BIGINT) AS b, fr FROM act), g AS (SELECT z, b, COUNT(*) AS n, SUM(fr) AS s FROM p GROUP BY 1,2), w AS (SELECT *, SUM(n) OVER (PARTITION BY z ORDER BY b DESC) AS behind FROM g), l AS (SELECT z, COALESCE(MAX(b) FILTER (behind>={TAIL}), MIN(b)) AS last, MAX(b) AS fin FROM w GROUP BY z) SELECT g.z, LEAST(b,last) AS sub, MIN(LEAST(b,last))*{LENGTH}.0::DOUBLE AS lo, (CASE WHEN LEAST(b,last)=ANY_VALUE(last) THEN ANY_VALUE(fin) ELSE LEAST(b,last) END+1)*{LENGTH}.0::DOUBLE AS hi, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(s)/SUM(n),6) AS m FROM g JOIN l ON g.z=l.z GROUP BY g.z, LEAST(b,last)")
def c13(spark, d):
    """Mean activity in the sub-segments of each zone, whose sparse far ends are merged; the sub-segments are a table of their own."""
    a = activity(spark, d).withColumn("along", F.col("x") * 0.8 + F.col("fr") * 600)
    subs = M.sub_segments(a, ["z"], F.col("along"), float(LENGTH), TAIL)
    g = a.join(subs, "z").filter((F.col("along") >= F.col("lo")) & (F.col("along") < F.col("hi")))  # some sub-segments a zone
    return g.groupBy("z", "sub", "lo", "hi", "n").agg(F.round(F.avg("fr"), 6).alias("m"))


@query("j13_cluster_table")
def j13(spark, d):
    """2 to 4 clusters of the reduced points by k-means and bisection, three repeats of three folds: errors of both splits."""
    pc = storage.cut(P.reduced(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 2, "pc").select("vec_id", "pc"))
    g = P.repeated_clusterings(pc, "vec_id", "pc", 2, 3, 3, [2, 3, 4])
    return g.select("method", "repeat", "k", "fold", "split", "n", R5("mse").alias("mse"), R5("cosine").alias("cosine"))


@query("u3_cross_validated", f"WITH {ACT}, k AS (SELECT UNNEST(range(0,3)) AS f), m AS (SELECT k.f, REGR_SLOPE(fr, x/50000) AS b, REGR_INTERCEPT(fr, x/50000) AS a FROM act JOIN k ON act.tr%3<>k.f GROUP BY k.f) SELECT tr%3 AS fold, COUNT(*) AS n, ROUND(AVG((fr-a-b*x/50000)*(fr-a-b*x/50000)),4) AS mse FROM act JOIN m ON tr%3=f GROUP BY 1")
def u3(spark, d):
    """Any estimator of pyspark.ml, here a linear regression, fitted on the other folds and scored on its own."""
    a = activity(spark, d).select((F.col("tr") % 3).alias("fold"), "fr", (F.col("x") / 50000).alias("xs"))
    rows = storage.cut(VectorAssembler(inputCols=["xs"], outputCol="features").transform(a))
    out = P.cross_validated(rows, "fold", 3, LinearRegression(labelCol="fr", predictionCol="pred", solver="normal"))
    gap = F.col("fr") - F.col("pred")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(gap * gap), 4).alias("mse"))


@query("a10_exported_rows", f"WITH {TRIALS}, trk{TRK.split(', trk', 1)[1]}, {ACT}, x AS (SELECT s, 'trials' AS name, trial AS k, ROUND(tE-t0,6) AS v FROM trials UNION ALL SELECT s, 'events', id, ROUND(value,6) FROM ev UNION ALL SELECT s, 'track', id, ROUND(x+y,6) FROM trk UNION ALL SELECT u, 'rates', tr, ROUND(AVG(fr),6) FROM act GROUP BY u, tr UNION ALL SELECT u, 'units', COUNT(*), ROUND(AVG(fr),6) FROM act GROUP BY u) SELECT name, s, k, v FROM x")
def a10(spark, d):
    """The rows of five exported tables (trials, events, track, rates, units), read back from their files."""
    a = activity(spark, d).withColumnRenamed("u", "s")
    r = lambda c: F.round(c, 6).alias("v")
    tables = {
        "trials": _trials(spark, d).select("s", F.col("trial").alias("k"), r(F.col("tE") - F.col("t0"))), "events": events(spark, d).select("s", F.col("id").alias("k"), r("value")), "track": tracking(spark, d).select("s", F.col("id").alias("k"), r(F.col("x") + F.col("y"))),
        "rates": a.groupBy("s", F.col("tr").alias("k")).agg(r(F.avg("fr"))), "units": a.groupBy("s").agg(F.count("*").alias("k"), r(F.avg("fr"))),
    }
    out = None
    for name, t in storage.exported(tables, f"{storage.root(spark)}/export-{uuid.uuid4().hex}", "s").items():
        rows = t.select(F.lit(name).alias("name"), F.col("s").cast("long").alias("s"), F.col("k").cast("long").alias("k"), "v")
        out = rows if out is None else out.unionByName(rows)
    return out

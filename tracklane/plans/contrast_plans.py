"""Condition contrasts, resampled map comparisons, decoders, model selection, cluster geometry and map features."""

from __future__ import annotations

from math import e as EULER
from math import pi

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import replicates as V
from tracklane.operators import sequence as Q
from tracklane.plans.event_plans import TRIALS, _trials
from tracklane.plans.rate_plans import TT, TZ, _trial_zones
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, EV, TRK, activity, events, read, tracking

R = lambda c: F.round(c, 6)
#: Replicates of permutation and bootstrap tests, of bootstrapped rates and maps, and of maps that are compared all with all.
REPS, BOOTS, PAIRED = 500, 100, 25
PICK = "('0x'||SUBSTR(MD5(CONCAT_WS('|',{key})),1,8))::BIGINT % {n}"


@query("d7_zone_counts", f"WITH {ACT} SELECT u, z, CAST(SUM(CAST(fr AS BIGINT)) AS BIGINT) AS n_spk, COUNT(*) AS n FROM act GROUP BY 1,2")
def d7(spark, d):
    return activity(spark, d).groupBy("u", "z").agg(F.sum(F.col("fr").cast("long")).alias("n_spk"), F.count("*").alias("n"))


ANG = f"{EV}, a AS (SELECT s, ev, value AS v, 2*PI()*(CAST(FLOOR(t) AS BIGINT)%86400)/86400.0 AS th FROM ev)"


def _angles(spark, d):
    return events(spark, d).select("s", "ev", F.col("value").alias("v"), (2 * pi * (F.floor("t") % 86400) / 86400.0).alias("th"))


@query("d17_rayleigh", f"WITH {ANG}, g AS (SELECT ev, COUNT(*)::DOUBLE AS n, SUM(COS(th)) AS c, SUM(SIN(th)) AS sn FROM a GROUP BY ev) SELECT ev, ROUND((c*c+sn*sn)/n,5) AS z, ROUND(EXP(SQRT(1+4*n+4*(n*n-(c*c+sn*sn)))-(1+2*n)),5) AS p FROM g")
def d17(spark, d):
    g = A.circular(_angles(spark, d).withColumn("one", F.lit(1.0)), ["ev"], "th", "one")
    return g.select("ev", F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


@query("d18_angle_histogram", f"WITH {ANG}, h AS (SELECT ev, CAST(FLOOR(th/(PI()/6)) AS BIGINT) AS b, AVG(v) AS w FROM a GROUP BY 1,2), g AS (SELECT ev, SUM(w) AS w, SUM(w*COS((b+0.5)*PI()/6)) AS c, SUM(w*SIN((b+0.5)*PI()/6)) AS sn FROM h GROUP BY ev) SELECT ev, ROUND(SQRT(c*c+sn*sn)/w,5) AS r, ROUND(CASE WHEN ATAN2(sn,c)<0 THEN ATAN2(sn,c)+2*PI() ELSE ATAN2(sn,c) END,5) AS mean FROM g")
def d18(spark, d):
    h = _angles(spark, d).groupBy("ev", S.uniform_bin("th", 0, pi / 6).alias("b")).agg(F.avg("v").alias("w")).withColumn("th", (F.col("b") + 0.5) * (pi / 6))
    return A.circular(h, ["ev"], "th", "w").select("ev", F.round("r", 5).alias("r"), F.round("mean", 5).alias("mean"))


@query("d21_circular_linear", f"WITH {ANG}, g AS (SELECT ev, CORR(v,COS(th)) AS c, CORR(v,SIN(th)) AS sn, CORR(SIN(th),COS(th)) AS cs FROM a GROUP BY ev) SELECT ev, ROUND(SQRT((c*c+sn*sn-2*c*sn*cs)/(1-cs*cs)),5) AS r FROM g")
def d21(spark, d):
    g = _angles(spark, d).groupBy("ev").agg(F.corr("v", F.cos("th")).alias("c"), F.corr("v", F.sin("th")).alias("s"), F.corr(F.sin("th"), F.cos("th")).alias("cs"))
    square = F.col("c") * F.col("c") + F.col("s") * F.col("s") - 2 * F.col("c") * F.col("s") * F.col("cs")
    return g.select("ev", F.round(F.sqrt(square / (1 - F.col("cs") * F.col("cs"))), 5).alias("r"))


SEG = f"{ACT}, sg AS (SELECT u, SUBSTR(z,1,7) AS seg, tr, st, AVG(fr) AS fr FROM act GROUP BY 1,2,3,4)"


def _segments(spark, d):
    return activity(spark, d).groupBy("u", F.substring("z", 1, 7).alias("seg"), "tr", "st").agg(F.avg("fr").alias("fr"))


@query("d29_segment_contrast", f"WITH {SEG}, k AS (SELECT *, RANK() OVER (PARTITION BY u,seg ORDER BY fr)+(COUNT(*) OVER (PARTITION BY u,seg,fr)-1)/2.0 AS r FROM sg), g AS (SELECT u, seg, {TT}, SUM(CASE WHEN st='F' THEN r ELSE 0 END) AS r1 FROM k GROUP BY 1,2) SELECT u, seg, ROUND((m1-m2)/NULLIF(SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),0),5) AS t, ROUND((r1-n1*(n1+1)/2.0-n1*n2/2.0)/SQRT(n1*n2*(n1+n2+1)/12.0),5) AS uz FROM g WHERE n1>1 AND n2>1")
def d29(spark, d):
    sg = _segments(spark, d).withColumnRenamed("u", "unit")
    t = A.t_test(sg, ["unit", "seg"], "fr", F.col("st") == "F").filter("n1 > 1 and n2 > 1").select("unit", "seg", F.round("t", 5).alias("t"))
    z = A.mann_whitney(sg, ["unit", "seg"], "fr", F.col("st") == "F").select("unit", "seg", F.round("z", 5).alias("uz"))
    return t.join(z, ["unit", "seg"]).withColumnRenamed("unit", "u")


@query("d31_directional_summary", f"WITH {SEG}, m AS (SELECT u, seg, (CAST(SUBSTR(seg,7,1) AS BIGINT)-1)*2*PI()/5 AS th, AVG(fr) AS m FROM sg GROUP BY 1,2,3) SELECT u, ROUND(SUM(m*COS(th))/SUM(m),6) AS re, ROUND(SUM(m*SIN(th))/SUM(m),6) AS im FROM m GROUP BY u")
def d31(spark, d):
    m = _segments(spark, d).groupBy("u", "seg").agg(F.avg("fr").alias("m")).withColumn("th", (F.substring("seg", 7, 1).cast("long") - 1) * 2 * pi / 5)
    return m.groupBy("u").agg(R(F.sum(F.col("m") * F.cos("th")) / F.sum("m")).alias("re"), R(F.sum(F.col("m") * F.sin("th")) / F.sum("m")).alias("im"))


@query("d32_unit_quality", f"WITH {EV}, l AS (SELECT s, t, value, t-LAG(t) OVER (PARTITION BY s ORDER BY t, id) AS isi FROM ev), m AS (SELECT s, MEDIAN(value) AS med FROM ev GROUP BY s), g AS (SELECT l.s, COUNT(*) AS n, COUNT(*) FILTER (isi<3600) AS short, MAX(t)-MIN(t) AS dur, MIN(med) AS med, MEDIAN(ABS(value-med)) AS mad FROM l JOIN m ON l.s=m.s GROUP BY l.s) SELECT s, n, short, ROUND(n/dur*86400,6) AS rate, ROUND(med/(1.4826*mad),5) AS snr, short<=0.05*n AND med>0.5*mad AS valid FROM g WHERE dur>0 AND mad>0")
def d32(spark, d):
    e = events(spark, d)
    isi = F.col("t") - F.lag("t").over(Q.over(["s"], ["t", "id"]))
    g = e.withColumn("isi", isi).groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("isi") < 3600).alias("short"), (F.max("t") - F.min("t")).alias("dur"))
    g = g.join(A.mad(e, ["s"], "value"), "s").filter("dur > 0 and mad > 0")
    valid = (F.col("short") <= 0.05 * F.col("n")) & (F.col("med") > 0.5 * F.col("mad"))
    return g.select("s", "n", "short", R(F.col("n") / F.col("dur") * 86400).alias("rate"), F.round(F.col("med") / (1.4826 * F.col("mad")), 5).alias("snr"), valid.alias("valid"))


WAVE = "e AS (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS i FROM embeddings)"


def _waves(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


@query("d33_waveform_summary", f"WITH {WAVE} SELECT label, CAST(i AS BIGINT) AS i, ROUND(AVG(v),6) AS m, ROUND(STDDEV_SAMP(v),6) AS sd, ROUND(STDDEV_SAMP(v)/SQRT(COUNT(*)),6) AS sem, ROUND(AVG(v)/(STDDEV_SAMP(v)/SQRT(COUNT(*))),4) AS t FROM e GROUP BY 1,2")
def d33(spark, d):
    sem = F.stddev_samp("v") / F.sqrt(F.count("*"))
    return _waves(spark, d).groupBy("label", F.col("i").cast("long").alias("i")).agg(R(F.avg("v")).alias("m"), R(F.stddev_samp("v")).alias("sd"), R(sem).alias("sem"), F.round(F.avg("v") / sem, 4).alias("t"))


@query("d34_fold_averages", f"WITH {ACT}, f AS (SELECT u, cond, tr%5 AS fold, AVG(fr) AS v FROM act GROUP BY 1,2,3) SELECT u, cond, COUNT(*) AS folds, ROUND(AVG(v),6) AS v FROM f GROUP BY 1,2")
def d34(spark, d):
    f = activity(spark, d).groupBy("u", "cond", (F.col("tr") % 5).alias("fold")).agg(F.avg("fr").alias("v"))
    return f.groupBy("u", "cond").agg(F.count("*").alias("folds"), R(F.avg("v")).alias("v"))


@query("d39_coding_score", f"WITH {ACT}, g AS (SELECT u, AVG(CASE WHEN st='F' THEN fr END)-25 AS a, AVG(CASE WHEN st='O' THEN fr END)-25 AS b, AVG(CASE WHEN st='P' THEN fr END)-25 AS c FROM act GROUP BY u) SELECT u, ROUND((SIGN(b-a)+SIGN(c-a)+SIGN(c-b))/SQRT(3.0*NULLIF(ABS(SIGN(b-a))+ABS(SIGN(c-a))+ABS(SIGN(c-b)),0)),6) AS tau, ROUND(((a>0)::INT+(b>0)::INT+(c>0)::INT-1.5)/1.5,6) AS score FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def d39(spark, d):
    on = lambda s: F.avg(F.when(F.col("st") == s, F.col("fr"))) - 25
    g = activity(spark, d).groupBy("u").agg(on("F").alias("a"), on("O").alias("b"), on("P").alias("c")).dropna()
    signs = [F.signum(F.col(y) - F.col(x)) for x, y in ("ab", "ac", "bc")]
    untied = sum((F.abs(x) for x in signs), F.lit(0.0))
    positive = sum(((F.col(x) > 0).cast("int") for x in "abc"), F.lit(0))
    return g.select("u", R(sum(signs, F.lit(0.0)) / F.sqrt(3.0 * F.when(untied > 0, untied))).alias("tau"), R((positive - 1.5) / 1.5).alias("score"))


@query("d44_residuals_by_zone", f"WITH {TZ}, g AS (SELECT u, z, AVG(s/n) AS pred FROM tz GROUP BY 1,2), y AS (SELECT tz.z, s/n AS y, pred FROM tz JOIN g ON tz.u=g.u AND tz.z=g.z) SELECT z, COUNT(*) AS n, ROUND(CASE WHEN AVG(y)>1 THEN 1-SUM((y-pred)*(y-pred))/(COUNT(*)*VAR_POP(y)) END,6) AS r2, ROUND(CASE WHEN AVG(y)>1 THEN SQRT(SUM((y-pred)*(y-pred))/COUNT(*))/AVG(y) END,6) AS nrmse FROM y GROUP BY z")
def d44(spark, d):
    w = Window.partitionBy("u", "z")
    y = _trial_zones(spark, d).withColumn("y", F.col("s") / F.col("n")).withColumn("pred", F.avg("y").over(w))
    g = A.regression_metrics(y, ["z"], "y", "pred").join(y.groupBy("z").agg(F.avg("y").alias("my")), "z")
    guard = lambda c: R(F.when(F.col("my") > 1, F.col(c)))
    return g.select("z", "n", guard("r2").alias("r2"), guard("nrmse").alias("nrmse"))


PART = f"{ACT}, pt AS (SELECT u, z, fr, UNNEST([ 'All', CASE WHEN tr%2=0 THEN 'H1' ELSE 'H2' END, CASE st WHEN 'F' THEN 'Co' WHEN 'O' THEN 'Inco' END]) AS part FROM act), pz AS (SELECT u, part, z, SUM(fr) AS f, COUNT(*) AS n FROM pt WHERE part IS NOT NULL GROUP BY 1,2,3)"


def _partitions(spark, d):
    rules = {"All": F.lit(True), "H1": F.col("tr") % 2 == 0, "H2": F.col("tr") % 2 != 0, "Co": F.col("st") == "F", "Inco": F.col("st") == "O"}
    part = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return activity(spark, d).select("u", "z", "fr", part.alias("part")).groupBy("u", "part", "z").agg(F.sum("fr").alias("f"), F.count("*").alias("n"))


@query("d48_partition_information", f"WITH {PART}, p AS (SELECT u, part, f, n, f/SUM(f) OVER w AS q, n/SUM(n) OVER w AS o FROM pz WINDOW w AS (PARTITION BY u, part)) SELECT u, part, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(f)/SUM(n),6) AS rate, ROUND(SUM(q*LOG2(q/o)),6) AS info FROM p GROUP BY 1,2")
def d48(spark, d):
    g = _partitions(spark, d)
    rate = g.groupBy("u", "part").agg(F.sum("n").alias("n"), R(F.sum("f") / F.sum("n")).alias("rate"))
    return rate.join(A.spatial_information(g, ["u", "part"], "z", "f", "n").withColumn("info", R("info")), ["u", "part"])


@query("d48_partition_stability", f"WITH {PART}, r AS (SELECT a.u, a.z, ROUND(a.f/a.n,9) AS x, ROUND(b.f/b.n,9) AS y FROM pz a JOIN pz b ON a.u=b.u AND a.z=b.z WHERE a.part='H1' AND b.part='H2'), p AS (SELECT i.u, SIGN(i.x-j.x) AS sx, SIGN(i.y-j.y) AS sy FROM r i JOIN r j ON i.u=j.u AND i.z<j.z) SELECT u, ROUND(CASE WHEN SUM(ABS(sx))>0 AND SUM(ABS(sy))>0 THEN SUM(sx*sy)/SQRT(SUM(ABS(sx))*SUM(ABS(sy))) END,6) AS tau FROM p GROUP BY u")
def d48s(spark, d):
    g = _partitions(spark, d).withColumn("m", F.round(F.col("f") / F.col("n"), 9))
    both = g.filter("part = 'H1'").select("u", "z", F.col("m").alias("x")).join(g.filter("part = 'H2'").select("u", "z", F.col("m").alias("y")), ["u", "z"])
    return A.kendall(both, ["u"], "z", "x", "y").select("u", R("tau").alias("tau"))


@query("d51_unit_tables", f"WITH {ACT}, g AS (SELECT u, BOOL_OR(st='F') AND BOOL_OR(st='O') AS multi, COUNT(*) AS n FROM act GROUP BY u) SELECT s_suppkey AS u, s_nationkey AS subject, DENSE_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS id_in_subject, multi, n FROM supplier JOIN g ON u=s_suppkey")
def d51(spark, d):
    g = activity(spark, d).groupBy("u").agg((F.bool_or(F.col("st") == "F") & F.bool_or(F.col("st") == "O")).alias("multi"), F.count("*").alias("n"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("subject")).join(g, "u")
    return s.withColumn("id_in_subject", F.dense_rank().over(Window.partitionBy("subject").orderBy("u")).cast("long"))


@query("d54_score_on_behaviour", f"WITH {TRIALS}, p AS (SELECT s, AVG(correct) AS p FROM trials GROUP BY s), g AS (SELECT s, CORR(value,k) AS score FROM ev GROUP BY s) SELECT g.s%10 AS subject, COUNT(*) AS n, ROUND(REGR_SLOPE(score,p),5) AS slope, ROUND(CORR(p,score),5) AS r, CAST(SIGN(REGR_SLOPE(score,p)) AS BIGINT) AS sgn FROM g JOIN p ON g.s=p.s WHERE p IS NOT NULL AND score IS NOT NULL AND NOT ISNAN(score) GROUP BY 1 HAVING VAR_POP(p)>0")
def d54(spark, d):
    p = _trials(spark, d).groupBy("s").agg(F.avg("correct").alias("p"))
    g = events(spark, d).groupBy("s").agg(F.corr("value", "k").alias("score"))
    j = g.join(p, "s").filter("p is not null and score is not null and not isnan(score)").groupBy((F.col("s") % 10).alias("subject"))
    slope = F.regr_slope("score", "p")
    return j.agg(F.count("*").alias("n"), F.round(slope, 5).alias("slope"), F.round(F.corr("p", "score"), 5).alias("r"), F.signum(slope).cast("long").alias("sgn"), F.var_pop("p").alias("v")).filter("v > 0").drop("v")


PERM = f"""{ACT}, g AS (SELECT u, z, ROUND(AVG(x),6) AS a, ROUND(AVG(fr),6) AS b FROM act GROUP BY 1,2), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u ORDER BY z) AS i, COUNT(*) OVER (PARTITION BY u) AS n FROM g)"""


def _zone_means(spark, d):
    return activity(spark, d).groupBy("u", "z").agg(R(F.avg("x")).alias("a"), R(F.avg("fr")).alias("b"))


@query("i1_permutation_test", f"""WITH {PERM}, m AS (SELECT u, z, rep, i, a, b, ROW_NUMBER() OVER (PARTITION BY u, rep ORDER BY CASE WHEN rep=0 THEN LPAD(i::VARCHAR,12,'0') ELSE MD5(CONCAT_WS('|','11',u,rep,i)) END, i) AS j FROM o, UNNEST(range(0,{REPS}+1)) AS q(rep)),
c AS (SELECT x.u, x.rep, CORR(x.a,y.b) AS r FROM m x JOIN m y ON x.u=y.u AND x.rep=y.rep AND x.i=y.j GROUP BY 1,2) SELECT k.u, ROUND(ANY_VALUE(k.r),5) AS real, ROUND(AVG(CASE WHEN c.r>=k.r THEN 1.0 ELSE 0 END),5) AS p FROM c JOIN c k ON c.u=k.u AND k.rep=0 WHERE c.rep>0 GROUP BY k.u""")
def i1(spark, d):
    g = V.replicated_levels(_zone_means(spark, d), "u", "z", "a", "b", "permuted", 11, REPS, {"r": V.correlation()})
    return g.select("u", F.round("real", 5).alias("real"), F.round("p", 5).alias("p"))


@query("i2_shift_permutation", f"""WITH {PERM}, m AS (SELECT u, rep, i-1 AS i, n, a, b, CASE WHEN rep=0 THEN 0 ELSE {PICK.format(key="'13',u,rep", n="n")} END AS sh FROM o, UNNEST(range(0,{REPS}+1)) AS q(rep)),
c AS (SELECT x.u, x.rep, CORR(x.a,y.b) AS r FROM m x JOIN m y ON x.u=y.u AND x.rep=y.rep AND x.i=(y.i+y.sh)%y.n GROUP BY 1,2) SELECT k.u, ROUND(ANY_VALUE(k.r),5) AS real, ROUND(AVG(CASE WHEN ROUND(c.r,9)>=ROUND(k.r,9) THEN 1.0 ELSE 0 END),5) AS p FROM c JOIN c k ON c.u=k.u AND k.rep=0 WHERE c.rep>0 GROUP BY k.u""")
def i2(spark, d):
    g = V.replicated_levels(_zone_means(spark, d), "u", "z", "a", "b", "shifted", 13, REPS, {"r": V.correlation(9)})
    return g.select("u", F.round("real", 5).alias("real"), F.round("p", 5).alias("p"))


@query("i4_bootstrap_difference", f"""WITH {PERM}, h AS (SELECT *, i*2<=n AS one FROM o), m AS (SELECT h.u, rep, h.one, CASE WHEN rep=0 THEN h.b ELSE y.b END AS b FROM h CROSS JOIN UNNEST(range(0,{REPS}+1)) AS q(rep) JOIN o y ON y.u=h.u AND y.i-1=CASE WHEN rep=0 THEN h.i-1 ELSE {PICK.format(key="'17',h.u,rep,h.i-1", n="h.n")} END),
c AS (SELECT u, rep, ROUND(ABS(AVG(CASE WHEN one THEN b END)-AVG(CASE WHEN NOT one THEN b END)),9) AS dd FROM m GROUP BY 1,2) SELECT k.u, ROUND(ANY_VALUE(k.dd),5) AS real, ROUND(AVG(CASE WHEN c.dd>=k.dd THEN 1.0 ELSE 0 END),5) AS p FROM c JOIN c k ON c.u=k.u AND k.rep=0 WHERE c.rep>0 GROUP BY k.u""")
def i4(spark, d):
    g = V.replicated_levels(_zone_means(spark, d), "u", "z", "a", "b", "drawn", 17, REPS, {"dd": V.half_difference(9)})
    return g.select("u", F.round("real", 5).alias("real"), F.round("p", 5).alias("p"))


# balanced bootstrap: strata are outcome x parity of trials inside a condition
BAL = f"""{TZ}, t0 AS (SELECT DISTINCT cond, st, tr FROM act WHERE st<>'P'), t1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cond, st ORDER BY tr)-1 AS i, COUNT(*) OVER (PARTITION BY cond, st) AS n FROM t0), t2 AS (SELECT *, MIN(n) OVER (PARTITION BY cond) AS size FROM t1),
dr AS (SELECT cond, st, rep, {PICK.format(key="'5',cond,st,rep,i", n="n")} AS i FROM t2, UNNEST(range(0,{BOOTS})) AS q(rep) WHERE i<size), boot AS (SELECT d.cond, d.st, d.rep, t.tr FROM dr d JOIN t1 t ON d.cond=t.cond AND d.st=t.st AND d.i=t.i)"""


def _boot_trials(spark, d):
    return activity(spark, d).filter("st <> 'P'").select("cond", "st", "tr").distinct()


@query("i5_balanced_bootstrap", f"WITH {BAL} SELECT cond, st, rep, COUNT(*) AS n, CAST(SUM(tr) AS BIGINT) AS ids FROM boot GROUP BY 1,2,3")
def i5(spark, d):
    return V.draw_totals(_boot_trials(spark, d), ["cond"], ["st"], "tr", BOOTS, 5)


@query("i6_bootstrap_zone_rates", f"WITH {BAL} SELECT cond, rep, u, z, ROUND(AVG(s/n),5) AS m, COUNT(*) AS n FROM boot JOIN tz USING (tr) GROUP BY 1,2,3,4")
def i6(spark, d):
    rates = _trial_zones(spark, d).select("u", "tr", "z", (F.col("s") / F.col("n")).alias("rate"))
    g = V.drawn_zone_rates(V.draw_counts(_boot_trials(spark, d), ["cond"], ["st"], "tr", BOOTS, 5), rates, "cond", BOOTS)
    return g.select("cond", "rep", "u", "z", F.round("m", 5).alias("m"), "n")


MAP = f"{TZ}, o AS (SELECT DISTINCT tr, cond, st FROM act), mp AS (SELECT u, z, cond, st, AVG(s/n) AS m, COUNT(*) AS k FROM tz JOIN o USING (tr) GROUP BY 1,2,3,4), bo AS (SELECT u, z, st, AVG(s/n) AS m, COUNT(*) AS k FROM tz JOIN o USING (tr) GROUP BY 1,2,3)"


def _rate_maps(spark, d, *by):
    r = activity(spark, d).groupBy("u", "tr", "z", "cond", "st").agg(F.avg("fr").alias("r"))
    return r.groupBy("u", "z", *by).agg(F.avg("r").alias("m"), F.count("*").alias("k"))


@query("i7_map_similarity", f"WITH {MAP} SELECT a.u, COUNT(*) AS n, ROUND(CORR(a.m,b.m),5) AS r FROM bo a JOIN bo b ON a.u=b.u AND a.z=b.z AND a.st='F' AND b.st='O' GROUP BY a.u")
def i7(spark, d):
    return M.map_similarity(_rate_maps(spark, d, "st"), ["u"], ["z"], "m", F.col("st") == "F", F.col("st") == "O").select("u", "n", F.round("r", 5).alias("r"))


@query("i8_zone_contrast_maps", f"WITH {ACT}, k AS (SELECT u AS unit, z, st, fr, RANK() OVER (PARTITION BY u,z ORDER BY fr)+(COUNT(*) OVER (PARTITION BY u,z,fr)-1)/2.0 AS r FROM act), g AS (SELECT unit, z, {TT}, SUM(CASE WHEN st='F' THEN r ELSE 0 END) AS r1 FROM k GROUP BY 1,2) SELECT unit, z, ROUND(CASE WHEN n1>=2 AND n2>=2 THEN (m1-m2)/NULLIF(SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),0) END,5) AS t, ROUND(CASE WHEN n1>=2 AND n2>=2 THEN (r1-n1*(n1+1)/2.0-n1*n2/2.0)/SQRT(n1*n2*(n1+n2+1)/12.0) END,5) AS uz FROM g")
def i8(spark, d):
    a = activity(spark, d).withColumnRenamed("u", "unit")
    t = A.t_test(a, ["unit", "z"], "fr", F.col("st") == "F")
    z = A.mann_whitney(a.withColumnRenamed("z", "zone"), ["unit", "zone"], "fr", F.col("st") == "F").select("unit", F.col("zone").alias("z"), F.col("z").alias("uz"))
    seen = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    return t.join(z, ["unit", "z"]).select("unit", "z", F.round(F.when(seen, F.col("t")), 5).alias("t"), F.round(F.when(seen, F.col("uz")), 5).alias("uz"))


@query("i9_standard_comparisons", f"WITH {MAP}, cmp AS (SELECT * FROM (VALUES ('outcome','F','O'),('outcome_p','F','P'),('rest','O','P')) v(name,x,y)) SELECT name, a.u, COUNT(*) AS n, ROUND(CORR(a.m,b.m),5) AS r, ROUND(SUM((a.m-b.m)*(a.k+b.k))/SUM(a.k+b.k),5) AS diff FROM cmp JOIN bo a ON a.st=x JOIN bo b ON b.st=y AND a.u=b.u AND a.z=b.z GROUP BY 1,2")
def i9(spark, d):
    cmp = F.broadcast(spark.createDataFrame([("outcome", "F", "O"), ("outcome_p", "F", "P"), ("rest", "O", "P")], "name string, x string, y string"))  # fixed values
    bo = _rate_maps(spark, d, "st")
    a = bo.join(cmp, bo.st == cmp.x).select("name", "u", "z", F.col("y").alias("st"), "m", "k")
    j = a.join(bo.select("u", "z", "st", F.col("m").alias("m2"), F.col("k").alias("k2")), ["u", "z", "st"])
    k = F.col("k") + F.col("k2")
    return j.groupBy("name", "u").agg(F.count("*").alias("n"), F.round(F.corr("m", "m2"), 5).alias("r"), F.round(F.sum((F.col("m") - F.col("m2")) * k) / F.sum(k), 5).alias("diff"))


@query("i10_subsampled_correlation", f"""WITH {TZ}, o AS (SELECT DISTINCT u, tr, st FROM act WHERE st IN ('F','O')), pk AS (SELECT u, rep, tr, st, ROW_NUMBER() OVER (PARTITION BY u, st, rep ORDER BY MD5(CONCAT_WS('|','19',u,rep,tr)), tr) AS i FROM o, UNNEST(range(0,{BOOTS})) AS q(rep)), m AS (SELECT pk.u, rep, st, z, AVG(s/n) AS m FROM pk JOIN tz ON tz.u=pk.u AND tz.tr=pk.tr WHERE i<=40 GROUP BY 1,2,3,4), c AS (SELECT a.u, a.rep, CORR(a.m,b.m) AS r FROM m a JOIN m b ON a.u=b.u AND a.rep=b.rep AND a.z=b.z AND a.st='F' AND b.st='O' GROUP BY 1,2) SELECT u, COUNT(*) AS reps, ROUND(AVG(CASE WHEN NOT ISNAN(r) THEN r END),4) AS r FROM c GROUP BY u""")
def i10(spark, d):
    def told(n, r):
        r = r[n > 0]
        return {"reps": len(r), "r": V.mean(r[~np.isnan(r)])} if len(r) else None

    g = V.of_maps(activity(spark, d), _subsamples, V.paired_correlations, told, reps="bigint", r="double")
    return g.select("u", "reps", F.round("r", 4).alias("r"))


def _subsamples(unit, trials):
    """Maps of 40 trials of each outcome."""
    return V.subsampled_maps(unit, trials, 19, BOOTS, 40)


UB = """ub0 AS (SELECT DISTINCT u, st, tr FROM act WHERE st IN ('F','O')), ub1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, st ORDER BY tr)-1 AS i, COUNT(*) OVER (PARTITION BY u, st) AS n FROM ub0), ub2 AS (SELECT *, MIN(n) OVER (PARTITION BY u) AS size FROM ub1),
ud AS (SELECT u, st, rep, ('0x'||SUBSTR(MD5(CONCAT_WS('|','23',u,st,rep,i)),1,8))::BIGINT % n AS i FROM ub2, UNNEST(range(0,REPLICATES)) AS q(rep) WHERE i<size), ur AS (SELECT d.u, d.st, d.rep, tz.z, AVG(tz.s/tz.n) AS m FROM ud d JOIN ub1 t ON d.u=t.u AND d.st=t.st AND d.i=t.i JOIN tz ON tz.u=t.u AND tz.tr=t.tr GROUP BY 1,2,3,4),
uc AS (SELECT a.u, a.rep, COUNT(*) AS k, CORR(a.m,b.m) AS r FROM ur a JOIN ur b ON a.u=b.u AND a.rep=b.rep AND a.z=b.z AND a.st='F' AND b.st='O' GROUP BY 1,2)"""
UP, UB = UB.replace("REPLICATES", str(PAIRED)), UB.replace("REPLICATES", str(BOOTS))


def _boots(unit, trials):
    return V.boot_maps(unit, trials, 23, BOOTS)


def _paired(unit, trials):
    """All replicates of a unit, which are compared all with all."""
    both = V.joined(V.boot_maps(unit, trials, 23, PAIRED))
    return [both] if both else []


@query("i11_bootstrap_map_correlation", f"WITH {TZ}, {UB} SELECT u, COUNT(*) AS reps, ROUND(AVG(r),4) AS r FROM uc WHERE k>=5 GROUP BY u")
def i11(spark, d):
    def told(n, r):
        r = r[n >= 5]
        return {"reps": len(r), "r": V.mean(r)} if len(r) else None

    g = V.of_maps(activity(spark, d), _boots, V.paired_correlations, told, reps="bigint", r="double")
    return g.select("u", "reps", F.round("r", 4).alias("r"))


@query("i12_all_pairs_replicates", f"WITH {TZ}, {UP}, p AS (SELECT a.u, a.rep AS x, b.rep AS y, CORR(a.m,b.m) AS r, COUNT(*) AS k FROM ur a JOIN ur b ON a.u=b.u AND a.z=b.z AND a.st='F' AND b.st='O' GROUP BY 1,2,3) SELECT u, COUNT(*) AS pairs, ROUND(AVG(r),4) AS r FROM p WHERE k>=5 GROUP BY u")
def i12(spark, d):
    def told(n, r):
        r = r[n >= 5]
        return {"pairs": len(r), "r": V.mean(r)} if len(r) else None

    g = V.of_maps(activity(spark, d), _paired, V.crossed_correlations, told, pairs="bigint", r="double")
    return g.select("u", "pairs", F.round("r", 4).alias("r"))


@query("i13_remapping_table", f"WITH {TZ}, {UB}, g AS (SELECT u, AVG(r) AS r, AVG(ATANH(r)) AS z, COUNT(*) AS reps, AVG(k) AS k FROM uc WHERE k>=5 AND ABS(r)<0.999999 GROUP BY u) SELECT u, reps, ROUND(r,4) AS r, ROUND(z,4) AS z, ROUND(z*SQRT(k-3),4) AS score FROM g")
def i13(spark, d):
    def told(n, r):
        at = (n >= 5) & (np.abs(r) < 0.999999)
        return {"reps": int(at.sum()), "r": V.mean(r[at]), "z": V.mean(np.arctanh(r[at])), "k": V.mean(n[at])} if at.any() else None

    g = V.of_maps(activity(spark, d), _boots, V.paired_correlations, told, reps="bigint", r="double", z="double", k="double")
    return g.select("u", "reps", F.round("r", 4).alias("r"), F.round("z", 4).alias("z"), F.round(F.col("z") * F.sqrt(F.col("k") - 3), 4).alias("score"))


@query("i14_segment_rate_bootstrap", f"WITH {TZ}, {UB}, sg AS (SELECT u, tr, SUBSTR(z,1,7) AS seg, SUM(s)/SUM(n) AS fr FROM tz GROUP BY 1,2,3), x AS (SELECT t.u, t.st, d.rep, sg.seg, sg.fr FROM ud d JOIN ub1 t ON d.u=t.u AND d.st=t.st AND d.i=t.i JOIN sg ON sg.u=t.u AND sg.tr=t.tr), g AS (SELECT u, rep, seg, {TT} FROM x GROUP BY 1,2,3), q AS (SELECT u, seg, (m1-m2)/NULLIF(SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),0) AS t FROM g WHERE n1>1 AND n2>1 AND v1+v2>1e-9) SELECT u, seg, COUNT(*) AS reps, ROUND(AVG(t),4) AS t FROM q GROUP BY 1,2")
def i14(spark, d):
    g = V.segment_tests(_segment_rows(spark, d), 23, BOOTS)
    return g.select("u", "seg", "reps", F.round("t", 4).alias("t"))


def _segment_rows(spark, d):
    return activity(spark, d).select("u", "tr", "st", F.substring("z", 1, 7).alias("seg"), "fr")


@query("i15_population_remapping", f"WITH {MAP} SELECT s_nationkey AS pop, COUNT(*) AS n, ROUND(CORR(a.m,b.m),5) AS r FROM bo a JOIN bo b ON a.u=b.u AND a.z=b.z AND a.st='F' AND b.st='O' JOIN supplier ON a.u=s_suppkey GROUP BY 1")
def i15(spark, d):
    units = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("pop"))
    g = M.map_similarity(_rate_maps(spark, d, "st").join(units, "u"), ["pop"], ["u", "z"], "m", F.col("st") == "F", F.col("st") == "O")
    return g.select("pop", "n", F.round("r", 5).alias("r"))


@query("i17_fisher_combination", "SELECT p_partkey AS id, ROUND(-2*LN((p_size+1)/52.0*(p_partkey%10+1)/11.0),6) AS chi, ROUND((p_size+1)/52.0*(p_partkey%10+1)/11.0*(1-LN((p_size+1)/52.0*(p_partkey%10+1)/11.0)),6) AS p FROM part")
def i17(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(((F.col("p_size") + 1) / 52.0), ((F.col("p_partkey") % 10 + 1) / 11.0)).alias("ps"))
    chi = -2 * F.aggregate("ps", F.lit(0.0), lambda a, x: a + F.ln(x))
    return p.select("id", R(chi).alias("chi"), R(S.chi2_tail_even(chi, 2)).alias("p"))


@query("i19_significant_pairs", f"WITH {SEG}, pr AS (SELECT * FROM (VALUES ('F','O'),('F','P'),('O','P')) v(x,y)), g AS (SELECT seg, x, y, COUNT(CASE WHEN st=x THEN fr END) AS n1, COUNT(CASE WHEN st=y THEN fr END) AS n2, AVG(CASE WHEN st=x THEN fr END)-AVG(CASE WHEN st=y THEN fr END) AS dm, VAR_SAMP(CASE WHEN st=x THEN fr END) AS v1, VAR_SAMP(CASE WHEN st=y THEN fr END) AS v2 FROM sg JOIN pr ON st=x OR st=y GROUP BY 1,2,3) SELECT seg, x, y, ROUND(dm/SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),5) AS t, ABS(dm/SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)))>1.96 AS sig FROM g")
def i19(spark, d):
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ("FO", "FP", "OP")])
    sg = _segments(spark, d).withColumn("p", F.explode(pairs)).select("seg", "p.x", "p.y", "st", "fr").filter("st = x or st = y")
    t = A.t_test(sg, ["seg", "x", "y"], "fr", F.col("st") == F.col("x"))
    return t.select("seg", "x", "y", F.round("t", 5).alias("t"), (F.abs("t") > 1.96).alias("sig"))


@query("i21_class_weights", "WITH c AS (SELECT l_orderkey%5 AS fold, l_returnflag='R' AS y, COUNT(*) AS n FROM lineitem GROUP BY 1,2) SELECT fold, y, n, ROUND(1-n/SUM(n) OVER (PARTITION BY fold),6) AS w FROM c")
def i21(spark, d):
    c = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold"), (F.col("l_returnflag") == "R").alias("y")).agg(F.count("*").alias("n"))
    return c.withColumn("w", R(1 - F.col("n") / F.sum("n").over(Window.partitionBy("fold"))))


@query("i22_nested_models", f"WITH {ACT}, c AS (SELECT st, fr-AVG(fr) OVER (PARTITION BY u) AS y, ln-AVG(ln) OVER (PARTITION BY u) AS x FROM act) SELECT st, COUNT(*) AS n, ROUND(SUM(x*y)/SUM(x*x),6) AS b, ROUND(-COUNT(*)*LN(1-SUM(x*y)*SUM(x*y)/(SUM(x*x)*SUM(y*y))),4) AS chi FROM c GROUP BY st")
def i22(spark, d):
    w = Window.partitionBy("u")
    c = activity(spark, d).select("st", (F.col("fr") - F.avg("fr").over(w)).alias("y"), (F.col("ln") - F.avg("ln").over(w)).alias("x"))
    xy, xx, yy = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    return c.groupBy("st").agg(F.count("*").alias("n"), R(xy / xx).alias("b"), F.round(-F.count("*") * F.ln(1 - xy * xy / (xx * yy)), 4).alias("chi"))


@query("i23_subject_bootstrap", f"""WITH {PERM}, r AS (SELECT u, rep, {PICK.format(key="'29',u,rep,i-1", n="n")} AS j FROM o, UNNEST(range(0,{REPS})) AS q(rep)), b AS (SELECT r.u, rep, CORR(a,b) AS c FROM r JOIN o ON r.u=o.u AND o.i-1=r.j GROUP BY 1,2) SELECT s_nationkey AS subject, COUNT(*) AS n, ROUND(AVG(c),4) AS m, ROUND(QUANTILE_CONT(c,0.025),4) AS lo, ROUND(QUANTILE_CONT(c,0.975),4) AS hi FROM b JOIN supplier ON u=s_suppkey GROUP BY 1""")
def i23(spark, d):
    c = V.bootstrapped_correlations(_zone_means(spark, d), "u", "z", "a", "b", 29, REPS)
    units = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("subject"))
    c = c.join(units.hint("merge"), "u").select("subject", "r")
    w = Window.partitionBy("subject").orderBy(F.col("r").asc_nulls_last())  # a sort that spills, no task holds a subject's values
    ranked = c.withColumns({"k": F.row_number().over(w) - 1, "n": F.count("r").over(Window.partitionBy("subject"))})
    at = lambda p: p * (F.col("n") - 1)

    def q(p, name):
        low, high = (F.max(F.when(F.col("k") == f(at(p)), F.col("r"))) for f in (F.floor, F.ceil))
        share = F.first(at(p) - F.floor(at(p)))
        return F.round(F.when(share > 0, low + (high - low) * share).otherwise(low), 4).alias(name)

    return ranked.groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("m"), q(0.025, "lo"), q(0.975, "hi"))


BINS = "g AS (SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, COUNT(*) AS n, AVG(fr) AS m FROM act GROUP BY 1,2)"


def _bins(spark, d):
    return activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.count("*").alias("n"), F.avg("fr").alias("m"))


@query("j4_position_features", f"WITH {ACT}, {BINS} SELECT a.xb, a.yb, b.xb AS cx, b.yb AS cy, ROUND(EXP(-((a.xb-b.xb)*(a.xb-b.xb)+(a.yb-b.yb)*(a.yb-b.yb))/2.0),6) AS w FROM g a JOIN g b ON ABS(a.xb-b.xb)<=2 AND ABS(a.yb-b.yb)<=2")
def j4(spark, d):
    g = _bins(spark, d).select("xb", "yb")
    return M.neighbours(g, 2).select("xb", "yb", "cx", "cy", R(F.exp(-(F.pow(F.col("xb") - F.col("cx"), 2) + F.pow(F.col("yb") - F.col("cy"), 2)) / 2)).alias("w")).join(g.select(F.col("xb").alias("cx"), F.col("yb").alias("cy")), ["cx", "cy"], "left_semi")


@query("j10_best_submodel", f"WITH {ACT}, g AS (SELECT u, COUNT(*) AS n, VAR_POP(fr) AS v, CORR(ln,fr) AS a, CORR(x,fr) AS b, CORR(ln,x) AS c FROM act GROUP BY u HAVING COUNT(*)>10), m AS (SELECT u, n, v, UNNEST([0,1,2,3]) AS k, UNNEST([0.0, a*a, b*b, (a*a+b*b-2*a*b*c)/(1-c*c)]) AS r2, UNNEST([1,2,2,3]) AS p FROM g), s AS (SELECT u, k, r2, n*LN(v*(1-r2))+2*(p+1)+2.0*(p+1)*(p+2)/(n-p-2) AS aicc FROM m) SELECT u, CAST(ARG_MIN(k, ROUND(aicc,6)) AS BIGINT) AS best, ROUND(MIN(aicc),4) AS aicc FROM s GROUP BY u")
def j10(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.count("*").alias("n"), F.var_pop("fr").alias("v"), F.corr("ln", "fr").alias("a"), F.corr("x", "fr").alias("b"), F.corr("ln", "x").alias("c")).filter("n > 10")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    models = [(F.lit(0.0), 1), (a * a, 2), (b * b, 2), ((a * a + b * b - 2 * a * b * c) / (1 - c * c), 3)]
    m = g.select("u", "n", "v", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), r2.cast("double").alias("r2"), F.lit(p).alias("p")) for k, (r2, p) in enumerate(models)])))
    aicc = F.col("n") * F.ln(F.col("v") * (1 - F.col("r2"))) + 2 * (F.col("p") + 1) + 2.0 * (F.col("p") + 1) * (F.col("p") + 2) / (F.col("n") - F.col("p") - 2)
    return m.withColumn("aicc", aicc).groupBy("u").agg(F.min_by("k", F.struct(R("aicc"), F.col("k"))).alias("best"), F.round(F.min("aicc"), 4).alias("aicc"))


GEO = "p AS (SELECT label, vec_id%4 AS s, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), mo AS (SELECT s, label, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, VAR_SAMP(x) AS vx, VAR_SAMP(y) AS vy, COVAR_SAMP(x,y) AS c, VAR_SAMP(x)*VAR_SAMP(y)-COVAR_SAMP(x,y)*COVAR_SAMP(x,y) AS det FROM p GROUP BY 1,2 HAVING COUNT(*)>2)"


def _moments(spark, d):
    p = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("s"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return M.moments(p, ["s", "label"], "x", "y").filter("n > 2")


@query("j11_cluster_entropy", f"WITH {GEO} SELECT s, label, n, ROUND(0.5*LN(POW(2*PI()*EXP(1),2)*det),5) AS h FROM mo")
def j11(spark, d):
    return _moments(spark, d).select("s", "label", "n", F.round(0.5 * F.ln((2 * pi * EULER) ** 2 * F.col("det")), 5).alias("h"))


@query("j11_cluster_divergence", f"WITH {GEO} SELECT a.s, a.label AS a, b.label AS b, ROUND(0.5*((b.vy*a.vx+b.vx*a.vy-2*b.c*a.c)/b.det+(b.vy*(b.mx-a.mx)*(b.mx-a.mx)-2*b.c*(b.mx-a.mx)*(b.my-a.my)+b.vx*(b.my-a.my)*(b.my-a.my))/b.det-2+LN(b.det/a.det)),4) AS kld FROM mo a JOIN mo b ON a.s=b.s AND a.label<>b.label")
def j11d(spark, d):
    return M.gaussian_divergence(_moments(spark, d), ["s"], "label").withColumn("kld", F.round("kld", 4))


@query("m1_fields")
def m1(spark, d):
    """Fields of each unit's map: bins above 1.1 times the map's mean, joined over the eight neighbours."""
    g = activity(spark, d).groupBy("u", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.avg("fr").alias("m"))
    over = g.withColumn("mean", F.avg("m").over(Window.partitionBy("u"))).filter("m > 1.1 * mean")
    return M.fields(over.select("u", "xb", "yb"), ["u"], 2)


@query("m4_map_peaks", f"WITH {ACT}, {BINS} SELECT a.xb, a.yb, ROUND(a.m,6) AS m FROM g a JOIN g b ON ABS(a.xb-b.xb)<=1 AND ABS(a.yb-b.yb)<=1 GROUP BY a.xb, a.yb, a.m HAVING a.m>=MAX(b.m)")
def m4(spark, d):
    g = _bins(spark, d)
    spread = M.neighbours(g.select("xb", "yb", "m"), 1).groupBy(F.col("cx").alias("xb"), F.col("cy").alias("yb")).agg(F.max("m").alias("top"))
    return g.join(spread, ["xb", "yb"]).filter("m >= top").select("xb", "yb", R("m").alias("m"))


@query("m7_track_product", f"WITH {TRK}, v AS (SELECT s, id, x, y, x-LAG(x) OVER w AS dx, y-LAG(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY s ORDER BY t, id)), b AS (SELECT s, CAST(FLOOR(x/50) AS BIGINT) AS xb, CAST(FLOOR(y/25) AS BIGINT) AS yb, COUNT(*) AS n, AVG(COALESCE(SQRT(dx*dx+dy*dy)/0.02,0)) AS sp FROM v WHERE x<200 GROUP BY 1,2,3) SELECT s, CAST(SUM(n) AS BIGINT) AS n, ROUND(COUNT(*)/16.0,6) AS coverage, ROUND(SUM(n*sp)/SUM(n),4) AS speed FROM b GROUP BY s")
def m7(spark, d):
    v = Q.velocity(tracking(spark, d), ["s"], ["t", "id"], "x", "y", 0.02).filter("x < 200")
    b = v.groupBy("s", S.uniform_bin("x", 0, 50).alias("xb"), S.uniform_bin("y", 0, 25).alias("yb")).agg(F.count("*").alias("n"), F.avg("speed").alias("sp"))
    return b.groupBy("s").agg(F.sum("n").alias("n"), R(F.count("*") / 16.0).alias("coverage"), F.round(F.sum(F.col("n") * F.col("sp")) / F.sum("n"), 4).alias("speed"))

"""Rates by trial, zone, unit and condition; statistics, resampling and regressions on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import replicates as V
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, activity, read

R = lambda c: F.round(c, 6)
TZ = f"{ACT}, tz AS (SELECT u, tr, z, SUM(fr) AS s, COUNT(*) AS n FROM act GROUP BY 1,2,3)"


def _trial_zones(spark, d):
    return activity(spark, d).groupBy("u", "tr", "z").agg(F.sum("fr").alias("s"), F.count("*").alias("n"))


@query("d9_zone_rates", f"WITH {ACT} SELECT u, z, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*)>=3 THEN AVG(COALESCE(fr,0)) END,6) AS m FROM act GROUP BY 1,2")
def d9(spark, d):
    return activity(spark, d).groupBy("u", "z").agg(F.count("*").alias("n"), R(F.when(F.count("*") >= 3, F.avg(F.coalesce("fr", F.lit(0.0))))).alias("m"))


@query("d10_trial_zone_rates", f"WITH {TZ} SELECT u, tr, z, ROUND(s/n,6) AS m, n FROM tz")
def d10(spark, d):
    return _trial_zones(spark, d).select("u", "tr", "z", R(F.col("s") / F.col("n")).alias("m"), "n")


@query("d11_zone_hierarchy", f"WITH {TZ} SELECT u, SUBSTR(z,1,7) AS seg, CAST(SUM(n) AS BIGINT) AS n, ROUND(CASE WHEN SUM(n)>=5 THEN SUM(s)/SUM(n) END,6) AS m FROM tz GROUP BY 1,2")
def d11(spark, d):
    g = A.weighted_levels(_trial_zones(spark, d).withColumn("seg", F.substring("z", 1, 7)), ["u"], "seg", "s", "n", 5)
    return g.select("u", "seg", "n", R("m").alias("m"))


@query("d12_across_trials", f"WITH {TZ} SELECT u, z, ROUND(AVG(s/n),6) AS m, ROUND(AVG(s/n)/NULLIF(STDDEV_SAMP(s/n),0),5) AS score, ROUND(SUM(s)/SUM(n),6) AS rw FROM tz GROUP BY 1,2")
def d12(spark, d):
    r = F.col("s") / F.col("n")
    sd = F.stddev_samp(r)
    return _trial_zones(spark, d).groupBy("u", "z").agg(R(F.avg(r)).alias("m"), F.round(F.avg(r) / F.when(sd != 0, sd), 5).alias("score"), R(F.sum("s") / F.sum("n")).alias("rw"))


@query("d13_unit_summary", f"WITH {ACT} SELECT u, COUNT(*) AS n, ROUND(AVG(fr),6) AS m, ROUND(STDDEV_SAMP(fr),6) AS sd, ROUND(AVG(CASE WHEN st='F' THEN fr END),6) AS m_f, ROUND(AVG(CASE WHEN st='O' THEN fr END),6) AS m_o FROM act GROUP BY u")
def d13(spark, d):
    on = lambda s: F.avg(F.when(F.col("st") == s, F.col("fr")))
    return activity(spark, d).groupBy("u").agg(F.count("*").alias("n"), R(F.avg("fr")).alias("m"), R(F.stddev_samp("fr")).alias("sd"), R(on("F")).alias("m_f"), R(on("O")).alias("m_o"))


@query("d14_information", f"WITH {ACT}, g AS (SELECT u, z, SUM(fr) AS f, COUNT(*) AS n FROM act GROUP BY 1,2), p AS (SELECT u, f/SUM(f) OVER (PARTITION BY u) AS f, n/SUM(n) OVER (PARTITION BY u) AS p FROM g) SELECT u, ROUND(SUM(CASE WHEN f>0 AND p>0 THEN f*LOG2(f/p) END),6) AS info FROM p GROUP BY u")
def d14(spark, d):
    g = activity(spark, d).groupBy("u", "z").agg(F.sum("fr").alias("f"), F.count("*").alias("n"))
    return A.spatial_information(g, ["u"], "z", "f", "n").select("u", R("info").alias("info"))


@query("d15_tuning_curve", f"WITH {ACT} SELECT CAST(FLOOR(x/5000) AS BIGINT) AS b, ROUND(AVG(fr),6) AS m, ROUND(STDDEV_POP(fr),6) AS sd, COUNT(*) AS n, ROUND(MEDIAN(fr),6) AS med, ROUND(QUANTILE_CONT(fr,0.05),6) AS lo, ROUND(QUANTILE_CONT(fr,0.95),6) AS hi FROM act GROUP BY 1")
def d15(spark, d):
    q = lambda p: R(F.percentile("fr", F.lit(p)))
    return activity(spark, d).groupBy(S.uniform_bin("x", 0, 5000).alias("b")).agg(R(F.avg("fr")).alias("m"), R(F.stddev_pop("fr")).alias("sd"), F.count("*").alias("n"), R(F.median("fr")).alias("med"), q(0.05).alias("lo"), q(0.95).alias("hi"))


@query("d5_histogram_2d", f"WITH {ACT} SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, CAST(FLOOR(fr/10) AS BIGINT) AS yb, COUNT(*) AS n, ROUND(SUM(fr),4) AS w FROM act GROUP BY 1,2")
def d5(spark, d):
    return activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), S.uniform_bin("fr", 0, 10).alias("yb")).agg(F.count("*").alias("n"), F.round(F.sum("fr"), 4).alias("w"))


@query("d6_rate_map", f"WITH {ACT}, g AS (SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, CAST(ln AS BIGINT) AS yb, COUNT(*) AS n, SUM(fr) AS w FROM act GROUP BY 1,2) SELECT xb, yb, ROUND(CASE WHEN n>=4 THEN w/n ELSE 0 END,6) AS rate FROM g")
def d6(spark, d):
    g = activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.count("*").alias("n"), F.sum("fr").alias("w"))
    return g.select("xb", "yb", R(F.when(F.col("n") >= 4, F.col("w") / F.col("n")).otherwise(0.0)).alias("rate"))


@query("d19_pearson", f"WITH {ACT} SELECT u, ROUND(CORR(x,fr),6) AS r, COUNT(*) AS n FROM act GROUP BY u")
def d19(spark, d):
    return A.pearson(activity(spark, d), ["u"], "x", "fr").select("u", R("r").alias("r"), "n")


RK = "RANK() OVER (PARTITION BY u ORDER BY {c})+(COUNT(*) OVER (PARTITION BY u,{c})-1)/2.0"


@query("d19_spearman", f"WITH {ACT}, k AS (SELECT u, {RK.format(c='ln')} AS a, {RK.format(c='fr')} AS b FROM act) SELECT u, ROUND(CORR(a,b),6) AS r, COUNT(*) AS n FROM k GROUP BY u")
def d19s(spark, d):
    return A.spearman(activity(spark, d), ["u"], "ln", "fr").select("u", R("r").alias("r"), "n")


@query("d19_kendall", f"WITH {ACT}, g AS (SELECT u, z, CAST(SUM(fr) AS BIGINT) AS a, COUNT(*) AS b FROM act GROUP BY 1,2), p AS (SELECT x.u, SIGN(x.a-y.a) AS sx, SIGN(x.b-y.b) AS sy FROM g x JOIN g y ON x.u=y.u AND x.z<y.z) SELECT u, ROUND(CASE WHEN SUM(ABS(sx))>0 AND SUM(ABS(sy))>0 THEN SUM(sx*sy)/SQRT(SUM(ABS(sx))*SUM(ABS(sy))) END,6) AS tau FROM p GROUP BY u")
def d19k(spark, d):
    g = activity(spark, d).groupBy("u", "z").agg(F.sum("fr").cast("long").alias("a"), F.count("*").alias("b"))
    return A.kendall(g, ["u"], "z", "a", "b").select("u", R("tau").alias("tau"))


@query("d20_rowwise_corr", f"WITH {ACT}, g AS (SELECT u, z, AVG(CASE WHEN tr%2=1 THEN fr END) AS a, AVG(CASE WHEN tr%2=0 THEN fr END) AS b FROM act GROUP BY 1,2) SELECT u, ROUND(CORR(a,b),6) AS r FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY u")
def d20(spark, d):
    part = lambda k: activity(spark, d).filter(F.col("tr") % 2 == k).groupBy("u", "z").agg(F.avg("fr").alias(f"m{k}"))
    return part(1).join(part(0), ["u", "z"]).groupBy("u").agg(R(F.corr("m1", "m0")).alias("r"))


@query("d22_mad", f"WITH {ACT}, m AS (SELECT u, MEDIAN(fr) AS med FROM act GROUP BY u) SELECT u, ROUND(MIN(med),6) AS med, ROUND(MEDIAN(ABS(fr-med)),6) AS mad FROM act JOIN m USING (u) GROUP BY u")
def d22(spark, d):
    return A.mad(activity(spark, d), ["u"], "fr").select("u", R("med").alias("med"), R("mad").alias("mad"))


@query("d23_zscore", f"WITH {ACT} SELECT tr, ln, ROUND(CASE WHEN STDDEV_POP(fr) OVER w>0 THEN (fr-AVG(fr) OVER w)/STDDEV_POP(fr) OVER w ELSE 0 END,6) AS zs FROM act WINDOW w AS (PARTITION BY u)")
def d23(spark, d):
    a = activity(spark, d)
    of_unit = a.groupBy("u").agg(F.avg("fr").alias("mean"), F.stddev_pop("fr").alias("sd"))
    return a.join(of_unit, "u").select("tr", "ln", R(F.when(F.col("sd") > 0, (F.col("fr") - F.col("mean")) / F.col("sd")).otherwise(0.0)).alias("zs"))


@query("d24_signal_stats", f"WITH {ACT} SELECT z, ROUND(STDDEV_POP(fr),6) AS sd, MIN(fr) AS lo, MAX(fr) AS hi FROM act GROUP BY z")
def d24(spark, d):
    return activity(spark, d).groupBy("z").agg(R(F.stddev_pop("fr")).alias("sd"), F.min("fr").alias("lo"), F.max("fr").alias("hi"))


PRED = f"{ACT}, m AS (SELECT u, tr%2 AS f, AVG(fr) AS pred FROM act GROUP BY 1,2), yp AS (SELECT act.u, fr AS y, pred FROM act JOIN m ON act.u=m.u AND act.tr%2<>m.f)"


@query("d25_regression_metrics", f"WITH {PRED} SELECT u, COUNT(*) AS n, ROUND(CASE WHEN VAR_POP(y)>0 THEN 1-SUM((y-pred)*(y-pred))/(COUNT(*)*VAR_POP(y)) END,6) AS r2, ROUND(SUM((y-pred)*(y-pred))/COUNT(*),6) AS mse, ROUND(2*SUM(CASE WHEN y>0 THEN y*LN(y/pred)-(y-pred) ELSE pred END),4) AS deviance FROM yp GROUP BY u")
def d25(spark, d):
    a = activity(spark, d)
    m = a.groupBy("u", (1 - F.col("tr") % 2).alias("f")).agg(F.avg("fr").alias("pred"))  # each half is predicted by the other
    g = A.regression_metrics(a.withColumn("f", F.col("tr") % 2).join(m, ["u", "f"]), ["u"], "fr", "pred")
    return g.select("u", "n", R("r2").alias("r2"), R("mse").alias("mse"), F.round("deviance", 4).alias("deviance"))


@query("d26_slope_error", f"WITH {ACT} SELECT u, ROUND(REGR_SLOPE(fr,x)*1000,6) AS slope, ROUND(REGR_INTERCEPT(fr,x),6) AS icpt, ROUND(1000*SQRT(VAR_POP(fr)*(1-CORR(x,fr)*CORR(x,fr))/VAR_POP(x)/(COUNT(*)-2)),6) AS se FROM act GROUP BY u HAVING COUNT(*)>2")
def d26(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.regr_slope("fr", "x").alias("b"), F.regr_intercept("fr", "x").alias("a"), F.var_pop("fr").alias("vy"), F.var_pop("x").alias("vx"), F.corr("x", "fr").alias("r"), F.count("*").alias("n")).filter("n > 2")
    return g.select("u", R(F.col("b") * 1000).alias("slope"), R("a").alias("icpt"), R(1000 * F.sqrt(F.col("vy") * (1 - F.col("r") * F.col("r")) / F.col("vx") / (F.col("n") - 2))).alias("se"))


@query("d27_mann_whitney", f"WITH {ACT}, k AS (SELECT u, st='F' AS a, {RK.format(c='fr')} AS r FROM act), g AS (SELECT u, COUNT(*) FILTER (a) AS n1, COUNT(*) FILTER (NOT a) AS n2, SUM(CASE WHEN a THEN r ELSE 0 END) AS r1 FROM k GROUP BY u) SELECT u, n1, n2, ROUND(r1-n1*(n1+1)/2.0,6) AS uu, ROUND(CASE WHEN n1*n2>0 THEN (r1-n1*(n1+1)/2.0-n1*n2/2.0)/SQRT(CAST(n1*n2*(n1+n2+1) AS DOUBLE)/12) END,6) AS zz FROM g")
def d27(spark, d):
    g = A.mann_whitney(activity(spark, d).withColumnRenamed("u", "unit"), ["unit"], "fr", F.col("st") == "F")
    return g.select(F.col("unit").alias("u"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), R("u").alias("uu"), R("z").alias("zz"))


TT = "COUNT(CASE WHEN st='F' THEN fr END) AS n1, COUNT(CASE WHEN st<>'F' THEN fr END) AS n2, AVG(CASE WHEN st='F' THEN fr END) AS m1, AVG(CASE WHEN st<>'F' THEN fr END) AS m2, VAR_SAMP(CASE WHEN st='F' THEN fr END) AS v1, VAR_SAMP(CASE WHEN st<>'F' THEN fr END) AS v2"


@query("d28_t_test", f"WITH {ACT}, g AS (SELECT u, {TT} FROM act GROUP BY u) SELECT u, ROUND((m1-m2)/NULLIF(SQRT(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1.0/n1+1.0/n2)),0),6) AS t, ROUND((m1-m2)/NULLIF(SQRT(v1/n1+v2/n2),0),6) AS w FROM g WHERE n1>1 AND n2>1")
def d28(spark, d):
    a = activity(spark, d)
    one = A.t_test(a, ["u"], "fr", F.col("st") == "F").filter("n1 > 1 and n2 > 1")
    two = A.t_test(a, ["u"], "fr", F.col("st") == "F", welch=True)
    return one.select("u", R("t").alias("t")).join(two.select("u", R("t").alias("w")), "u")


@query("d30_condition_means", f"WITH {ACT} SELECT cond, z, ROUND(AVG(fr),6) AS m, COUNT(*) AS n, ROUND(AVG(fr)/NULLIF(STDDEV_SAMP(fr),0),6) AS score FROM act GROUP BY 1,2")
def d30(spark, d):
    sd = F.stddev_samp("fr")
    return activity(spark, d).groupBy("cond", "z").agg(R(F.avg("fr")).alias("m"), F.count("*").alias("n"), R(F.avg("fr") / F.when(sd != 0, sd)).alias("score"))


@query("d36_pivot", f"WITH {ACT} SELECT u, ROUND(AVG(CASE WHEN st='F' THEN fr END),6) AS F, ROUND(AVG(CASE WHEN st='O' THEN fr END),6) AS O, ROUND(AVG(CASE WHEN st='P' THEN fr END),6) AS P FROM act WHERE st IN ('F','O','P') GROUP BY u")
def d36(spark, d):
    g = A.pivot_mean(activity(spark, d), ["u"], ["st"], "fr", ["F", "O", "P"]).filter("F is not null or O is not null or P is not null")
    return g.select("u", *[R(c).alias(c) for c in ("F", "O", "P")])


@query("d37_unpivot", "SELECT p_partkey AS id, UNNEST(['retail-price','retail-size']) AS name, UNNEST([p_retailprice, CAST(p_size AS DOUBLE)]) AS v, UNNEST(['price','size']) AS part FROM part")
def d37(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("retail-price"), F.col("p_size").cast("double").alias("retail-size"))
    return p.unpivot(["id"], ["retail-price", "retail-size"], "name", "v").withColumn("part", F.split("name", "-")[1])


@query("d38_crosstab", f"WITH {ACT} SELECT cond, COUNT(*) FILTER (st='F') AS F, COUNT(*) FILTER (st='O') AS O FROM act GROUP BY cond")
def d38(spark, d):
    g = activity(spark, d).groupBy("cond").pivot("st", ["F", "O"]).count()
    return g.select("cond", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


CLS = "cls AS (SELECT l_returnflag AS y, CASE WHEN l_discount>0.06 THEN 'A' WHEN l_discount>0.03 THEN 'N' ELSE 'R' END AS p FROM lineitem)"


def _classes(spark, d):
    c = F.when(F.col("l_discount") > 0.06, "A").when(F.col("l_discount") > 0.03, "N").otherwise("R")
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), c.alias("p"))


@query("d40_classification", f"WITH {CLS}, r AS (SELECT y, AVG(CASE WHEN y=p THEN 1.0 ELSE 0 END) AS rec, COUNT(*) AS n FROM cls GROUP BY y) SELECT ROUND(SUM(rec*n)/SUM(n),6) AS acc, ROUND(AVG(rec),6) AS bac, ROUND(-SUM(n/(SELECT SUM(n) FROM r)*LN(n/(SELECT SUM(n) FROM r))),6) AS chance FROM r")
def d40(spark, d):
    r = _classes(spark, d).groupBy("y").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("rec"), F.count("*").alias("n"))
    share = r.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each class
    return share.agg(R(F.sum(F.col("rec") * F.col("q"))).alias("acc"), R(F.avg("rec")).alias("bac"), R(-F.sum(F.col("q") * F.ln("q"))).alias("chance"))


@query("d41_confusion", f"WITH {CLS} SELECT y, ROUND(AVG(CASE WHEN p='A' THEN 1.0 ELSE 0 END),6) AS A, ROUND(AVG(CASE WHEN p='N' THEN 1.0 ELSE 0 END),6) AS N, ROUND(AVG(CASE WHEN p='R' THEN 1.0 ELSE 0 END),6) AS R FROM cls GROUP BY y")
def d41(spark, d):
    g = _classes(spark, d).groupBy("y").pivot("p", ["A", "N", "R"]).count().na.fill(0)
    n = F.col("A") + F.col("N") + F.col("R")
    return g.select("y", *[R(F.col(c) / n).alias(c) for c in "ANR"])


@query("d46_amplitude_histogram", f"WITH {ACT} SELECT z, CAST(FLOOR(fr/5) AS BIGINT) AS b, COUNT(*) AS n FROM act WHERE x<50000 GROUP BY 1,2")
def d46(spark, d):
    return activity(spark, d).filter("x < 50000").groupBy("z", S.uniform_bin("fr", 0, 5).alias("b")).agg(F.count("*").alias("n"))


@query("d49_overlap", f"WITH {ACT}, g AS (SELECT u, AVG(fr)>25.5 AS a, AVG(x)>38000 AS b FROM act GROUP BY u) SELECT COUNT(*) FILTER (a AND b) AS both, COUNT(*) FILTER (a AND NOT b) AS only_a, COUNT(*) FILTER (b AND NOT a) AS only_b FROM g")
def d49(spark, d):
    g = activity(spark, d).groupBy("u").agg((F.avg("fr") > 25.5).alias("a"), (F.avg("x") > 38000).alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query("d50_subject_means", f"WITH {ACT}, g AS (SELECT u, AVG(fr) AS m FROM act GROUP BY u) SELECT s_nationkey AS nation, ROUND(AVG(m),6) AS m, ROUND(MEDIAN(m),6) AS med, COUNT(*) AS n FROM g JOIN supplier ON u=s_suppkey GROUP BY 1")
def d50(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.avg("fr").alias("m"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.col("s_nationkey").alias("nation"))
    return g.join(s, "u").groupBy("nation").agg(R(F.avg("m")).alias("m"), R(F.median("m")).alias("med"), F.count("*").alias("n"))


@query("d52_quantile_groups", f"WITH {ACT}, g AS (SELECT tr, COUNT(*) AS n, AVG(fr) AS m FROM act GROUP BY tr), e AS (SELECT QUANTILE_CONT(n,1.0/3) AS a, QUANTILE_CONT(n,2.0/3) AS b FROM g) SELECT CAST(CASE WHEN n>b THEN 2 WHEN n>a THEN 1 ELSE 0 END AS BIGINT) AS part, COUNT(*) AS k, ROUND((AVG(m)-25)/(STDDEV_SAMP(m)/SQRT(COUNT(*))),4) AS t FROM g, e GROUP BY 1")
def d52(spark, d):
    g = activity(spark, d).groupBy("tr").agg(F.count("*").alias("n"), F.avg("fr").alias("m"))
    return A.quantile_groups(g, "n", 3, "part").groupBy("part").agg(F.count("*").alias("k"), F.round((F.avg("m") - 25) / (F.stddev_samp("m") / F.sqrt(F.count("*"))), 4).alias("t"))


@query("d53_kolmogorov_smirnov", f"WITH {ACT}, c AS (SELECT u, fr, SUM(CASE WHEN st='F' THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN st='F' THEN 0 ELSE 1 END) AS b FROM act GROUP BY 1,2), k AS (SELECT u, ABS(SUM(a) OVER r/SUM(a) OVER w - SUM(b) OVER r/SUM(b) OVER w) AS dd FROM c WINDOW w AS (PARTITION BY u), r AS (PARTITION BY u ORDER BY fr)) SELECT u, ROUND(MAX(dd),6) AS ks FROM k GROUP BY u")
def d53(spark, d):
    return A.kolmogorov_smirnov(activity(spark, d), ["u"], "fr", F.col("st") == "F").select("u", R("ks").alias("ks"))


@query("e19_cap_and_scale", f"WITH {ACT}, p AS (SELECT u, QUANTILE_CONT(fr,0.95) AS c FROM act GROUP BY u) SELECT tr, ln, ROUND(LEAST(fr,c)/c,6) AS v FROM act JOIN p USING (u)")
def e19(spark, d):
    a = activity(spark, d)
    return a.join(a.groupBy("u").agg(F.percentile("fr", F.lit(0.95)).alias("c")), "u").select("tr", "ln", R(F.least("fr", "c") / F.col("c")).alias("v"))


@query("e20_fold_normalise", f"WITH {ACT}, f AS (SELECT u, tr%5 AS f, COUNT(*) AS n, SUM(fr) AS s, SUM(fr*fr) AS q FROM act GROUP BY 1,2), m AS (SELECT a.u, a.f, SUM(b.s)/SUM(b.n) AS m, SQRT(GREATEST(SUM(b.q)/SUM(b.n)-SUM(b.s)/SUM(b.n)*SUM(b.s)/SUM(b.n),0)) AS sd FROM f a JOIN f b ON a.u=b.u AND a.f<>b.f GROUP BY 1,2) SELECT tr, ln, ROUND((fr-m)/NULLIF(sd,0),6) AS v FROM act JOIN m ON act.u=m.u AND act.tr%5=m.f")
def e20(spark, d):
    a = activity(spark, d)
    # statistics of the other folds: totals of the unit less those of the fold
    per = a.groupBy("u", (F.col("tr") % 5).alias("f")).agg(F.count("*").alias("n"), F.sum("fr").alias("s"), F.sum(F.col("fr") * F.col("fr")).alias("q"))
    total = per.groupBy("u").agg(*[F.sum(c).alias(f"{c}_all") for c in "nsq"])
    rest = per.join(total, "u").select("u", "f", *[(F.col(f"{c}_all") - F.col(c)).alias(c) for c in "nsq"]).filter("n > 0")
    m = F.col("s") / F.col("n")
    rest = rest.select("u", "f", m.alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - m * m, F.lit(0.0))).alias("sd"))
    scored = a.withColumn("f", F.col("tr") % 5).join(rest, ["u", "f"])
    return scored.select("tr", "ln", R((F.col("fr") - F.col("m")) / F.when(F.col("sd") != 0, F.col("sd"))).alias("v"))


@query("e3_cumulative_evidence", "SELECT l_orderkey AS tr, CAST(l_linenumber AS BIGINT) AS ln, ROUND(SUM(LN((l_tax+0.01)/(1-l_tax-0.01))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber),6) AS ev FROM lineitem")
def e3(spark, d):
    li = read(spark, d, "lineitem").withColumn("p", F.col("l_tax") + 0.01)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return li.select(F.col("l_orderkey").alias("tr"), F.col("l_linenumber").cast("long").alias("ln"), R(F.sum(F.ln(F.col("p") / (1 - F.col("l_tax") - 0.01))).over(w)).alias("ev"))


@query("c1_unit_metadata", f"WITH {ACT}, g AS (SELECT u, COUNT(*) AS n FROM act GROUP BY u) SELECT u, n, s_name AS name, n_name AS nation FROM g JOIN supplier ON u=s_suppkey JOIN nation ON s_nationkey=n_nationkey")
def c1(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.count("*").alias("n"))
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return g.join(s, g.u == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select("u", "n", F.col("s_name").alias("name"), F.col("n_name").alias("nation"))


@query("c3_combine_scores", f"WITH {ACT}, a AS (SELECT u, ROUND(AVG(fr),6) AS a FROM act WHERE st='P' GROUP BY u), b AS (SELECT u, ROUND(AVG(fr),6) AS b FROM act WHERE cond='1-URGENT' GROUP BY u) SELECT s_suppkey AS u, a, b FROM supplier LEFT JOIN a ON s_suppkey=a.u LEFT JOIN b ON s_suppkey=b.u")
def c3(spark, d):
    a = activity(spark, d)
    units = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"))
    one = a.filter("st = 'P'").groupBy("u").agg(R(F.avg("fr")).alias("a"))
    two = a.filter("cond = '1-URGENT'").groupBy("u").agg(R(F.avg("fr")).alias("b"))
    return units.join(one, "u", "left").join(two, "u", "left")


@query("c4_matched_pairs", "SELECT a.s_nationkey AS m, a.s_suppkey AS a, b.s_suppkey AS b, ROW_NUMBER() OVER (PARTITION BY a.s_nationkey ORDER BY a.s_suppkey, b.s_suppkey)-1 AS n FROM supplier a JOIN supplier b ON a.s_nationkey=b.s_nationkey AND a.s_suppkey%2=0 AND b.s_suppkey%2=1")
def c4(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("m"), F.col("s_suppkey").alias("k"))
    pairs = s.filter("k % 2 = 0").withColumnRenamed("k", "a").join(s.filter("k % 2 = 1").withColumnRenamed("k", "b"), "m")
    return pairs.withColumn("n", (F.row_number().over(Window.partitionBy("m").orderBy("a", "b")) - 1).cast("long"))


@query("c12_point_in_polygon", f"WITH {ACT}, q AS (SELECT z, (CASE WHEN (0>fr)<>(40>fr) AND x<(60000-10000)*(fr-0)/(40-0)+10000 THEN 1 ELSE 0 END)+(CASE WHEN (40>fr)<>(0>fr) AND x<(90000-60000)*(fr-40)/(0-40)+60000 THEN 1 ELSE 0 END) AS c FROM act) SELECT z, COUNT(*) FILTER (c%2=1) AS inside, COUNT(*) AS n FROM q GROUP BY z")
def c12(spark, d):
    ring = [(10000.0, 0.0), (60000.0, 40.0), (90000.0, 0.0)]
    return activity(spark, d).groupBy("z").agg(F.count_if(S.point_in_polygon("x", "fr", ring)).alias("inside"), F.count("*").alias("n"))


@query("b3_rotate", "SELECT p_partkey AS id, ROUND(p_retailprice*COS(0.5)+p_size*SIN(0.5),6) AS x, ROUND(p_size*COS(0.5)-p_retailprice*SIN(0.5),6) AS y FROM part")
def b3(spark, d):
    x, y = S.rotate("p_retailprice", "p_size", 0.5)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R(x).alias("x"), R(y).alias("y"))


@query("b15_edges", "SELECT p_partkey AS id, CAST((CASE WHEN p_size>=5 THEN 1 ELSE 0 END)+(CASE WHEN p_size>=20 THEN 1 ELSE 0 END)+(CASE WHEN p_size>=40 THEN 1 ELSE 0 END) AS BIGINT) AS b FROM part")
def b15(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.edge_bin("p_size", [5, 20, 40]).alias("b"))


@query("b13_blank_outliers", "SELECT c_custkey AS id, CASE WHEN ABS(c_acctbal/10000)<=0.5 THEN ROUND(c_acctbal/10000,6) END AS r2 FROM customer")
def b13(spark, d):
    r = F.col("c_acctbal") / 10000
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.abs(r) <= 0.5, R(r)).alias("r2"))


@query("f2_top_units", f"WITH {ACT}, g AS (SELECT z, u, AVG(fr) AS m FROM act GROUP BY 1,2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY m, u) AS n FROM g) SELECT z, u, n FROM r WHERE n<=3")
def f2(spark, d):
    g = activity(spark, d).groupBy("z", "u").agg(F.avg("fr").alias("m"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("z").orderBy("m", "u")).cast("long")).filter("n <= 3").select("z", "u", "n")


@query("f3_extreme_units", f"WITH {ACT}, g AS (SELECT z, u, AVG(fr) AS m FROM act GROUP BY 1,2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY m, u) AS lo, ROW_NUMBER() OVER (PARTITION BY z ORDER BY m DESC, u) AS hi FROM g) SELECT z, u, 'low' AS side, lo AS n FROM r WHERE lo<=2 UNION ALL SELECT z, u, 'high', hi FROM r WHERE hi<=2")
def f3(spark, d):
    g = activity(spark, d).groupBy("z", "u").agg(F.avg("fr").alias("m"))
    take = lambda side, order: g.withColumn("n", F.row_number().over(Window.partitionBy("z").orderBy(order, "u")).cast("long")).filter("n <= 2").select("z", "u", F.lit(side).alias("side"), "n")
    return take("low", F.asc("m")).unionByName(take("high", F.desc("m")))


@query("h1_transforms", "SELECT p_partkey AS id, ROUND(LN((p_size/60.0)/(1-p_size/60.0)),6) AS lg, ROUND(1/(1+EXP(-(p_size-25)/10.0)),6) AS ex, ROUND(0.5*LN((1+p_size/60.0)/(1-p_size/60.0)),6) AS fz, ROUND(SIN(p_size/60.0*PI()/2),6) AS kp FROM part")
def h1(spark, d):
    q = F.col("p_size") / 60.0
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R(S.logit(q)).alias("lg"), R(S.expit((F.col("p_size") - 25) / 10.0)).alias("ex"), R(S.fisher_z(q)).alias("fz"), R(S.kendall_to_pearson(q)).alias("kp"))


@query("i16_compare_correlations", f"WITH {ACT}, g AS (SELECT u, CORR(x,fr) AS r1, CORR(ln,fr) AS r2, COUNT(*) AS n FROM act GROUP BY u HAVING COUNT(*)>3) SELECT u, ROUND((ATANH(r1)-ATANH(r2))/SQRT(2.0/(n-3)),6) AS z FROM g WHERE ABS(r1)<1 AND ABS(r2)<1")
def i16(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.corr("x", "fr").alias("r1"), F.corr("ln", "fr").alias("r2"), F.count("*").alias("n")).filter("n > 3 and abs(r1) < 1 and abs(r2) < 1")
    return g.select("u", R(S.compare_correlations("r1", "r2", "n", "n")).alias("z"))


PV = f"{ACT}, pv AS (SELECT z, u, (COUNT(*)%17+1)/20.0+u/1e7 AS p FROM act GROUP BY 1,2)"


@query("i18_multiple_testing", f"WITH {PV}, k AS (SELECT *, COUNT(*) OVER (PARTITION BY z) AS m, ROW_NUMBER() OVER (PARTITION BY z ORDER BY p) AS k FROM pv) SELECT z, u, ROUND(LEAST(1,p*m),6) AS bonferroni, ROUND(LEAST(1,MAX(p*(m-k+1)) OVER (PARTITION BY z ORDER BY k ROWS UNBOUNDED PRECEDING)),6) AS holm, ROUND(LEAST(1,MIN(p*m/k) OVER (PARTITION BY z ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),6) AS bh FROM k")
def i18(spark, d):
    p = activity(spark, d).groupBy("z", "u").agg(((F.count("*") % 17 + 1) / 20.0).alias("p")).withColumn("p", F.col("p") + F.col("u") / 1e7)
    return A.benjamini_hochberg(p, ["z"], "p").select("z", "u", *[R(c).alias(c) for c in ("bonferroni", "holm", "bh")])


@query("i3_bootstrap_correlation", f"""WITH {ACT}, g AS (SELECT u, ROW_NUMBER() OVER (PARTITION BY u ORDER BY tr, ln, x, fr)-1 AS i, COUNT(*) OVER (PARTITION BY u) AS n, x, fr FROM act),
r AS (SELECT u, n, rep, i AS draw, ('0x'||SUBSTR(MD5(CONCAT_WS('|','7',u,rep,i)),1,8))::BIGINT % n AS pick FROM g, UNNEST(range(0,100)) AS q(rep)), b AS (SELECT r.u, rep, CORR(g.x,g.fr) AS c FROM r JOIN g ON r.u=g.u AND r.pick=g.i GROUP BY 1,2) SELECT u, ROUND(AVG(c),6) AS m, COUNT(*) AS reps FROM b GROUP BY u""")
def i3(spark, d):
    g = V.mean_bootstrap(activity(spark, d), "u", ["tr", "ln", "x", "fr"], "x", "fr", 7, 100)
    return g.select("u", R("m").alias("m"), "reps")


@query("i20_stratified_folds", f"WITH {ACT}, t AS (SELECT DISTINCT tr, st FROM act), f AS (SELECT tr, st, NTILE(5) OVER (PARTITION BY st ORDER BY MD5(CONCAT_WS('|','3',tr)), tr)-1 AS fold FROM t) SELECT st, CAST(fold AS BIGINT) AS fold, COUNT(*) AS n, CAST(SUM(tr) AS BIGINT) AS ids FROM f GROUP BY 1,2")
def i20(spark, d):
    t = activity(spark, d).select("tr", "st").distinct()
    f = t.withColumn("fold", (F.ntile(5).over(Window.partitionBy("st").orderBy(F.md5(F.concat_ws("|", F.lit("3"), "tr")), "tr")) - 1).cast("long"))
    return f.groupBy("st", "fold").agg(F.count("*").alias("n"), F.sum("tr").alias("ids"))


@query("j1_one_hot_regression", f"WITH {ACT}, b AS (SELECT u, tr%5 AS f, LEAST(ln,5) AS b, fr FROM act), c AS (SELECT k.f AS fold, u, b, AVG(fr) AS coef FROM b, (SELECT UNNEST(range(0,5)) AS f) k WHERE b.f<>k.f GROUP BY 1,2,3) SELECT b.f AS fold, b.u, COUNT(*) AS n, ROUND(AVG((fr-COALESCE(coef,0))*(fr-COALESCE(coef,0))),6) AS mse FROM b LEFT JOIN c ON b.f=c.fold AND b.u=c.u AND b.b=c.b GROUP BY 1,2")
def j1(spark, d):
    b = activity(spark, d).select("u", (F.col("tr") % 5).alias("f"), F.least("ln", F.lit(5)).alias("b"), "fr")
    # coefficients are bin means over the other folds: totals less those of the fold
    per = b.groupBy("u", "b", "f").agg(F.sum("fr").alias("s"), F.count("*").alias("n"))
    tot = per.groupBy("u", "b").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    coef = per.join(tot, ["u", "b"]).select("u", "b", "f", ((F.col("all_s") - F.col("s")) / F.when(F.col("all_n") > F.col("n"), F.col("all_n") - F.col("n"))).alias("coef"))
    err = F.col("fr") - F.coalesce("coef", F.lit(0.0))
    return b.join(coef, ["u", "b", "f"]).groupBy(F.col("f").alias("fold"), "u").agg(F.count("*").alias("n"), R(F.avg(err * err)).alias("mse"))


@query("j2_gram_regression", f"WITH {ACT}, g AS (SELECT u, REGR_SLOPE(fr,ln) AS b, REGR_INTERCEPT(fr,ln) AS a FROM act GROUP BY u) SELECT u, ROUND(a,6) AS a, ROUND(b,6) AS b FROM g")
def j2(spark, d):
    # normal equations of two features from one pass of sums
    s = activity(spark, d).groupBy("u").agg(F.count("*").alias("n"), F.sum("ln").alias("sx"), F.sum(F.col("ln") * F.col("ln")).alias("sxx"), F.sum("fr").alias("sy"), F.sum(F.col("ln") * F.col("fr")).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    return s.select("u", R((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("a"), R(slope).alias("b"))


@query("m3_autocorrelation", f"WITH {ACT}, g AS (SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, SUM(fr) AS v FROM act GROUP BY 1,2), p AS (SELECT b.xb-a.xb AS dx, b.yb-a.yb AS dy, SUM(a.v*b.v) AS s FROM g a, g b GROUP BY 1,2) SELECT dx, dy, ROUND(s/(SELECT s FROM p WHERE dx=0 AND dy=0),6) AS r FROM p")
def m3(spark, d):
    g = activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.sum("fr").alias("v"))
    a, b = g.select(*[F.col(c).alias(f"a{c}") for c in g.columns]), g.select(*[F.col(c).alias(f"b{c}") for c in g.columns])
    # bins of one map: a number fixed by the arena, whatever the number of samples
    p = a.join(F.broadcast(b)).groupBy((F.col("bxb") - F.col("axb")).alias("dx"), (F.col("byb") - F.col("ayb")).alias("dy")).agg(F.sum(F.col("av") * F.col("bv")).alias("s"))
    zero = F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("s"))).over(Window.partitionBy())
    return p.select("dx", "dy", R(F.col("s") / zero).alias("r"))


@query("m6_smooth_map", f"WITH {ACT}, g AS (SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, SUM(fr) AS v FROM act GROUP BY 1,2), k AS (SELECT dx, dy, EXP(-(dx*dx+dy*dy)/2.0) AS w FROM (SELECT UNNEST(range(-2,3)) AS dx), (SELECT UNNEST(range(-2,3)) AS dy)) SELECT xb+dx AS xb, yb+dy AS yb, ROUND(SUM(v*w)/(SELECT SUM(w) FROM k),4) AS v FROM g, k GROUP BY 1,2")
def m6(spark, d):
    from math import exp

    kernel = {(i, j): exp(-(i * i + j * j) / 2) for i in range(-2, 3) for j in range(-2, 3)}
    g = activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.sum("fr").alias("v"))
    cells = F.array(*[F.struct((F.col("xb") + i).alias("xb"), (F.col("yb") + j).alias("yb"), (F.col("v") * w).alias("v")) for (i, j), w in kernel.items()])
    return g.select(F.inline(cells)).groupBy("xb", "yb").agg(F.round(F.sum("v") / sum(kernel.values()), 4).alias("v"))


@query("d45_cosine_compactness", "WITH e AS (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings), c AS (SELECT label, i, AVG(v) AS c FROM e GROUP BY 1,2), s AS (SELECT e.label, vec_id, 1-SUM(v*c)/SQRT(SUM(v*v)*SUM(c*c)) AS dd FROM e JOIN c ON e.label=c.label AND e.i=c.i GROUP BY 1,2) SELECT label, ROUND(AVG(dd),5) AS dist, COUNT(*) AS n FROM s GROUP BY label")
def d45(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    c = e.groupBy("label", "i").agg(F.avg("v").alias("c"))
    s = e.join(c, ["label", "i"]).groupBy("label", "vec_id").agg((1 - F.sum(F.col("v") * F.col("c")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("c") * F.col("c")))).alias("dd"))
    return s.groupBy("label").agg(F.round(F.avg("dd"), 5).alias("dist"), F.count("*").alias("n"))

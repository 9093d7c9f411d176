"""Scores that complete the statistics: corrected angles, adjusted metrics, probabilities, p-values, all partitions, grid scores."""

from __future__ import annotations

from math import exp, pi

from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import maps as M
from tracklane.operators import replicates as V
from tracklane.operators import resample as B
from tracklane.operators import sequence as Q
from tracklane.plans.contrast_plans import ANG, PERM, REPS, _angles, _zone_means
from tracklane.plans.rate_plans import PRED
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, EV, activity, events, read

R = lambda c: F.round(c, 6)


@query("d16_circular_corrected", f"WITH {ANG}, g AS (SELECT ev, SUM(v) AS w, SUM(v*COS(2*th)) AS c, SUM(v*SIN(2*th)) AS sn FROM a GROUP BY ev), r AS (SELECT *, SQRT(c*c+sn*sn)/w*(PI()/24)/SIN(PI()/24) AS r FROM g) SELECT ev, ROUND(r,5) AS r, ROUND(CASE WHEN ATAN2(sn,c)<0 THEN ATAN2(sn,c)+2*PI() ELSE ATAN2(sn,c) END,5) AS mean, ROUND(1-r,5) AS var, ROUND(SQRT(-2*LN(r)),5) AS sd FROM r")
def d16(spark, d):
    g = A.binned_circular(_angles(spark, d), ["ev"], "th", "v", pi / 12, axial=2)
    return g.select("ev", *[F.round(c, 5).alias(c) for c in ("r", "mean", "var")], F.round("std", 5).alias("sd"))


@query("d24_signal_mad", f"WITH {ACT}, m AS (SELECT z, MEDIAN(fr) AS med FROM act GROUP BY z) SELECT act.z, ROUND(STDDEV_POP(fr),6) AS sd, ROUND(MEDIAN(ABS(fr-med)),6) AS mad, MIN(fr) AS lo, MAX(fr) AS hi FROM act JOIN m ON act.z=m.z GROUP BY act.z")
def d24(spark, d):
    a = activity(spark, d)
    g = a.groupBy("z").agg(R(F.stddev_pop("fr")).alias("sd"), F.min("fr").alias("lo"), F.max("fr").alias("hi"))
    return g.join(A.mad(a, ["z"], "fr").select("z", R("mad").alias("mad")), "z")


@query("d25_adjusted_metrics", f"WITH {PRED}, g AS (SELECT u, COUNT(*) AS n, 1-SUM((y-pred)*(y-pred))/NULLIF(COUNT(*)*VAR_POP(y),0) AS r2, 2*SUM(CASE WHEN y>0 THEN y*LN(y/pred)-(y-pred) ELSE pred END) AS dev, 2*(SUM(CASE WHEN y>0 THEN y*LN(y) ELSE 0 END)-SUM(y)*LN(AVG(y))) AS nul, SUM((y-pred)*(y-pred)/pred) AS chi2 FROM yp GROUP BY u) SELECT u, n, ROUND(CASE WHEN n>3 THEN 1-(1-r2)*(n-1)/(n-3.0) END,5) AS adj_r2, ROUND(CASE WHEN n>3 AND nul>0 THEN 1-dev/nul*(n-1)/(n-3.0) END,5) AS adj_d2, ROUND(chi2,4) AS chi2 FROM g")
def d25(spark, d):
    a = activity(spark, d)
    m = a.groupBy("u", (1 - F.col("tr") % 2).alias("f")).agg(F.avg("fr").alias("pred"))
    g = A.adjusted_metrics(a.withColumn("f", F.col("tr") % 2).join(m, ["u", "f"]), ["u"], "fr", "pred", 2)
    return g.select("u", "n", F.round("adj_r2", 5).alias("adj_r2"), F.round("adj_d2", 5).alias("adj_d2"), F.round("chi2", 4).alias("chi2"))


STUDENT = "c AS (SELECT *, ATAN(ABS(t)/SQRT(df)) AS th FROM g), a AS (SELECT *, CASE WHEN df=1 THEN 2*th/PI() WHEN df%2=1 THEN 2/PI()*(th+SIN(th)*LIST_SUM(LIST_TRANSFORM(RANGE(0,(df-1)//2), lambda k: SQRT(PI())/2*EXP(LGAMMA(k+1)-LGAMMA(k+1.5))*POW(COS(th),2*k+1)))) ELSE SIN(th)*LIST_SUM(LIST_TRANSFORM(RANGE(0,df//2), lambda k: EXP(LGAMMA(k+0.5)-LGAMMA(k+1))/SQRT(PI())*POW(COS(th),2*k))) END AS inner_p FROM c)"


@query("d28_one_sample_t", f"WITH {ACT}, g AS (SELECT u, COUNT(fr)-1 AS df, (AVG(fr)-25)/NULLIF(STDDEV_SAMP(fr)/SQRT(COUNT(fr)),0) AS t FROM act GROUP BY u), {STUDENT} SELECT u, df, ROUND(t,6) AS t, ROUND(1-inner_p,6) AS p FROM a WHERE df>0")
def d28(spark, d):
    g = A.one_sample_t(activity(spark, d), ["u"], "fr", 25).withColumn("df", F.col("n") - 1).filter("df > 0")
    return g.select("u", "df", R("t").alias("t"), R(S.student_tail("t", "df")).alias("p"))


@query("d33_interval_summary", f"WITH {EV}, l AS (SELECT s, t, t-LAG(t) OVER (PARTITION BY s ORDER BY t, id) AS isi FROM ev) SELECT s, COUNT(*) AS n, ROUND(COUNT(*)/NULLIF(MAX(t)-MIN(t),0)*86400,6) AS rate, ROUND(STDDEV_POP(isi)/NULLIF(AVG(isi),0),6) AS cv FROM l GROUP BY s")
def d33(spark, d):
    g = Q.interval_summary(events(spark, d), ["s"], "t", ["t", "id"])
    return g.select("s", "n", R(F.col("rate") * 86400).alias("rate"), R("cv").alias("cv"))


@query("d33_interval_histogram", f"WITH {EV}, l AS (SELECT s, t-LAG(t) OVER (PARTITION BY s ORDER BY t, id) AS isi FROM ev) SELECT s, CAST(FLOOR(isi/21600) AS BIGINT) AS b, COUNT(*) AS n FROM l WHERE isi IS NOT NULL GROUP BY 1,2")
def d33h(spark, d):
    isi = F.col("t") - F.lag("t").over(Q.over(["s"], ["t", "id"]))
    return events(spark, d).select("s", isi.alias("isi")).filter("isi is not null").groupBy("s", S.uniform_bin("isi", 0, 21600).alias("b")).agg(F.count("*").alias("n"))


#: Probabilities of three classes from three measurements of a row.
PROB = "pr AS (SELECT l_linestatus AS split, l_returnflag AS y, (1+l_discount*20)/t AS pa, (1+l_tax*20)/t AS pn, (1+l_quantity/20)/t AS pq FROM (SELECT *, 3+l_discount*20+l_tax*20+l_quantity/20 AS t FROM lineitem))"


def _probabilities(spark, d):
    li = read(spark, d, "lineitem").withColumn("t", 3 + F.col("l_discount") * 20 + F.col("l_tax") * 20 + F.col("l_quantity") / 20)
    of = lambda c: (1 + c) / F.col("t")
    return li.select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("y"), of(F.col("l_discount") * 20).alias("pa"), of(F.col("l_tax") * 20).alias("pn"), of(F.col("l_quantity") / 20).alias("pq"))


CLASSES = {"A": "pa", "N": "pn", "R": "pq"}


@query("d40_log_loss", f"WITH {PROB}, s AS (SELECT split, y, COUNT(*)::DOUBLE AS k, SUM(-LN(CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pq END)) AS l FROM pr GROUP BY 1,2), g AS (SELECT split, SUM(k) AS n, SUM(l)/SUM(k) AS loss FROM s GROUP BY 1), c AS (SELECT s.split, -SUM(k/n*LN(k/n)) AS chance FROM s JOIN g ON s.split=g.split GROUP BY 1) SELECT g.split, CAST(n AS BIGINT) AS n, ROUND(loss,6) AS loss, ROUND(chance,6) AS chance, ROUND(CASE WHEN chance>1e-9 THEN 1-loss/chance END,5) AS score FROM g JOIN c ON g.split=c.split")
def d40l(spark, d):
    g = A.log_loss(_probabilities(spark, d), ["split"], "y", CLASSES)
    return g.select("split", "n", R("loss").alias("loss"), R(F.abs("chance")).alias("chance"), F.round(F.when(F.col("chance") > 1e-9, F.col("score")), 5).alias("score"))


@query("d40_auc", f"WITH {PROB}, x AS (SELECT split, y=a AS pos, a, b, CASE a WHEN 'A' THEN pa WHEN 'N' THEN pn ELSE pq END AS p FROM pr, (VALUES ('A','N'),('A','R'),('N','A'),('N','R'),('R','A'),('R','N')) q(a,b) WHERE y IN (a,b)), k AS (SELECT *, RANK() OVER (PARTITION BY split,a,b ORDER BY p)+(COUNT(*) OVER (PARTITION BY split,a,b,p)-1)/2.0 AS r FROM x), g AS (SELECT split, a, b, COUNT(*) FILTER (pos)::DOUBLE AS n1, COUNT(*) FILTER (NOT pos)::DOUBLE AS n2, SUM(CASE WHEN pos THEN r ELSE 0 END) AS r1 FROM k GROUP BY 1,2,3) SELECT split, ROUND(AVG((r1-n1*(n1+1)/2)/NULLIF(n1*n2,0)),6) AS auc FROM g GROUP BY split")
def d40a(spark, d):
    return A.auc_one_vs_one(_probabilities(spark, d), ["split"], "y", CLASSES).select("split", R("auc").alias("auc"))


@query("d46_masked_mad", f"WITH {EV}, k AS (SELECT * FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.s=e.s AND o.value>30 AND ABS(o.t-e.t)<=21600)), m AS (SELECT s, MEDIAN(value) AS med FROM k GROUP BY s) SELECT k.s, COUNT(*) AS n, ROUND(MIN(med),6) AS med, ROUND(MEDIAN(ABS(value-med)),6) AS mad FROM k JOIN m ON k.s=m.s GROUP BY k.s")
def d46(spark, d):
    k = Q.outside_events(events(spark, d), ["s"], "t", F.col("value") > 30, 21600)
    return k.groupBy("s").agg(F.count("*").alias("n")).join(A.mad(k, ["s"], "value").select("s", R("med").alias("med"), R("mad").alias("mad")), "s")


#: Partitions of a session: by half, cue and correctness, outcome, direction.
PARTS = {"All": "true", "H1": "tr%2=0", "H2": "tr%2<>0", "CL": "st='F' AND cond<'3'", "CR": "st='F' AND cond>='3'", "Co": "st='F'", "Inco": "st='O'", "Out": "ln<=3", "In": "ln>3"}
PT = f"{ACT}, pt AS (" + " UNION ALL ".join(f"SELECT u, z, fr, '{n}' AS part FROM act WHERE {c}" for n, c in PARTS.items()) + "), pz AS (SELECT u, part, z, SUM(fr) AS f, COUNT(*) AS n FROM pt GROUP BY 1,2,3)"


def _parts(spark, d):
    part = F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in PARTS.items()])))
    return activity(spark, d).select("u", "z", "fr", part.alias("part")).groupBy("u", "part", "z").agg(F.sum("fr").alias("f"), F.count("*").alias("n"))


@query("d48_all_partitions", f"WITH {PT}, p AS (SELECT u, part, f, n, f/SUM(f) OVER w AS q, n/SUM(n) OVER w AS o FROM pz WINDOW w AS (PARTITION BY u, part)) SELECT u, part, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(f)/SUM(n),6) AS rate, ROUND(SUM(q*LOG2(q/o)),6) AS info FROM p GROUP BY 1,2")
def d48(spark, d):
    g = _parts(spark, d)
    rate = g.groupBy("u", "part").agg(F.sum("n").alias("n"), R(F.sum("f") / F.sum("n")).alias("rate"))
    return rate.join(A.spatial_information(g, ["u", "part"], "z", "f", "n").withColumn("info", R("info")), ["u", "part"])


PAIRS = (("H1", "H2"), ("CL", "CR"), ("Co", "Inco"), ("Out", "In"))
PAIR_OF = "CASE part " + " ".join(f"WHEN '{n}' THEN '{a}-{b}'" for a, b in PAIRS for n in (a, b)) + " END"


@query("d48_partition_pairs", f"WITH {PT}, w AS (SELECT u, z, {PAIR_OF} AS pair, part IN ('H1','CL','Co','Out') AS left_side, ROUND(f/n,9) AS m FROM pz), r AS (SELECT u, pair, z, MAX(CASE WHEN left_side THEN m END) AS x, MAX(CASE WHEN NOT left_side THEN m END) AS y FROM w WHERE pair IS NOT NULL GROUP BY 1,2,3), p AS (SELECT i.u, i.pair, SIGN(i.x-j.x) AS sx, SIGN(i.y-j.y) AS sy FROM r i JOIN r j ON i.u=j.u AND i.pair=j.pair AND i.z<j.z WHERE i.x IS NOT NULL AND i.y IS NOT NULL AND j.x IS NOT NULL AND j.y IS NOT NULL) SELECT u, pair, ROUND(CASE WHEN SUM(ABS(sx))>0 AND SUM(ABS(sy))>0 THEN SUM(sx*sy)/SQRT(SUM(ABS(sx))*SUM(ABS(sy))) END,6) AS tau FROM p GROUP BY 1,2")
def d48p(spark, d):
    first = F.col("part").isin(*[a for a, _ in PAIRS])
    w = _parts(spark, d).withColumn("pair", F.expr(PAIR_OF)).filter("pair is not null").withColumn("m", F.round(F.col("f") / F.col("n"), 9))
    both = w.groupBy("u", "pair", "z").agg(F.max(F.when(first, F.col("m"))).alias("x"), F.max(F.when(~first, F.col("m"))).alias("y")).dropna()
    return A.kendall(both, ["u", "pair"], "z", "x", "y").select("u", "pair", R("tau").alias("tau"))


@query("e9_zone_neighbours", f"WITH {ACT}, v AS (SELECT tr, ln, z, COUNT(*) AS n FROM act GROUP BY 1,2,3), g AS (SELECT 'before' AS side, tr, ln+lag AS ln, z, SUM(n*(1-lag/4.0)) AS w FROM v, (SELECT UNNEST([1,2,3]) AS lag) GROUP BY 1,2,3,4 UNION ALL SELECT 'ahead', tr, ln-lag, z, CAST(SUM(n) AS DOUBLE) FROM v, (SELECT UNNEST([1,2,3]) AS lag) GROUP BY 1,2,3,4) SELECT side, tr, ln, z, ROUND(w/MAX(w) OVER (PARTITION BY side, tr, ln),6) AS w FROM g")
def e9(spark, d):
    v = activity(spark, d).groupBy("tr", "ln", "z").agg(F.count("*").alias("n"))
    before = Q.neighbour_features(v, ["tr"], "ln", "z", "n", 4, "linear").withColumn("side", F.lit("before"))
    ahead = Q.neighbour_features(v, ["tr"], "ln", "z", "n", 4, "constant", ahead=True).withColumn("side", F.lit("ahead"))
    return before.unionByName(ahead).withColumn("w", R("w"))


@query("e10_run_speeds", f"WITH {EV}, l AS (SELECT *, t-LAG(t) OVER (PARTITION BY s ORDER BY t,id) AS dt, value-LAG(value) OVER (PARTITION BY s ORDER BY t,id) AS dx, CASE WHEN ev=LAG(ev) OVER (PARTITION BY s ORDER BY t,id) THEN 0 ELSE 1 END AS nw FROM ev), r AS (SELECT *, SUM(nw) OVER (PARTITION BY s ORDER BY t,id) AS run FROM l) SELECT s, CAST(run AS BIGINT) AS run, MIN(ev) AS ev, ROUND(MIN(t),3) AS start, ROUND(MAX(t)-MIN(t),6) AS dur, ROUND(AVG(CASE WHEN dt>0 THEN ABS(dx)/dt*3600 ELSE 0 END),5) AS speed FROM r GROUP BY s, run")
def e10(spark, d):
    w = Q.over(["s"], ["t", "id"])
    dt, dx = F.col("t") - F.lag("t").over(w), F.col("value") - F.lag("value").over(w)
    r = Q.runs(events(spark, d).withColumn("speed", F.when(dt > 0, F.abs(dx) / dt * 3600).otherwise(0.0)), ["s"], ["t", "id"], "ev")
    return r.groupBy("s", "run").agg(F.min("ev").alias("ev"), F.round(F.min("t"), 3).alias("start"), R(F.max("t") - F.min("t")).alias("dur"), F.round(F.avg("speed"), 5).alias("speed"))


@query("h5_normal_and_t", f"WITH g AS (SELECT p_partkey AS id, (p_size-25)/10.0 AS t, p_size AS df FROM part), {STUDENT}, e AS (SELECT *, 1/(1+0.3275911*ABS(t)/SQRT(2)) AS q FROM a) SELECT id, ROUND(q*(0.254829592+q*(-0.284496736+q*(1.421413741+q*(-1.453152027+q*1.061405429))))*EXP(-t*t/2),6) AS normal, ROUND(1-inner_p,6) AS student FROM e")
def h5(spark, d):
    g = read(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 25) / 10.0).alias("t"), F.col("p_size").alias("df"))
    return g.select("id", R(S.normal_tail("t")).alias("normal"), R(S.student_tail("t", "df")).alias("student"))


@query("i1_two_sided", f"""WITH {PERM}, m AS (SELECT u, z, rep, i, a, b, ROW_NUMBER() OVER (PARTITION BY u, rep ORDER BY CASE WHEN rep=0 THEN LPAD(i::VARCHAR,12,'0') ELSE MD5(CONCAT_WS('|','17',u,rep,i)) END, i) AS j FROM o, UNNEST(range(0,{REPS}+1)) AS q(rep)),
c AS (SELECT x.u, x.rep, ROUND(CORR(x.a,y.b),9) AS r FROM m x JOIN m y ON x.u=y.u AND x.rep=y.rep AND x.i=y.j GROUP BY 1,2), p AS (SELECT k.u, AVG(CASE WHEN c.r>=k.r THEN 1.0 ELSE 0 END) AS p FROM c JOIN c k ON c.u=k.u AND k.rep=0 WHERE c.rep>0 GROUP BY k.u) SELECT u, ROUND(p,5) AS p, p<=0.01 OR p>=0.99 AS outside FROM p""")
def i1(spark, d):
    level = V.replicated_levels(_zone_means(spark, d), "u", "z", "a", "b", "permuted", 17, REPS, {"r": V.correlation(9)})
    return B.two_sided(level, "p", 0.02, "outside").select("u", F.round("p", 5).alias("p"), "outside")


@query("j1_angle_encoding", f"WITH {ACT}, b AS (SELECT u, tr%5 AS f, CAST(FLOOR(CAST(FLOOR(x) AS BIGINT)%360/30) AS BIGINT) AS b, fr FROM act), c AS (SELECT k.f AS fold, u, b, AVG(fr) AS m FROM b, (SELECT UNNEST(range(0,5)) AS f) k WHERE b.f<>k.f GROUP BY 1,2,3) SELECT b.u, b.f AS fold, COUNT(*) AS n, ROUND(SUM((fr-m)*(fr-m))/COUNT(*),5) AS mse, ROUND(2*SUM(fr*LN(fr/m)-(fr-m)),4) AS deviance, ROUND(AVG(LN(m)),6) AS coef FROM b JOIN c ON b.f=c.fold AND b.u=c.u AND b.b=c.b GROUP BY 1,2")
def j1(spark, d):
    b = activity(spark, d).select("u", (F.col("tr") % 5).alias("fold"), F.floor(F.floor("x") % 360 / 30).alias("b"), "fr")
    g = A.bin_encoding(b, ["u"], "fold", "b", "fr")
    return g.select("u", "fold", "n", F.round("mse", 5).alias("mse"), F.round("deviance", 4).alias("deviance"), R("coef").alias("coef"))


KERNEL = {(i, j): exp(-(i * i + j * j) / 2) for i in range(-2, 3) for j in range(-2, 3)}
SUMS = "g AS (SELECT cond, CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, SUM(fr) AS v FROM act GROUP BY 1,2,3)"


def _sums(spark, d):
    return activity(spark, d).groupBy("cond", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.sum("fr").alias("v"))


@query("m6_median_smooth", f"WITH {ACT}, {SUMS}, o AS (SELECT UNNEST(range(-2,3)) AS i), n AS (SELECT cond, xb+a.i AS xb, yb+b.i AS yb, LIST_SORT(LIST(v)) AS l FROM g, o a, o b WHERE ABS(a.i)<2 AND ABS(b.i)<2 GROUP BY 1,2,3), h AS (SELECT cond, xb, yb, CASE WHEN LEN(l)>=5 THEN l[LEN(l)-4] ELSE 0 END AS v FROM n) SELECT cond, xb+a.i AS xb, yb+b.i AS yb, ROUND(SUM(v*EXP(-(a.i*a.i+b.i*b.i)/2.0))/{sum(KERNEL.values())!r},4) AS v FROM h, o a, o b GROUP BY 1,2,3")
def m6(spark, d):
    h = M.median_smooth(_sums(spark, d), ["cond"], "v")
    cells = [F.struct((F.col("xb") + i).alias("x"), (F.col("yb") + j).alias("y"), (F.col("v") * w).alias("w")) for (i, j), w in KERNEL.items()]
    g = h.select("cond", F.inline(F.array(*cells))).groupBy("cond", F.col("x").alias("xb"), F.col("y").alias("yb")).agg(F.sum("w").alias("w"))
    return g.select("cond", "xb", "yb", F.round(F.col("w") / sum(KERNEL.values()), 4).alias("v"))


UNIT_SUMS = SUMS.replace("cond", "u")


def _unit_sums(spark, d):
    return activity(spark, d).groupBy("u", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.sum("fr").alias("v"))


@query("m1_field_mask", f"WITH {ACT}, {UNIT_SUMS}, o AS (SELECT UNNEST([-1,0,1]) AS i), f AS (SELECT u, xb, yb FROM g QUALIFY v>=0.5*MAX(v) OVER (PARTITION BY u)), w AS (SELECT DISTINCT u, xb+a.i AS xb, yb+b.i AS yb FROM f, o a, o b), e AS (SELECT u, xb+a.i AS xb, yb+b.i AS yb FROM w, o a, o b GROUP BY 1,2,3 HAVING COUNT(*)=9) SELECT e.* FROM e JOIN g ON e.u=g.u AND e.xb=g.xb AND e.yb=g.yb")
def m1(spark, d):
    return M.field_mask(_unit_sums(spark, d), ["u"], "v", 0.5)


@query("m4_grid_score", f"""WITH {ACT}, {UNIT_SUMS}, f AS (SELECT * FROM g QUALIFY v>=0.6*MAX(v) OVER (PARTITION BY u)), p AS (SELECT a.u, b.xb-a.xb AS dx, b.yb-a.yb AS dy, SUM(a.v*b.v) AS s FROM f a JOIN f b ON a.u=b.u GROUP BY 1,2,3),
k AS (SELECT p.u, p.dx, p.dy, p.s FROM p JOIN p q ON p.u=q.u AND ABS(p.dx-q.dx)<=1 AND ABS(p.dy-q.dy)<=1 GROUP BY 1,2,3,4 HAVING p.s>=MAX(q.s)),
c AS (SELECT k.* FROM k JOIN p z ON z.u=k.u AND z.dx=0 AND z.dy=0 WHERE (k.dx<>0 OR k.dy<>0) AND k.s>0.01*z.s QUALIFY ROW_NUMBER() OVER (PARTITION BY k.u ORDER BY k.dx*k.dx+k.dy*k.dy, k.dx, k.dy)<=6),
h AS (SELECT u, AVG(SQRT(dx*dx+dy*dy)) AS scale, MIN(ABS(ATAN2(dy,dx))) AS phase FROM c GROUP BY u HAVING COUNT(*)>=2),
t AS (SELECT p.u, p.s, i, CAST(FLOOR(p.dx*COS(i*PI()/6)-p.dy*SIN(i*PI()/6)+0.5+1e-9) AS BIGINT) AS tx, CAST(FLOOR(p.dx*SIN(i*PI()/6)+p.dy*COS(i*PI()/6)+0.5+1e-9) AS BIGINT) AS ty FROM p JOIN h ON p.u=h.u, UNNEST(range(1,6)) AS q(i) WHERE SQRT(p.dx*p.dx+p.dy*p.dy) BETWEEN 0.5*scale AND 2*scale),
r AS (SELECT t.u, t.i, COVAR_POP(t.s, COALESCE(p.s,0))/NULLIF(STDDEV_POP(t.s)*STDDEV_POP(COALESCE(p.s,0)),0) AS r FROM t LEFT JOIN p ON p.u=t.u AND p.dx=t.tx AND p.dy=t.ty GROUP BY 1,2)
SELECT h.u, ROUND(AVG(CASE WHEN i%2=0 THEN r END)-AVG(CASE WHEN i%2=1 THEN r END),5) AS score, ROUND(MIN(scale),5) AS scale, ROUND(MIN(phase),5) AS phase FROM r JOIN h ON r.u=h.u GROUP BY h.u""")
def m4(spark, d):
    """Of each unit's map the bins of at least 0.6 of its maximum count, or the mean would hide every peak but the centre."""
    m = _unit_sums(spark, d)
    high = m.join(m.groupBy("u").agg(F.max("v").alias("top")), "u").filter("v >= 0.6D * top")
    g = M.grid_score(high, ["u"], "v")
    return g.select("u", *[F.round(c, 5).alias(c) for c in ("score", "scale", "phase")])

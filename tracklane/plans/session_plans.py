"""Sources, filters, lookups, smoothing and sequence products of sessions, units and trials."""

from __future__ import annotations

from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import aggregate as A
from tracklane.operators import resample as B
from tracklane.operators import sequence as Q
from tracklane.plans.event_plans import TRIALS, _switched, _trials
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, CUES, EV, TRK, activity, events, read, tracking

R = lambda c: F.round(c, 6)
KIND = "CASE ev WHEN 'click' THEN 'good' WHEN 'view' THEN 'mua' WHEN 'error' THEN 'noise' ELSE 'unsorted' END"


def _map(pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _clusters(spark, d):
    kind = F.coalesce(_map({"click": "good", "view": "mua", "error": "noise"})[F.col("ev")], F.lit("unsorted"))
    return events(spark, d).select("s", (F.col("id") % 4).alias("tt"), "id", kind.alias("kind"))


@query("a2_tracking_rows", f"WITH {TRK} SELECT s, id, ROUND(t-MIN(t) OVER (PARTITION BY s),6) AS t, x, y, ROUND(ha,6) AS ha FROM trk")
def a2(spark, d):
    t = F.col("t") - F.min("t").over(Window.partitionBy("s"))
    return tracking(spark, d).select("s", "id", R(t).alias("t"), "x", "y", R("ha").alias("ha"))


@query("a4_cluster_labels", f"WITH {EV}, c AS (SELECT s, id%4 AS tt, id, {KIND} AS kind FROM ev) SELECT s, tt, COUNT(*) FILTER (kind='good') AS good, COUNT(*) FILTER (kind='mua') AS mua, COUNT(*) FILTER (kind='noise') AS noise, COUNT(*) FILTER (kind='unsorted') AS unsorted, STRING_AGG(CASE WHEN kind='good' THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS good_ids FROM c GROUP BY 1,2")
def a4(spark, d):
    c = _clusters(spark, d)
    ids = F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "good", F.col("id")))), ",")
    return c.groupBy("s", "tt").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("good", "mua", "noise", "unsorted")], F.nullif(ids, F.lit("")).alias("good_ids"))


@query("a5_behaviour_proportions", "SELECT o_custkey AS subject, o_orderpriority AS sheet, COUNT(*) AS n_trials, ROUND(AVG(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0 END),6) AS pct_correct FROM orders GROUP BY 1,2")
def a5(spark, d):
    o = read(spark, d, "orders").withColumnsRenamed({"o_custkey": "subject", "o_orderpriority": "sheet"})
    return o.groupBy("subject", "sheet").agg(F.count("*").alias("n_trials"), R(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("pct_correct"))


@query("a7_cluster_overview", f"WITH {EV}, c AS (SELECT s, id%4 AS tt, COUNT(*) FILTER (ev='click') AS n, COUNT(*) FILTER (ev='view') AS m FROM ev GROUP BY 1,2) SELECT s, CAST(SUM(n) AS BIGINT) AS n_cells, CAST(SUM(m) AS BIGINT) AS n_mua, ARG_MAX(tt, n*10-tt) AS best_tt FROM c GROUP BY s")
def a7(spark, d):
    c = _clusters(spark, d).groupBy("s", "tt").agg(F.count_if(F.col("kind") == "good").alias("n"), F.count_if(F.col("kind") == "mua").alias("m"))
    return c.groupBy("s").agg(F.sum("n").alias("n_cells"), F.sum("m").alias("n_mua"), F.max_by("tt", F.struct("n", -F.col("tt"))).alias("best_tt"))


@query("b2_affine_track", """WITH p AS (SELECT l_orderkey AS tr, CAST(l_linenumber AS BIGINT) AS ln, l_extendedprice/1000-45 AS x, l_quantity-25 AS y FROM lineitem WHERE l_extendedprice/1000 BETWEEN 5 AND 90 AND l_quantity BETWEEN 2 AND 48),
r AS (SELECT tr, ln, (x*COS(0.3)+y*SIN(0.3))*12 AS x, -(y*COS(0.3)-x*SIN(0.3))*12 AS y FROM p) SELECT tr, ln, ROUND(CASE WHEN ABS(x)<=400 AND ABS(y)<=300 THEN x END,6) AS x, ROUND(CASE WHEN ABS(x)<=400 AND ABS(y)<=300 THEN y END,6) AS y FROM r""")
def b2(spark, d):
    raw = read(spark, d, "lineitem").filter("l_extendedprice / 1000 between 5 and 90 and l_quantity between 2 and 48")
    p = raw.select(F.col("l_orderkey").alias("tr"), F.col("l_linenumber").cast("long").alias("ln"), (F.col("l_extendedprice") / 1000 - 45).alias("x"), (F.col("l_quantity") - 25).alias("y"))
    x, y = S.rotate("x", "y", 0.3)
    p = p.select("tr", "ln", (x * 12).alias("x"), (-y * 12).alias("y"))
    inside = (F.abs("x") <= 400) & (F.abs("y") <= 300)
    return p.select("tr", "ln", R(F.when(inside, F.col("x"))).alias("x"), R(F.when(inside, F.col("y"))).alias("y"))


@query("b4_vector_angle", f"WITH {TRK} SELECT id, ROUND(CASE WHEN ATAN2(y-50,x-60)<0 THEN ATAN2(y-50,x-60)+2*PI() ELSE ATAN2(y-50,x-60) END,6) AS angle FROM trk")
def b4(spark, d):
    return tracking(spark, d).select("id", R(S.angle_of(F.col("x") - 60, F.col("y") - 50)).alias("angle"))


@query("b5_movement_filter", f"WITH {TRK}, v AS (SELECT s, id, x-LAG(x) OVER w AS dx, y-LAG(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY s ORDER BY t, id)), q AS (SELECT s, id, COALESCE(SQRT(dx*dx+dy*dy)/0.02,0) AS sp FROM v) SELECT s, id FROM q WHERE sp BETWEEN 500 AND 4000")
def b5(spark, d):
    return Q.velocity(tracking(spark, d), ["s"], ["t", "id"], "x", "y", 0.02).filter(F.col("speed").between(500, 4000)).select("s", "id")


@query("b6_blank_samples", f"WITH {TRK}, v AS (SELECT s, id, x, y, x-LAG(x) OVER w AS dx, y-LAG(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY s ORDER BY t, id)) SELECT s, id, CASE WHEN NOT (x>200 OR y<5 OR COALESCE(SQRT(dx*dx+dy*dy)/0.02,0)>4000) THEN x END AS x, CONCAT_WS(',', CASE WHEN x>200 THEN 'out' END, CASE WHEN COALESCE(SQRT(dx*dx+dy*dy)/0.02,0)>4000 THEN 'speed' END, CASE WHEN y<5 THEN 'well' END) AS why FROM v")
def b6(spark, d):
    v = Q.velocity(tracking(spark, d), ["s"], ["t", "id"], "x", "y", 0.02)
    reasons = {"out": F.col("x") > 200, "speed": F.col("speed") > 4000, "well": F.col("y") < 5}
    return v.select("s", "id", F.when(~A.any_of(list(reasons.values())), F.col("x")).alias("x"), F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in reasons.items()]).alias("why"))


@query("b7_valid_trials", f"WITH {TRIALS} SELECT s, trial FROM trials WHERE tE-t0 BETWEEN 600 AND 864000 AND correct IS NOT NULL")
def b7(spark, d):
    return _trials(spark, d).filter((F.col("tE") - F.col("t0")).between(600, 864000) & F.col("correct").isNotNull()).select("s", "trial")


@query("b10_unit_names", "SELECT s_suppkey AS u, 's'||s_nationkey||'-tt'||(s_suppkey%16)||'_d'||(s_suppkey%7)||'_cl'||s_suppkey AS name, s_suppkey AS back, CAST(s_suppkey%16 AS BIGINT) AS tt FROM supplier")
def b10(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("u"), F.format_string("s%d-tt%d_d%d_cl%d", "s_nationkey", F.col("s_suppkey") % 16, F.col("s_suppkey") % 7, "s_suppkey").alias("name"))
    part = lambda pattern: F.regexp_extract("name", pattern, 1).cast("long")
    return s.select("u", "name", part("_cl(\\d+)$").alias("back"), part("-tt(\\d+)_").alias("tt"))


COND = "cond AS (SELECT s, trial, UNNEST([CASE WHEN cue='L' THEN 'CL' END, CASE WHEN cue='R' THEN 'CR' END, CASE WHEN correct=1 THEN 'Co' END, CASE WHEN correct=0 THEN 'Inco' END]) AS cond FROM swt)"


def _conditions(spark, d):
    rules = {"CL": F.col("cue") == "L", "CR": F.col("cue") == "R", "Co": F.col("correct") == 1, "Inco": F.col("correct") == 0}
    return _switched(spark, d).select("s", "trial", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("cond"))


@query("b11_condition_codes", f"WITH {TRIALS}, {COND}, codes AS (SELECT code, UNNEST(subs) AS sub FROM (VALUES ('CL_bo', ['Co','Inco']), ('CR_out', ['Co','Inco']), ('Co_in', ['CL','CR'])) v(code, subs)) SELECT a.s, code, sub, SPLIT_PART(code,'_',2) AS part, COUNT(*) AS n FROM codes JOIN cond a ON a.cond=SPLIT_PART(code,'_',1) JOIN cond b ON a.s=b.s AND a.trial=b.trial AND b.cond=sub GROUP BY 1,2,3,4")
def b11(spark, d):
    codes = spark.createDataFrame([("CL_bo",), ("CR_out",), ("Co_in",)], "code string")  # fixed values
    name = F.split("code", "_")[0]
    subs = F.when(name.isin("CL", "CR"), F.array(F.lit("Co"), F.lit("Inco"))).otherwise(F.array(F.lit("CL"), F.lit("CR")))
    codes = codes.select("code", name.alias("cond"), F.split("code", "_")[1].alias("part"), F.explode(subs).alias("sub"))
    c = _conditions(spark, d)
    both = c.join(F.broadcast(codes), "cond").join(c.withColumnRenamed("cond", "sub"), ["s", "trial", "sub"])
    return both.groupBy("s", "code", "sub", "part").agg(F.count("*").alias("n"))


@query("b14_value_codes", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'cell' WHEN 'O' THEN 'mua' ELSE 'unknown' END AS kind, CAST(SUBSTR(o_orderpriority,1,1) AS BIGINT) AS level FROM orders")
def b14(spark, d):
    kinds = F.coalesce(_map({"F": "cell", "O": "mua"})[F.col("o_orderstatus")], F.lit("unknown"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kinds.alias("kind"), F.substring("o_orderpriority", 1, 1).cast("long").alias("level"))


@query("b16_one_hot", f"WITH {ACT} SELECT tr, z, COUNT(*) FILTER (ln=1) AS b1, COUNT(*) FILTER (ln=2) AS b2, COUNT(*) FILTER (ln=3) AS b3, COUNT(*) FILTER (ln>3) AS rest FROM act GROUP BY 1,2")
def b16(spark, d):
    return activity(spark, d).groupBy("tr", "z").agg(*[F.count_if(F.col("ln") == i).alias(f"b{i}") for i in (1, 2, 3)], F.count_if(F.col("ln") > 3).alias("rest"))


@query("b17_wall_proximity", f"WITH {ACT}, b AS (SELECT CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, COUNT(*) AS n FROM act GROUP BY 1,2), w AS (SELECT *, LEAST(xb,10-xb) AS dx, LEAST(yb-1,7-yb) AS dy FROM b) SELECT xb, yb, n, ROUND(1-dx/5.0,6) AS side, ROUND(1-dy/3.0,6) AS end_, ROUND(1/(1+EXP(-(1.5-LEAST(dx,dy))/0.5)),6) AS wall, ROUND(1/(1+EXP(-(LEAST(dx,dy)-1.5)/0.5)),6) AS centre FROM w")
def b17(spark, d):
    b = activity(spark, d).groupBy(S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb")).agg(F.count("*").alias("n"))
    dx, dy = F.least("xb", 10 - F.col("xb")), F.least(F.col("yb") - 1, 7 - F.col("yb"))
    near = F.least(dx, dy)
    return b.select("xb", "yb", "n", R(1 - dx / 5.0).alias("side"), R(1 - dy / 3.0).alias("end_"), R(S.expit((1.5 - near) / 0.5)).alias("wall"), R(S.expit((near - 1.5) / 0.5)).alias("centre"))


@query("c2_attach_behaviour", f"WITH {TRIALS}, p AS (SELECT s, AVG(correct) AS p FROM trials GROUP BY s), g AS (SELECT s, ev, AVG(value) AS score FROM ev GROUP BY 1,2) SELECT g.s, ev, ROUND(score,6) AS score, ROUND(p,6) AS pct_correct FROM g LEFT JOIN p ON g.s=p.s")
def c2(spark, d):
    p = _trials(spark, d).groupBy("s").agg(R(F.avg("correct")).alias("pct_correct"))
    return events(spark, d).groupBy("s", "ev").agg(R(F.avg("value")).alias("score")).join(p, "s", "left")


@query("c5_pair_scores", f"WITH {ACT}, g AS (SELECT u, AVG(fr) AS m FROM act GROUP BY u), p AS (SELECT a.s_nationkey AS mt, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey=b.s_nationkey AND a.s_suppkey%2=0 AND b.s_suppkey%2=1) SELECT mt, a, ROUND(AVG(x.m),6) AS one, ROUND(AVG(y.m),6) AS two, COUNT(*) AS n FROM p LEFT JOIN g x ON x.u=a LEFT JOIN g y ON y.u=b GROUP BY 1,2")
def c5(spark, d):
    g = activity(spark, d).groupBy("u").agg(F.avg("fr").alias("m"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("mt"), F.col("s_suppkey").alias("k"))
    p = s.filter("k % 2 = 0").withColumnRenamed("k", "a").join(s.filter("k % 2 = 1").withColumnRenamed("k", "b"), "mt")
    p = p.join(g.select(F.col("u").alias("a"), F.col("m").alias("x")), "a", "left").join(g.select(F.col("u").alias("b"), F.col("m").alias("y")), "b", "left")
    return p.groupBy("mt", "a").agg(R(F.avg("x")).alias("one"), R(F.avg("y")).alias("two"), F.count("*").alias("n"))


@query("c13_sub_segments", f"WITH {ACT}, p AS (SELECT z, LEAST(CAST(FLOOR((x*0.8+fr*600)/20000) AS BIGINT),3) AS sub, fr FROM act) SELECT z, sub, COUNT(*) AS n, ROUND(AVG(fr),6) AS m FROM p GROUP BY 1,2")
def c13(spark, d):
    along = F.col("x") * 0.8 + F.col("fr") * 600  # distance along the axis of the segment
    return activity(spark, d).groupBy("z", F.least(S.uniform_bin(along, 0, 20000), F.lit(3)).alias("sub")).agg(F.count("*").alias("n"), R(F.avg("fr")).alias("m"))


@query("c14_centroid_distances", f"WITH {ACT}, c AS (SELECT u, z, AVG(x)/1000 AS x, AVG(fr) AS y FROM act GROUP BY 1,2) SELECT a.u, a.z AS src, b.z AS dst, ROUND(SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),5) AS dist FROM c a JOIN c b ON a.u=b.u AND a.z<b.z")
def c14(spark, d):
    c = activity(spark, d).groupBy("u", "z").agg((F.avg("x") / 1000).alias("x"), F.avg("fr").alias("y"))
    a, b = c.select("u", F.col("z").alias("src"), "x", "y"), c.select("u", F.col("z").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, "u").filter("src < dst").select("u", "src", "dst", F.round(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")), 5).alias("dist"))


CENTRE = "c AS (SELECT label, vec_id%4 AS s, i, AVG(v) AS v FROM (SELECT vec_id, label, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2,3)"


@query("c17_candidate_matches", f"WITH {CENTRE} SELECT a.label, a.s AS a, b.s AS b, ROUND(SQRT(SUM((a.v-b.v)*(a.v-b.v))),5) AS dist FROM c a JOIN c b ON a.label=b.label AND a.i=b.i AND a.s<b.s GROUP BY 1,2,3 HAVING SQRT(SUM((a.v-b.v)*(a.v-b.v)))<0.5")
def c17(spark, d):
    e = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("s"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    c = e.groupBy("label", "s", "i").agg(F.avg("v").alias("v"))
    pairs = c.withColumnRenamed("s", "a").join(c.select("label", "i", F.col("s").alias("b"), F.col("v").alias("w")), ["label", "i"]).filter("a < b")
    dist = F.sqrt(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))))
    return pairs.groupBy("label", "a", "b").agg(dist.alias("dist")).filter("dist < 0.5").withColumn("dist", F.round("dist", 5))


@query("c18_greedy_matches")
def c18(spark, d):
    """Units of one nation matched one to one in order of the distance of their balances."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    a, b = s.filter("k % 2 = 0").select("block", F.col("k").alias("a"), "v"), s.filter("k % 2 = 1").select("block", F.col("k").alias("b"), F.col("v").alias("w"))
    return B.greedy_matching(a.join(b, "block").select("block", "a", "b", F.abs(F.col("v") - F.col("w")).alias("dist")), ["block"], "a", "b", "dist")


@query("c19_test_vs_null", f"WITH {ACT}, sc AS (SELECT u, tr%5 AS fold, st, AVG(fr) AS v FROM act GROUP BY 1,2,3) SELECT a.u, COUNT(*) AS n, ROUND(MEDIAN(a.v-b.v),6) AS med, ROUND(AVG(a.v-b.v),6) AS m FROM sc a JOIN sc b ON a.u=b.u AND a.fold=b.fold WHERE a.st='F' AND b.st='O' GROUP BY a.u")
def c19(spark, d):
    sc = activity(spark, d).filter("st in ('F', 'O')").groupBy("u", (F.col("tr") % 5).alias("fold"), "st").agg(F.avg("fr").alias("v"))
    both = sc.filter("st = 'F'").join(sc.filter("st = 'O'").select("u", "fold", F.col("v").alias("w")), ["u", "fold"])
    return both.groupBy("u").agg(F.count("*").alias("n"), R(F.median(F.col("v") - F.col("w"))).alias("med"), R(F.avg(F.col("v") - F.col("w"))).alias("m"))


CLS = "cls AS (SELECT l_orderkey%5 AS fold, CAST(l_linenumber AS BIGINT) AS z, l_returnflag AS y, CASE WHEN l_discount>0.06 THEN 'A' WHEN l_discount>0.03 THEN 'N' ELSE 'R' END AS p, l_discount+0.01 AS a, l_tax+0.02 AS b FROM lineitem), cost AS (SELECT * FROM (VALUES ('A','N',1.0),('N','A',1.0),('A','R',2.5),('R','A',2.5),('N','R',1.5),('R','N',1.5),('A','A',0.0),('N','N',0.0),('R','R',0.0)) v(y,p,cost))"


def _decoded(spark, d):
    p = F.when(F.col("l_discount") > 0.06, "A").when(F.col("l_discount") > 0.03, "N").otherwise("R")
    return read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_linenumber").cast("long").alias("z"), F.col("l_returnflag").alias("y"), p.alias("p"), (F.col("l_discount") + 0.01).alias("a"), (F.col("l_tax") + 0.02).alias("b"))


def _cost(spark):
    far = {"AN": 1.0, "AR": 2.5, "NR": 1.5}
    return F.broadcast(spark.createDataFrame([(a, b, far.get(min(a, b) + max(a, b), 0.0)) for a in "ANR" for b in "ANR"], "y string, p string, cost double"))  # nine rows


@query("c20_decoding_cost", f"WITH {CLS} SELECT y, p, COUNT(*) AS n, ROUND(SUM(cost),4) AS cost FROM cls JOIN cost USING (y,p) GROUP BY 1,2")
def c20(spark, d):
    return _decoded(spark, d).join(_cost(spark), ["y", "p"]).groupBy("y", "p").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("d35_decoder_results", f"WITH {CLS} SELECT fold, z, y, COUNT(*) AS n, ROUND(AVG(CASE WHEN y=p THEN 1.0 ELSE 0 END),6) AS acc, ROUND(AVG(a/(a+b)),6) AS pr FROM cls GROUP BY 1,2,3")
def d35(spark, d):
    hit = (F.col("y") == F.col("p")).cast("double")
    return _decoded(spark, d).groupBy("fold", "z", "y").agg(F.count("*").alias("n"), R(F.avg(hit)).alias("acc"), R(F.avg(F.col("a") / (F.col("a") + F.col("b")))).alias("pr"))


@query("d42_trial_zone_evidence", f"WITH {CLS}, g AS (SELECT fold, z, y, AVG(a/(a+b)) AS pa, AVG(b/(a+b))*0.7 AS pn, AVG(b/(a+b))*0.3 AS pr FROM cls GROUP BY 1,2,3) SELECT fold, z, y, CASE WHEN pa>=pn AND pa>=pr THEN 'A' WHEN pn>=pr THEN 'N' ELSE 'R' END AS best, ROUND(LN(pa/(1-pa))-LN(pn/(1-pn)),6) AS margin, ROUND((pa-pn)/(pa+pn),6) AS norm_margin FROM g")
def d42(spark, d):
    a, b = F.col("a") / (F.col("a") + F.col("b")), F.col("b") / (F.col("a") + F.col("b"))
    g = _decoded(spark, d).groupBy("fold", "z", "y").agg(F.avg(a).alias("pa"), (F.avg(b) * 0.7).alias("pn"), (F.avg(b) * 0.3).alias("pr"))
    best = F.when((F.col("pa") >= F.col("pn")) & (F.col("pa") >= F.col("pr")), "A").when(F.col("pn") >= F.col("pr"), "N").otherwise("R")
    return g.select("fold", "z", "y", best.alias("best"), R(S.logit("pa") - S.logit("pn")).alias("margin"), R((F.col("pa") - F.col("pn")) / (F.col("pa") + F.col("pn"))).alias("norm_margin"))


@query("d43_zone_decoding_error", f"WITH {CLS}, r AS (SELECT z, y, AVG(CASE WHEN y=p THEN 1.0 ELSE 0 END) AS rec, SUM(cost) AS cost, COUNT(*) AS n FROM cls JOIN cost USING (y,p) GROUP BY 1,2) SELECT z, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(cost)/SUM(n),6) AS err, ROUND(AVG(rec),6) AS bac FROM r GROUP BY z")
def d43(spark, d):
    r = _decoded(spark, d).join(_cost(spark), ["y", "p"]).groupBy("z", "y").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("rec"), F.sum("cost").alias("cost"), F.count("*").alias("n"))
    return r.groupBy("z").agg(F.sum("n").alias("n"), R(F.sum("cost") / F.sum("n")).alias("err"), R(F.avg("rec")).alias("bac"))


@query("c22_scores_by_thirds", f"WITH {TRIALS}, e AS (SELECT s, MAX(trial) AS m FROM trials GROUP BY s), q AS (SELECT s, CAST(CASE WHEN trial>2.0*m/3 THEN 2 WHEN trial>1.0*m/3 THEN 1 ELSE 0 END AS BIGINT) AS part, AVG(correct) AS p FROM trials JOIN e USING (s) GROUP BY 1,2), g AS (SELECT s, CORR(value,k) AS score FROM ev GROUP BY s) SELECT q.s, part, ROUND(p,6) AS p, ROUND(score,6) AS score FROM q JOIN g ON q.s=g.s")
def c22(spark, d):
    m = F.max("trial").over(Window.partitionBy("s"))
    part = F.when(F.col("trial") > 2.0 * m / 3, 2).when(F.col("trial") > 1.0 * m / 3, 1).otherwise(0).cast("long")
    q = _trials(spark, d).withColumn("part", part).groupBy("s", "part").agg(R(F.avg("correct")).alias("p"))
    return q.join(events(spark, d).groupBy("s").agg(R(F.corr("value", "k")).alias("score")), "s")


@query("c23_matched_unit_rows", f"WITH {ACT}, a AS (SELECT u, AVG(x) AS px, AVG(fr) AS py FROM act GROUP BY u), b AS (SELECT u, CORR(ln,fr) AS score FROM act WHERE st='F' GROUP BY u) SELECT s_suppkey AS u, s_name AS name, n_name AS nation, r_name AS region, ROUND(px,4) AS px, ROUND(py,6) AS py, ROUND(score,6) AS score FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey LEFT JOIN a ON a.u=s_suppkey LEFT JOIN b ON b.u=s_suppkey")
def c23(spark, d):
    act = activity(spark, d)
    a = act.groupBy("u").agg(F.round(F.avg("x"), 4).alias("px"), R(F.avg("fr")).alias("py"))
    b = act.filter("st = 'F'").groupBy("u").agg(R(F.corr("ln", "fr")).alias("score"))
    s, n, r = (read(spark, d, t) for t in ("supplier", "nation", "region"))
    s = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    s = s.select(F.col("s_suppkey").alias("u"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return s.join(a, "u", "left").join(b, "u", "left")


DAYS = "dy AS (SELECT s, CAST(FLOOR(t/86400) AS BIGINT) AS day, COUNT(*) AS n, SUM(COS(2*PI()*(CAST(FLOOR(t) AS BIGINT)%86400)/86400.0)) AS c, SUM(SIN(2*PI()*(CAST(FLOOR(t) AS BIGINT)%86400)/86400.0)) AS sn FROM ev GROUP BY 1,2), lim AS (SELECT s, MIN(day) AS lo, MAX(day) AS hi FROM dy GROUP BY s), kern AS (SELECT off, (3-ABS(off))/9.0 AS w FROM (SELECT UNNEST(range(-2,3)) AS off))"


def _days(spark, d):
    th = 2 * pi * (F.floor("t") % 86400) / 86400.0
    return events(spark, d).groupBy("s", F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.count("*").alias("n"), F.sum(F.cos(th)).alias("c"), F.sum(F.sin(th)).alias("sn"))


@query("e7_smoothed_rate", f"WITH {EV}, {DAYS} SELECT dy.s, CAST(day+off AS BIGINT) AS day, ROUND(SUM(n*w),6) AS fr FROM dy CROSS JOIN kern JOIN lim ON lim.s=dy.s WHERE day+off BETWEEN lo AND hi GROUP BY 1,2")
def e7(spark, d):
    return Q.kernel_smooth(_days(spark, d), ["s"], "day", ["n"], [1, 2, 3, 2, 1]).select("s", "day", R("n").alias("fr"))


@query("e8_smoothed_angle", f"WITH {EV}, {DAYS}, g AS (SELECT dy.s, CAST(day+off AS BIGINT) AS day, SUM(c*w) AS c, SUM(sn*w) AS sn FROM dy CROSS JOIN kern JOIN lim ON lim.s=dy.s WHERE day+off BETWEEN lo AND hi GROUP BY 1,2) SELECT s, day, ROUND(CASE WHEN ATAN2(sn,c)<0 THEN ATAN2(sn,c)+2*PI() ELSE ATAN2(sn,c) END,5) AS angle FROM g")
def e8(spark, d):
    g = Q.kernel_smooth(_days(spark, d), ["s"], "day", ["c", "sn"], [1, 2, 3, 2, 1])
    return g.select("s", "day", F.round(S.angle_of("c", "sn"), 5).alias("angle"))


@query("e9_zone_lags", f"WITH {ACT}, v AS (SELECT tr, ln, z, COUNT(*) AS n FROM act GROUP BY 1,2,3), g AS (SELECT tr, ln+lag AS ln, z, SUM(n*1.0/lag) AS w FROM v, (SELECT UNNEST([1,2]) AS lag) GROUP BY 1,2,3) SELECT tr, ln, z, ROUND(w/MAX(w) OVER (PARTITION BY tr, ln),6) AS w FROM g")
def e9(spark, d):
    v = activity(spark, d).groupBy("tr", "ln", "z").agg(F.count("*").alias("n"))
    return Q.lag_features(v, ["tr"], "ln", "z", "n", 3).withColumn("w", R("w"))


@query("e12_travel_direction", f"WITH {ACT}, p AS (SELECT tr, ln, MIN(z) AS z FROM act GROUP BY 1,2), q AS (SELECT *, LEAD(z) OVER (PARTITION BY tr ORDER BY ln) AS nx FROM p) SELECT tr, ln, CASE WHEN nx>z THEN 'out' WHEN nx<z THEN 'in' WHEN nx=z THEN 'stay' END AS dir FROM q")
def e12(spark, d):
    p = activity(spark, d).groupBy("tr", "ln").agg(F.min("z").alias("z"))
    nx = F.lead("z").over(Window.partitionBy("tr").orderBy("ln"))
    return p.select("tr", "ln", F.when(nx > F.col("z"), "out").when(nx < F.col("z"), "in").when(nx == F.col("z"), "stay").alias("dir"))


@query("e13_trajectories", f"WITH {ACT}, p AS (SELECT tr, ln, MIN(SUBSTR(z,7,1)) AS z FROM act GROUP BY 1,2), q AS (SELECT tr, STRING_AGG(z,'-' ORDER BY ln) AS path, ARG_MIN(z,ln) AS first_z, ARG_MAX(z,ln) AS last_z, ARG_MIN(ln, ln) FILTER (z IN ('4','5')) AS goal FROM p GROUP BY tr) SELECT tr, path, first_z, last_z, goal, path IN ('1-2','1-3','2-4','3-5') AS allowed FROM q")
def e13(spark, d):
    p = activity(spark, d).groupBy("tr", "ln").agg(F.min(F.substring("z", 7, 1)).alias("z"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "z"))), lambda x: x["z"]), "-")
    q = p.groupBy("tr").agg(path.alias("path"), F.min_by("z", "ln").alias("first_z"), F.max_by("z", "ln").alias("last_z"), F.min(F.when(F.col("z").isin("4", "5"), F.col("ln"))).alias("goal"))
    return q.withColumn("allowed", F.col("path").isin("1-2", "1-3", "2-4", "3-5"))


@query("e15_event_durations", f"WITH {EV}, n AS (SELECT id, ev, t, MIN(CASE WHEN ev IN ('click','purchase') THEN t END) OVER w AS a, MIN(CASE WHEN ev='error' THEN t END) OVER w AS b FROM ev WINDOW w AS (PARTITION BY s ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT id, ev, ROUND(LEAST(CASE ev WHEN 'view' THEN a WHEN 'signup' THEN b END-t,864000),6) AS dur FROM n WHERE ev IN ('view','signup')")
def e15(spark, d):
    w = Q.over(["s"], ["t", "id"]).rowsBetween(1, Window.unboundedFollowing)
    ahead = lambda *names: F.first(F.when(F.col("ev").isin(*names), F.col("t")), True).over(w)
    n = events(spark, d).select("id", "ev", "t", ahead("click", "purchase").alias("a"), ahead("error").alias("b")).filter("ev in ('view', 'signup')")
    end = F.when(F.col("ev") == "view", F.col("a")).otherwise(F.col("b")) - F.col("t")
    return n.select("id", "ev", R(F.when(end.isNull(), 864000.0).otherwise(F.least(end, F.lit(864000.0)))).alias("dur"))


@query("e16_priority_end", f"WITH {EV}, nb AS (SELECT *, SUM(CASE WHEN ev IN ('signup','view') THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t, ev, id ROWS UNBOUNDED PRECEDING)-1 AS trial FROM ev) SELECT s, CAST(trial AS BIGINT) AS trial, ROUND(COALESCE(MIN(CASE WHEN ev='purchase' THEN t END), MIN(CASE WHEN ev='click' THEN t END), MIN(CASE WHEN ev='error' THEN t END))-MIN(t),6) AS dur FROM nb WHERE trial>=0 GROUP BY 1,2")
def e16(spark, d):
    start = F.sum(F.when(F.col("ev").isin(*CUES), 1).otherwise(0)).over(Q.over(["s"], ["t", "ev", "id"]).rowsBetween(Window.unboundedPreceding, 0)) - 1
    nb = events(spark, d).withColumn("trial", start.cast("long")).filter("trial >= 0")
    first = lambda ev: F.min(F.when(F.col("ev") == ev, F.col("t")))
    # the first kind in this order that occurs wins, even if another one came earlier
    return nb.groupBy("s", "trial").agg(R(F.coalesce(first("purchase"), first("click"), first("error")) - F.min("t")).alias("dur"))


@query("e22_outbound_inbound", f"WITH {ACT}, p AS (SELECT tr, ln, AVG(fr) AS m FROM act GROUP BY 1,2), q AS (SELECT tr, m, ROW_NUMBER() OVER (PARTITION BY tr ORDER BY ln) AS pos, COUNT(*) OVER (PARTITION BY tr) AS n FROM p) SELECT a.tr, a.pos, ROUND(a.m,6) AS out_m, ROUND(b.m,6) AS in_m, ROUND(a.m-b.m,6) AS diff FROM q a JOIN q b ON a.tr=b.tr AND a.pos=b.n+1-b.pos")
def e22(spark, d):
    p = activity(spark, d).groupBy("tr", "ln").agg(F.avg("fr").alias("m"))
    w = Window.partitionBy("tr")
    q = p.select("tr", "m", F.row_number().over(w.orderBy("ln")).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    back = q.select("tr", (F.col("n") + 1 - F.col("pos")).alias("pos"), F.col("m").alias("b"))
    return q.join(back, ["tr", "pos"]).select("tr", "pos", R("m").alias("out_m"), R("b").alias("in_m"), R(F.col("m") - F.col("b")).alias("diff"))


@query("f1_by_date", "SELECT o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def f1(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.cast("long").alias("n"))


@query("f4_selected_unit_rates", f"WITH {ACT}, sel AS (SELECT u FROM act GROUP BY u HAVING AVG(CASE WHEN st='F' THEN fr END)>AVG(CASE WHEN st='O' THEN fr END)) SELECT u, cond, ROUND(AVG(fr),6) AS m, COUNT(*) AS n FROM act WHERE u IN (SELECT u FROM sel) GROUP BY 1,2")
def f4(spark, d):
    a = activity(spark, d)
    on = lambda s: F.avg(F.when(F.col("st") == s, F.col("fr")))
    chosen = a.groupBy("u").agg(on("F").alias("f"), on("O").alias("o")).filter("f > o")
    return a.join(chosen, "u", "left_semi").groupBy("u", "cond").agg(R(F.avg("fr")).alias("m"), F.count("*").alias("n"))


@query("f6_median_slope", f"WITH {ACT}, p AS (SELECT u, z, AVG(x) AS x, AVG(fr) AS y FROM act GROUP BY 1,2), s AS (SELECT a.u, a.z, MEDIAN((b.y-a.y)/(b.x-a.x)) AS sl FROM p a JOIN p b ON a.u=b.u AND a.z<>b.z AND a.x<>b.x GROUP BY 1,2), m AS (SELECT u, MEDIAN(sl) AS sl FROM s GROUP BY u) SELECT p.u, ROUND(MIN(sl)*1000,5) AS slope, ROUND(MEDIAN(y-sl*x),5) AS icpt FROM p JOIN m ON p.u=m.u GROUP BY p.u")
def f6(spark, d):
    p = activity(spark, d).groupBy("u", "z").agg(F.avg("x").alias("x"), F.avg("fr").alias("y"))
    return B.median_slope(p, ["u"], "z", "x", "y").select("u", F.round(F.col("slope") * 1000, 5).alias("slope"), F.round("icpt", 5).alias("icpt"))


@query("g1_stack_sessions", "SELECT user_id AS s, 'event' AS kind, COUNT(*) AS n, ROUND(AVG(value),6) AS m FROM events GROUP BY 1 UNION ALL SELECT o_custkey, 'order', COUNT(*), NULL FROM orders GROUP BY 1")
def g1(spark, d):
    a = events(spark, d).groupBy("s").agg(F.count("*").alias("n"), R(F.avg("value")).alias("m")).withColumn("kind", F.lit("event"))
    b = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("s")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("order"))
    return a.unionByName(b, allowMissingColumns=True)


@query("g2_trial_sets", f"WITH {ACT}, a AS (SELECT DISTINCT tr FROM act WHERE fr>30), b AS (SELECT DISTINCT tr FROM act WHERE x>60000) SELECT tr, 'both' AS side FROM (SELECT tr FROM a INTERSECT SELECT tr FROM b) UNION ALL SELECT tr, 'only_a' FROM (SELECT tr FROM a EXCEPT SELECT tr FROM b)")
def g2(spark, d):
    act = activity(spark, d)
    a, b = act.filter("fr > 30").select("tr").distinct(), act.filter("x > 60000").select("tr").distinct()
    return a.join(b, "tr", "left_semi").withColumn("side", F.lit("both")).unionByName(a.join(b, "tr", "left_anti").withColumn("side", F.lit("only_a")))


@query("h2_correlation_transforms", "SELECT p_partkey AS id, ROUND(CASE WHEN p_size<50 THEN ATANH(SIN(p_size/50.0*PI()/2)) END,6) AS z FROM part")
def h2(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R(F.when(F.col("p_size") < 50, S.fisher_z(S.kendall_to_pearson(F.col("p_size") / 50.0)))).alias("z"))


@query("h3_angles", f"WITH {TRK} SELECT id, ROUND(DEGREES(ha),6) AS deg, ROUND(SQRT(x*x+y*y),6) AS rho, ROUND(x*COS(ha),6) AS px, ROUND(x-100*FLOOR(x/100),6) AS torus FROM trk")
def h3(spark, d):
    return tracking(spark, d).select("id", R(F.degrees("ha")).alias("deg"), R(F.hypot("x", "y")).alias("rho"), R(F.col("x") * F.cos("ha")).alias("px"), R(F.pmod("x", F.lit(100.0))).alias("torus"))


@query("h4_clip_probabilities", f"WITH {CLS}, g AS (SELECT fold, z, y, AVG(CASE WHEN p='A' THEN 1.0 ELSE 0 END) AS a, AVG(CASE WHEN p='N' THEN 1.0 ELSE 0 END) AS n FROM cls GROUP BY 1,2,3), c AS (SELECT fold, z, y, LEAST(GREATEST(a,1e-10),1-1e-10) AS a, LEAST(GREATEST(n,1e-10),1-1e-10) AS n FROM g) SELECT fold, z, y, ROUND(a/(a+n),6) AS a, ROUND(n/(a+n),6) AS n FROM c")
def h4(spark, d):
    share = lambda c: F.avg((F.col("p") == c).cast("double"))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-10)), F.lit(1 - 1e-10))
    g = _decoded(spark, d).groupBy("fold", "z", "y").agg(clip(share("A")).alias("a"), clip(share("N")).alias("n"))
    return g.select("fold", "z", "y", R(F.col("a") / (F.col("a") + F.col("n"))).alias("a"), R(F.col("n") / (F.col("a") + F.col("n"))).alias("n"))


@query("h5_p_values", "SELECT p_partkey AS id, ROUND(EXP(-p_size/4.0)*(1+p_size/4.0),6) AS chi4 FROM part")
def h5(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), R(S.chi2_tail_even(F.col("p_size") / 2.0, 2)).alias("chi4"))


@query("h6_strings", "SELECT p_partkey AS id, REPLACE(p_brand,'#','-') AS brand, SPLIT_PART(p_type,' ',1) AS head, STARTS_WITH(p_type,'S') AS s, p_brand||'_'||p_size AS name FROM part")
def h6(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.split("p_type", " ")[0].alias("head"), F.startswith("p_type", F.lit("S")).alias("s"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("name"))


@query("h7_dates", "SELECT o_orderkey AS id, STRFTIME(o_orderdate,'%m%d%y') AS code, CAST(DATE_DIFF('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders")
def h7(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "MMddyy").alias("code"), F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1990-01-01"))).cast("long").alias("day"))


@query("h8_arrays", "WITH e AS (SELECT vec_id, UNNEST(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS i FROM embeddings) SELECT vec_id AS id, CAST(i//16 AS BIGINT) AS ch, ROUND(AVG(v),6) AS m FROM e GROUP BY 1,2")
def h8(spark, d):
    # a row of 64 samples as four channels of 16
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(F.col("embedding").cast("array<double>"), c * 16 + 1, 16)).alias("wave"))
    return e.select("id", F.posexplode("wave").alias("ch", "w")).select("id", F.col("ch").cast("long").alias("ch"), R(F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / 16).alias("m"))


@query("h10_int16", f"WITH {ACT}, f AS (SELECT u, MAX(ABS(x)) AS mx FROM act GROUP BY u) SELECT tr, ln, CAST(TRUNC(x*(32767/mx)) AS SMALLINT) AS q FROM act JOIN f USING (u)")
def h10(spark, d):
    a = activity(spark, d)
    return a.join(a.groupBy("u").agg(F.max(F.abs("x")).alias("mx")), "u").select("tr", "ln", (F.col("x") * (F.lit(32767.0) / F.col("mx"))).cast("short").alias("q"))

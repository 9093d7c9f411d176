"""Events, sequences and joins in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklane.operators import aggregate as A
from tracklane.operators import sequence as Q
from tracklane.plans.registry import query
from tracklane.sources.tables import CUES, EV, events, read

R = lambda c: F.round(c, 6)
TRIALS = f"""{EV}, nb AS (SELECT *, SUM(CASE WHEN ev IN ('signup','view') THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t, ev ROWS UNBOUNDED PRECEDING)-1 AS trial FROM ev),
per AS (SELECT s, trial, MIN(CASE WHEN ev IN ('signup','view') THEN t END) AS t0, MAX(CASE ev WHEN 'signup' THEN 'L' WHEN 'view' THEN 'R' END) AS cue, MAX(t) AS last, MIN(CASE WHEN ev='click' THEN t END) AS tD, MIN(CASE WHEN ev IN ('purchase','error') THEN t END) AS tR FROM nb WHERE trial>=0 GROUP BY s, trial),
oc AS (SELECT p.s, p.trial, MIN(CASE WHEN n.ev='purchase' THEN 1 ELSE 0 END) AS correct FROM per p JOIN nb n ON n.s=p.s AND n.trial=p.trial AND n.t=p.tR AND n.ev IN ('purchase','error') GROUP BY 1,2),
trials AS (SELECT p.s, CAST(p.trial AS BIGINT) AS trial, t0, COALESCE(LEAD(t0) OVER (PARTITION BY p.s ORDER BY p.trial), last) AS tE, cue, tD, tR, CAST(correct AS BIGINT) AS correct FROM per p LEFT JOIN oc ON p.s=oc.s AND p.trial=oc.trial),
sw1 AS (SELECT *, COALESCE(CAST(cue<>LAG(cue) OVER (PARTITION BY s ORDER BY trial) AS BIGINT),0) AS sw FROM trials),
swt AS (SELECT *, COALESCE(LAG(correct) OVER (PARTITION BY s ORDER BY trial)*sw,0) AS vsw FROM sw1)"""


def _trials(spark, d):
    return Q.trials(events(spark, d), ["s"], "t", "ev", CUES, "purchase", "error", "click")


def _switched(spark, d):
    return Q.switches(_trials(spark, d), ["s"], ["trial"], "cue", "correct")


@query("e14_trials", f"WITH {TRIALS} SELECT s, trial, ROUND(tE-t0,6) AS dur, cue, ROUND(tD-t0,6) AS to_decision, ROUND(tR-t0,6) AS to_outcome, correct FROM trials")
def e14(spark, d):
    return _trials(spark, d).select("s", "trial", R(F.col("tE") - F.col("t0")).alias("dur"), "cue", R(F.col("tD") - F.col("t0")).alias("to_decision"), R(F.col("tR") - F.col("t0")).alias("to_outcome"), "correct")


@query("e2_switch_flags", f"WITH {TRIALS} SELECT s, trial, cue, sw, vsw FROM swt")
def e2(spark, d):
    return _switched(spark, d).select("s", "trial", "cue", "sw", "vsw")


@query("d1_session_performance", f"""WITH {TRIALS} SELECT s, COUNT(*) AS n_trials, CAST(SUM(sw) AS BIGINT) AS n_sw, CAST(SUM(vsw) AS BIGINT) AS n_vsw, ROUND(AVG(correct),6) AS pct_correct,
ROUND(CAST(SUM(correct*sw) AS DOUBLE)/NULLIF(SUM(sw),0),6) AS pct_sw_correct, ROUND(CAST(SUM(correct*vsw) AS DOUBLE)/NULLIF(SUM(vsw),0),6) AS pct_vsw_correct, ROUND(AVG(CASE WHEN cue='L' THEN correct END),6) AS pct_L_correct, ROUND(AVG(CASE WHEN cue='R' THEN correct END),6) AS pct_R_correct FROM swt GROUP BY s""")
def d1(spark, d):
    p = A.session_performance(_switched(spark, d), ["s"])
    return p.select("s", "n_trials", "n_sw", "n_vsw", *[R(c).alias(c) for c in p.columns if c.startswith("pct")])


@query("d2_performance_thirds", f"WITH {TRIALS}, e AS (SELECT s, MAX(trial) AS m FROM trials GROUP BY s) SELECT s, CAST(CASE WHEN trial>2.0*m/3 THEN 2 WHEN trial>1.0*m/3 THEN 1 ELSE 0 END AS BIGINT) AS part, COUNT(*) AS n, ROUND(AVG(correct),6) AS p FROM trials JOIN e USING (s) GROUP BY 1,2")
def d2(spark, d):
    t = _trials(spark, d)
    m = F.max("trial").over(Window.partitionBy("s"))
    part = F.when(F.col("trial") > 2.0 * m / 3, 2).when(F.col("trial") > 1.0 * m / 3, 1).otherwise(0).cast("long")
    return t.withColumn("part", part).groupBy("s", "part").agg(F.count("*").alias("n"), R(F.avg("correct")).alias("p"))


@query("d3_first_criterion_session", f"WITH {TRIALS}, p AS (SELECT s, COUNT(*) AS n, AVG(correct) AS p FROM trials GROUP BY s), g AS (SELECT s%10 AS subject, s, n>=3 AND p>=0.4 AS ok FROM p), f AS (SELECT subject, MIN(CASE WHEN ok THEN s END) AS first_s FROM g GROUP BY 1) SELECT subject, s, first_s, CAST(COALESCE(s<first_s, TRUE) AS BIGINT) AS pre FROM g JOIN f USING (subject)")
def d3(spark, d):
    p = _trials(spark, d).groupBy("s").agg(F.count("*").alias("n"), F.avg("correct").alias("p")).withColumn("subject", F.col("s") % 10)
    first = F.min(F.when((F.col("n") >= 3) & (F.col("p") >= 0.4), F.col("s"))).over(Window.partitionBy("subject"))
    return p.withColumn("first_s", first).select("subject", "s", "first_s", F.coalesce(F.col("s") < F.col("first_s"), F.lit(True)).cast("long").alias("pre"))


@query("a1_event_log", f"WITH {EV} SELECT s, id, CASE ev WHEN 'signup' THEN 'CL' WHEN 'view' THEN 'CR' WHEN 'purchase' THEN 'RD' END AS code, k FROM ev WHERE ev IN ('signup','view','purchase')")
def a1(spark, d):
    names = spark.createDataFrame([("signup", "CL"), ("view", "CR"), ("purchase", "RD")], "ev string, code string")
    return events(spark, d).join(F.broadcast(names), "ev").select("s", "id", "code", "k")


@query("a3_time_axis", f"WITH {EV}, b AS (SELECT s, MIN(t) AS t0, MAX(t) AS t1 FROM ev GROUP BY s) SELECT s, CAST(i AS BIGINT) AS sample, ROUND(i*86400.0,6) AS off FROM b, UNNEST(range(0, CAST(FLOOR((t1-t0)/86400) AS BIGINT)+1)) AS r(i)")
def a3(spark, d):
    b = events(spark, d).groupBy("s").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return b.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / 86400).cast("long"))).alias("sample")).withColumn("off", R(F.col("sample") * 86400.0))


@query("a6_event_pivot", "SELECT user_id AS s, COUNT(*) FILTER (event_type='click') AS click, COUNT(*) FILTER (event_type='purchase') AS purchase, COUNT(*) FILTER (event_type='view') AS view FROM events WHERE event_type IN ('click','purchase','view') GROUP BY 1")
def a6(spark, d):
    names = ["click", "purchase", "view"]
    g = events(spark, d).filter(F.col("ev").isin(names)).groupBy("s").pivot("ev", names).count()
    return g.select("s", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


@query("a12_analysis_registry", "SELECT s, ev FROM (SELECT DISTINCT user_id AS s FROM events), (SELECT DISTINCT event_type AS ev FROM events) EXCEPT SELECT user_id, event_type FROM events")
def a12(spark, d):
    e = events(spark, d)
    want = e.select("s").distinct().crossJoin(e.select("ev").distinct())  # every session is asked for every code
    return want.join(e.select("s", "ev").distinct(), ["s", "ev"], "left_anti")


@query("a13_inner_events", f"WITH {EV}, b AS (SELECT s, MIN(t) AS t0, MAX(t) AS t1 FROM ev GROUP BY s) SELECT e.s, id, ROW_NUMBER() OVER (PARTITION BY e.s ORDER BY ev, t, id) AS n FROM ev e JOIN b USING (s) WHERE t>t0+86400 AND t<t1-86400")
def a13(spark, d):
    w = Window.partitionBy("s")
    e = events(spark, d).withColumns({"t0": F.min("t").over(w), "t1": F.max("t").over(w)}).filter("t > t0 + 86400 and t < t1 - 86400")
    return e.select("s", "id", F.row_number().over(w.orderBy("ev", "t", "id")).cast("long").alias("n"))


@query("b1_select_rows", "SELECT event_id AS id, value FROM events WHERE event_type IN ('click','view') AND user_id=7")
def b1(spark, d):
    want = {"ev": ["click", "view"], "s": 7}
    e = events(spark, d)
    for c, v in want.items():
        e = e.filter(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return e.select("id", "value")


@query("b8_session_validity", "SELECT user_id AS s, COUNT(*) AS n, COUNT(DISTINCT event_type) AS kinds FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type='error' AND value>95) GROUP BY 1 HAVING COUNT(*)>=5 AND COUNT(DISTINCT event_type)>=3")
def b8(spark, d):
    e = events(spark, d)
    blocked = e.filter("ev = 'error' and value > 95").select("s").distinct()
    return e.join(blocked, "s", "left_anti").groupBy("s").agg(F.count("*").alias("n"), F.count_distinct("ev").alias("kinds")).filter("n >= 5 and kinds >= 3")


@query("b9_session_key", "SELECT c_custkey AS id, c_mktsegment||'_'||CAST(c_nationkey AS VARCHAR)||'_0102'||CAST(18+c_custkey%3 AS VARCHAR) AS key, UPPER(c_mktsegment[1])||LOWER(SUBSTR(c_mktsegment,2)) AS subject, CAST(c_nationkey AS VARCHAR) AS task, CAST(2018+c_custkey%3 AS BIGINT) AS year, '0000' AS sub FROM customer")
def b9(spark, d):
    c = read(spark, d, "customer")
    key = F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string"), F.concat(F.lit("0102"), (18 + F.col("c_custkey") % 3).cast("string")))
    p = F.split("key", "_")
    return c.select(F.col("c_custkey").alias("id"), key.alias("key")).select("id", "key", F.initcap(p[0]).alias("subject"), p[1].alias("task"), F.year(F.to_date(p[2], "MMddyy")).cast("long").alias("year"), F.coalesce(F.get(p, F.lit(3)), F.lit("0000")).alias("sub"))


@query("b12_trial_conditions", f"WITH {TRIALS}, c AS (SELECT s, trial, UNNEST([CASE WHEN cue='L' THEN 'CL' END, CASE WHEN cue='R' THEN 'CR' END, CASE WHEN correct=1 THEN 'Co' END, CASE WHEN correct=0 THEN 'Inco' END, CASE WHEN sw=1 THEN 'Sw' END, CASE WHEN trial%2=1 THEN 'Even' ELSE 'Odd' END, 'All']) AS cond FROM swt) SELECT * FROM c WHERE cond IS NOT NULL")
def b12(spark, d):
    rules = {"CL": F.col("cue") == "L", "CR": F.col("cue") == "R", "Co": F.col("correct") == 1, "Inco": F.col("correct") == 0, "Sw": F.col("sw") == 1, "Even": F.col("trial") % 2 == 1, "Odd": F.col("trial") % 2 == 0, "All": F.lit(True)}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return _switched(spark, d).select("s", "trial", F.explode(names).alias("cond"))


@query("c6_tolerance_join", f"WITH {EV} SELECT a.s, a.id AS ida, b.id AS idb FROM ev a JOIN ev b ON a.s=b.s AND ABS(a.t-b.t)<=43200 WHERE a.ev='click' AND b.ev='purchase'")
def c6(spark, d):
    e = events(spark, d)
    pick = lambda ev, out: e.filter(F.col("ev") == ev).select("s", "t", F.col("id").alias(out))
    return Q.tolerance_join(pick("click", "ida"), pick("purchase", "idb"), ["s"], "t", 43200.0).select("s", "ida", "idb")


@query("c7_first_after", f"WITH {EV} SELECT a.s, a.id, ROUND((SELECT MIN(b.t) FROM ev b WHERE b.s=a.s AND b.ev='purchase' AND b.t>=a.t+60 AND b.t<=a.t+864000)-a.t,6) AS wait FROM ev a WHERE a.ev='click'")
def c7(spark, d):
    e = events(spark, d)
    a = e.filter("ev = 'click'").select("s", "t", "id")
    got = Q.first_after(a, e.filter("ev = 'purchase'").select("s", "t"), ["s"], "t", 60.0, 864000.0).groupBy("s", F.col("ta").alias("t")).agg(F.first("tb").alias("tb"))
    return a.join(got, ["s", "t"]).select("s", "id", R(F.col("tb") - F.col("t")).alias("wait"))


@query("c8_sample_of_event", f"WITH {EV}, b AS (SELECT s, MIN(t) AS t0 FROM ev GROUP BY s) SELECT id, CAST(FLOOR((t-t0)/3600) AS BIGINT) AS sample FROM ev JOIN b USING (s)")
def c8(spark, d):
    return events(spark, d).withColumn("t0", F.min("t").over(Window.partitionBy("s"))).select("id", F.floor((F.col("t") - F.col("t0")) / 3600).cast("long").alias("sample"))


@query("c9_nearest_resample", f"""WITH {EV}, b AS (SELECT s, CAST(FLOOR(MIN(t)/86400) AS BIGINT) AS d0, CAST(FLOOR(MAX(t)/86400) AS BIGINT) AS d1 FROM ev GROUP BY s), ax AS (SELECT s, CAST(i*86400 AS DOUBLE) AS t FROM b, UNNEST(range(d0, d1+1)) AS r(i)),
p AS (SELECT s, t, MAX(value) AS value FROM ev GROUP BY 1,2), c AS (SELECT ax.s, ax.t, p.value, ROW_NUMBER() OVER (PARTITION BY ax.s, ax.t ORDER BY ABS(p.t-ax.t), p.t) AS n FROM ax JOIN p ON ax.s=p.s) SELECT s, CAST(t/86400 AS BIGINT) AS day, value FROM c WHERE n=1""")
def c9(spark, d):
    e = events(spark, d)
    b = e.groupBy("s").agg(F.floor(F.min("t") / 86400).alias("d0"), F.floor(F.max("t") / 86400).alias("d1"))
    axis = b.select("s", F.explode(F.sequence("d0", "d1")).alias("day")).select("s", (F.col("day") * 86400).cast("double").alias("t"))
    got = Q.nearest(axis, e.groupBy("s", "t").agg(F.max("value").alias("value")), ["s"], "t", "value")
    return got.select("s", (F.col("t") / 86400).cast("long").alias("day"), "value")


@query("c11_events_to_trials", f"WITH {TRIALS} SELECT e.id, (SELECT MAX(trial) FROM trials x WHERE x.s=e.s AND x.t0<=e.t) AS trial FROM ev e")
def c11(spark, d):
    return Q.asof(events(spark, d).select("s", "t", "id"), _trials(spark, d).select("s", F.col("t0").alias("t"), "trial"), ["s"], "t", "trial", "trial").select("id", "trial")


@query("c10_trial_days", f"WITH {TRIALS} SELECT s, trial, CAST(i AS BIGINT) AS day FROM trials, UNNEST(range(CAST(FLOOR(t0/86400) AS BIGINT), CAST(FLOOR(tE/86400) AS BIGINT)+1)) AS r(i)")
def c10(spark, d):
    day = lambda c: F.floor(F.col(c) / 86400)
    return _trials(spark, d).select("s", "trial", F.explode(F.sequence(day("t0"), day("tE"))).alias("day"))


@query("c15_transition_check", f"WITH {EV}, p AS (SELECT id, LAG(ev) OVER (PARTITION BY s ORDER BY t, id) AS src, ev AS dst FROM ev) SELECT id, CAST(COALESCE((src,dst) IN (('view','click'),('click','purchase'),('signup','view'),('view','view')), FALSE) AS BIGINT) AS ok FROM p WHERE src IS NOT NULL")
def c15(spark, d):
    ok = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view")], "src string, dst string").withColumn("ok", F.lit(1).cast("long"))
    e = events(spark, d).select("id", F.lag("ev").over(Q.over(["s"], ["t", "id"])).alias("src"), F.col("ev").alias("dst")).filter("src is not null")
    return e.join(F.broadcast(ok), ["src", "dst"], "left").select("id", F.coalesce("ok", F.lit(0)).alias("ok"))


@query("c16_slow_dimension", f"WITH {EV} SELECT e.id, (SELECT ARG_MAX(x.k, (x.t, x.id)) FROM ev x WHERE x.s=e.s AND x.ev='signup' AND x.t<=e.t) AS depth FROM ev e WHERE ev='click'")
def c16(spark, d):
    e = events(spark, d)
    dim = e.filter("ev = 'signup'").groupBy("s", "t").agg(F.max_by("k", "id").alias("depth"))
    return Q.asof(e.filter("ev = 'click'").select("s", "t", "id"), dim, ["s"], "t", "depth", "depth").select("id", "depth")


@query("c21_set_membership", "SELECT DISTINCT user_id AS s FROM events WHERE event_type='click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type='error') AND user_id IN (SELECT user_id FROM events WHERE event_type='purchase')")
def c21(spark, d):
    e = events(spark, d)
    of = lambda ev: e.filter(F.col("ev") == ev).select("s").distinct()
    return of("click").join(of("error"), "s", "left_anti").join(of("purchase"), "s", "left_semi")


@query("e1_velocity", f"WITH {EV}, v AS (SELECT id, value-LAG(value) OVER w AS dx, k-LAG(k) OVER w AS dy FROM ev WINDOW w AS (PARTITION BY s ORDER BY t, id)) SELECT id, ROUND(COALESCE(SQRT(dx*dx+dy*dy)/0.02,0),6) AS speed, ROUND(COALESCE(ATAN2(dy,dx),0),6) AS heading FROM v")
def e1(spark, d):
    return Q.velocity(events(spark, d), ["s"], ["t", "id"], "value", "k", 0.02).select("id", R("speed").alias("speed"), R("heading").alias("heading"))


@query("e4_fill_missing", f"WITH {EV}, x AS (SELECT *, CASE WHEN k%3=0 THEN NULL ELSE value END AS v FROM ev), y AS (SELECT id, v, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY t,id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, FIRST_VALUE(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY t,id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x) SELECT id, ROUND(COALESCE(v,a,0),6) AS last, ROUND(COALESCE(v,(COALESCE(a,b)+COALESCE(b,a))/2,0),6) AS mean FROM y")
def e4(spark, d):
    x = events(spark, d).withColumn("v", F.when(F.col("k") % 3 == 0, None).otherwise(F.col("value")))
    x = Q.fill(Q.fill(x, ["s"], ["t", "id"], "v", "last", "last"), ["s"], ["t", "id"], "v", "mean", "mean")
    return x.select("id", R("last").alias("last"), R("mean").alias("mean"))


@query("e5_rolling_median", f"WITH {EV} SELECT id, ROUND(MEDIAN(value) OVER (PARTITION BY s ORDER BY t,id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS med FROM ev")
def e5(spark, d):
    return Q.rolling_median(events(spark, d), ["s"], ["t", "id"], "value", 2, 2).select("id", R("med").alias("med"))


@query("e6_block_std", f"WITH {EV}, b AS (SELECT s, id, value, (ROW_NUMBER() OVER (PARTITION BY s ORDER BY t,id)-1)//4 AS b FROM ev) SELECT id, ROUND(STDDEV_POP(value) OVER (PARTITION BY s,b),6) AS sd FROM b")
def e6(spark, d):
    b = events(spark, d).withColumn("b", F.floor((F.row_number().over(Q.over(["s"], ["t", "id"])) - 1) / 4))
    return b.select("id", R(F.stddev_pop("value").over(Window.partitionBy("s", "b"))).alias("sd"))


@query("e10_runs", f"WITH {EV}, l AS (SELECT *, CASE WHEN ev=LAG(ev) OVER (PARTITION BY s ORDER BY t,id) THEN 0 ELSE 1 END AS nw FROM ev), r AS (SELECT *, SUM(nw) OVER (PARTITION BY s ORDER BY t,id) AS run FROM l) SELECT s, CAST(run AS BIGINT) AS run, MIN(ev) AS ev, ROUND(MAX(t)-MIN(t),6) AS dur, COUNT(*) AS n FROM r GROUP BY s, run")
def e10(spark, d):
    r = Q.runs(events(spark, d), ["s"], ["t", "id"], "ev")
    return r.groupBy("s", "run").agg(F.min("ev").alias("ev"), R(F.max("t") - F.min("t")).alias("dur"), F.count("*").alias("n"))


@query("e11_merge_segments", f"WITH {EV}, p AS (SELECT s, t-86400 AS a, t+86400 AS b FROM ev WHERE value>30), m AS (SELECT *, MAX(b) OVER (PARTITION BY s ORDER BY a,b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), g AS (SELECT *, SUM(CASE WHEN a<=reach THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY a,b) AS g FROM m) SELECT s, ROUND(MAX(b)-MIN(a),6) AS len, COUNT(*) AS n FROM g GROUP BY s, g.g")
def e11(spark, d):
    p = events(spark, d).filter("value > 30").select("s", (F.col("t") - 86400).alias("a"), (F.col("t") + 86400).alias("b"))
    return Q.merge_intervals(p, ["s"], "a", "b").select("s", R(F.col("tE") - F.col("t0")).alias("len"), "n")


@query("e17_indicators", f"WITH {EV} SELECT s, CAST(FLOOR(t/86400) AS BIGINT) AS day, CAST(MAX(CASE WHEN ev='click' THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(MAX(CASE WHEN ev='error' THEN 1 ELSE 0 END) AS BIGINT) AS error FROM ev GROUP BY 1,2")
def e17(spark, d):
    g = events(spark, d).withColumn("day", F.floor(F.col("t") / 86400)).groupBy("s", "day").pivot("ev", ["click", "error"]).agg(F.max(F.lit(1)))
    return g.select("s", "day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("click", "error")])


@query("e18_time_folds", f"WITH {EV}, n AS (SELECT s, value, ROW_NUMBER() OVER (PARTITION BY s ORDER BY t,id)-1 AS i FROM ev) SELECT CAST((i//3)%5 AS BIGINT) AS fold, COUNT(*) AS n, ROUND(AVG(value),6) AS m FROM n GROUP BY 1")
def e18(spark, d):
    n = events(spark, d).withColumn("i", F.row_number().over(Q.over(["s"], ["t", "id"])) - 1)
    return n.groupBy(Q.fold_of("i", 3, 5).alias("fold")).agg(F.count("*").alias("n"), R(F.avg("value")).alias("m"))


@query("e21_intervals", f"WITH {EV}, g AS (SELECT s, ev, t-LAG(t) OVER (PARTITION BY s,ev ORDER BY t,id) AS isi FROM ev) SELECT ev, COUNT(isi) AS n, ROUND(MIN(isi),6) AS low, CAST(COUNT(*) FILTER (isi<86400) AS BIGINT) AS short FROM g GROUP BY ev")
def e21(spark, d):
    g = events(spark, d).withColumn("isi", F.col("t") - F.lag("t").over(Q.over(["s", "ev"], ["t", "id"])))
    return g.groupBy("ev").agg(F.count("isi").alias("n"), R(F.min("isi")).alias("low"), F.count_if(F.col("isi") < 86400).alias("short"))


@query("d47_transition_counts", f"WITH {EV}, p AS (SELECT LAG(ev) OVER (PARTITION BY s ORDER BY t,id) AS src, ev AS dst FROM ev) SELECT src, dst, COUNT(*) AS n FROM p WHERE src IS NOT NULL GROUP BY 1,2")
def d47(spark, d):
    p = events(spark, d).select(F.lag("ev").over(Q.over(["s"], ["t", "id"])).alias("src"), F.col("ev").alias("dst"))
    return p.filter("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("d4_occupancy", f"WITH {EV}, g AS (SELECT s, ev, COUNT(*) AS n FROM ev GROUP BY 1,2) SELECT s, ev, n, ROUND(n*2e-2,6) AS sec, ROUND(n/SUM(n) OVER (PARTITION BY s),6) AS p FROM g")
def d4(spark, d):
    g = events(spark, d).groupBy("s", "ev").agg(F.count("*").alias("n"))
    return g.select("s", "ev", "n", R(F.col("n") * 0.02).alias("sec"), R(F.col("n") / F.sum("n").over(Window.partitionBy("s"))).alias("p"))


@query("d8_binned_counts", f"WITH {EV}, b AS (SELECT s, CAST(FLOOR(t/604800) AS BIGINT) AS bin, COUNT(*) AS n FROM ev GROUP BY 1,2), r AS (SELECT s, MIN(bin) AS lo, MAX(bin) AS hi FROM b GROUP BY s), ax AS (SELECT s, i AS bin FROM r, UNNEST(range(lo, hi+1)) AS q(i)) SELECT ax.s, ax.bin, COALESCE(n,0) AS n FROM ax LEFT JOIN b ON ax.s=b.s AND ax.bin=b.bin")
def d8(spark, d):
    b = events(spark, d).groupBy("s", F.floor(F.col("t") / 604800).alias("bin")).agg(F.count("*").alias("n"))
    axis = b.groupBy("s").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select("s", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return axis.join(b, ["s", "bin"], "left").select("s", "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("d16_circular", f"WITH {EV}, a AS (SELECT ev, value AS w, 2*PI()*(CAST(FLOOR(t) AS BIGINT)%86400)/86400.0 AS th FROM ev), g AS (SELECT ev, SUM(w) AS w, SUM(w*COS(th)) AS c, SUM(w*SIN(th)) AS s FROM a GROUP BY ev) SELECT ev, ROUND(w,4) AS w, ROUND(SQRT(c*c+s*s)/w,6) AS r, ROUND(CASE WHEN ATAN2(s,c)<0 THEN ATAN2(s,c)+2*PI() ELSE ATAN2(s,c) END,6) AS mean, ROUND((c*c+s*s)/w,4) AS z FROM g")
def d16(spark, d):
    th = F.lit(2 * 3.141592653589793) * (F.floor("t") % 86400) / 86400.0
    g = A.circular(events(spark, d).withColumn("th", th), ["ev"], "th", "value")
    return g.select("ev", F.round("w", 4).alias("w"), R("r").alias("r"), R("mean").alias("mean"), F.round("z", 4).alias("z"))


@query("g4_condition_pairs", "WITH e AS (SELECT DISTINCT event_type AS ev FROM events) SELECT a.ev AS a, b.ev AS b FROM e a JOIN e b ON a.ev<b.ev")
def g4(spark, d):
    e = events(spark, d).select("ev").distinct()
    return e.select(F.col("ev").alias("a")).join(e.select(F.col("ev").alias("b")), F.col("a") < F.col("b"))


@query("f5_argmax", f"WITH {EV} SELECT s, ARG_MAX(ev, (value, -id)) AS best FROM ev GROUP BY s")
def f5(spark, d):
    return events(spark, d).groupBy("s").agg(F.max_by("ev", F.struct("value", -F.col("id"))).alias("best"))


@query("h9_json_map", f"WITH {EV} SELECT k, COUNT(*) AS n FROM ev GROUP BY k")
def h9(spark, d):
    return read(spark, d, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("g3_dense_ids", f"WITH {EV} SELECT DISTINCT ev, CAST(DENSE_RANK() OVER (ORDER BY ev) AS BIGINT) AS n FROM (SELECT DISTINCT ev FROM ev)")
def g3(spark, d):
    return events(spark, d).select("ev").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("ev")).cast("long"))

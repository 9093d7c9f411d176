"""Maps: labelled fields, borders, grids, best hexagonal patterns, and their significance under shifts of the activity."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from tracklane.functions import scalar as S
from tracklane.operators import encoding as E
from tracklane.operators import map_scores as MS
from tracklane.operators import maps as M
from tracklane.plans.contrast_plans import PICK
from tracklane.plans.registry import query
from tracklane.sources.tables import ACT, activity

R = lambda c: F.round(c, 6)
#: Shifts of a unit's series; samples of a block when maps of alternate blocks are compared; least samples of a bin.
SHIFTS, BLOCK, LEAST = 200, 50, 2
#: The arena: columns are bins of price, rows are lines.
ACROSS, ALONG = (0, 10), (1, 7)
#: Fields: share of the maximum, least bins; depth of a wall.
SHARE, FIELD, WALL = 0.75, 4, 2


def _samples(spark, d):
    return activity(spark, d).select("u", "tr", "ln", "fr", "x", S.uniform_bin("x", 0, 10000).alias("xb"), F.col("ln").alias("yb"))


ORDER = ["tr", "ln", "fr", "x"]


@query("i2_map_shift", f"""WITH {ACT}, o AS (SELECT u, fr, CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, ROW_NUMBER() OVER (PARTITION BY u ORDER BY tr, ln, fr, x)-1 AS i, COUNT(*) OVER (PARTITION BY u) AS n FROM act), d AS (SELECT *, (i//{BLOCK})%2 AS part FROM o),
r AS (SELECT u, n, rep, CASE WHEN rep=0 THEN 0 ELSE {PICK.format(key="'37',u,rep", n="n")} END AS sh FROM (SELECT DISTINCT u, n FROM o), UNNEST(range(0,{SHIFTS}+1)) AS q(rep)),
m AS (SELECT p.u, r.rep, p.part, p.xb, p.yb, AVG(a.fr) AS m FROM d p JOIN r ON p.u=r.u JOIN d a ON a.u=p.u AND a.i=(p.i+r.n-r.sh)%r.n GROUP BY 1,2,3,4,5 HAVING COUNT(*)>={LEAST}),
c AS (SELECT a.u, a.rep, ROUND(CORR(a.m,b.m),9) AS s FROM m a JOIN m b ON a.u=b.u AND a.rep=b.rep AND a.xb=b.xb AND a.yb=b.yb WHERE a.part=0 AND b.part=1 GROUP BY 1,2 HAVING COUNT(*)>=3)
SELECT k.u, ROUND(ANY_VALUE(k.s),5) AS real, ROUND(AVG(CASE WHEN c.s>=k.s THEN 1.0 ELSE 0 END),5) AS p, AVG(CASE WHEN c.s>=k.s THEN 1.0 ELSE 0 END)<=0.01 OR AVG(CASE WHEN c.s>=k.s THEN 1.0 ELSE 0 END)>=0.99 AS significant FROM c JOIN c k ON c.u=k.u AND k.rep=0 WHERE c.rep>0 GROUP BY k.u""")
def i2(spark, d):
    """Stability of each unit's map (correlation of the maps of alternate blocks) against maps of its series shifted around."""
    return MS.stability_tests(_samples(spark, d), "u", ORDER, "fr", SHIFTS, 37, LEAST, BLOCK).select("u", F.round("real", 5).alias("real"), F.round("p", 5).alias("p"), "significant")


@query("j14_map_significance")
def j14(spark, d):
    """Border score, grid score and stability of each unit with their places among 200 shifted series."""
    g = MS.map_tests(_samples(spark, d), "u", ORDER, "fr", SHIFTS, 37, LEAST, BLOCK, ACROSS, ALONG, SHARE, FIELD, WALL)
    return g.select("u", "analysis", F.round("real", 5).alias("real"), F.round("p", 5).alias("p"), "significant")


UNIT_MAPS = "g AS (SELECT u, CAST(FLOOR(x/10000) AS BIGINT) AS xb, ln AS yb, AVG(fr) AS v FROM act GROUP BY 1,2,3)"
NEAR = "ABS({a}.xb-{b}.xb)<=1 AND ABS({a}.yb-{b}.yb)<=1"
FIELDS = f"""{UNIT_MAPS}, o AS (SELECT UNNEST([-1,0,1]) AS i), f AS (SELECT u, xb, yb FROM g QUALIFY v>={SHARE}*MAX(v) OVER (PARTITION BY u)), w AS (SELECT DISTINCT u, xb+a.i AS xb, yb+b.i AS yb FROM f, o a, o b), e AS (SELECT u, xb+a.i AS xb, yb+b.i AS yb FROM w, o a, o b GROUP BY 1,2,3 HAVING COUNT(*)=9),
cl AS (SELECT e.* FROM e JOIN g USING (u, xb, yb)), k AS (SELECT DISTINCT g.u, g.xb, g.yb, g.v FROM cl JOIN g ON cl.u=g.u AND {NEAR.format(a="cl", b="g")}),
l(u, xb, yb, field) AS (SELECT u, xb, yb, xb*1000000+yb FROM k UNION SELECT k.u, k.xb, k.yb, l.field FROM l JOIN k ON l.u=k.u AND {NEAR.format(a="l", b="k")}),
s AS (SELECT u, xb, yb, MIN(field) AS field FROM l GROUP BY 1,2,3), fl AS (SELECT s.*, v FROM s JOIN k USING (u, xb, yb) QUALIFY COUNT(*) OVER (PARTITION BY u, field)>={FIELD})"""


def _unit_maps(spark, d):
    return _samples(spark, d).groupBy("u", "xb", "yb").agg(F.avg("fr").alias("v"))


@query("m1_labelled_fields", f"WITH RECURSIVE {ACT}, {FIELDS} SELECT u, field, COUNT(*) AS n, ROUND(MAX(v),6) AS peak, ROUND(SUM(v*xb)/SUM(v),6) AS cx, ROUND(SUM(v*yb)/SUM(v),6) AS cy FROM fl GROUP BY 1,2")
def m1(spark, d):
    m = _unit_maps(spark, d)
    t = MS.field_table(m, MS.labelled_fields(m, ["u"], "v", SHARE, FIELD), ["u"], "v")
    return t.select("u", "field", "n", R("peak").alias("peak"), R("cx").alias("cx"), R("cy").alias("cy"))


_STRIPS = ((f"xb>{ACROSS[1] - WALL}", 7), (f"yb>{ALONG[1] - WALL}", 11), (f"xb<{ACROSS[0] + WALL}", 7), (f"yb<{ALONG[0] + WALL}", 11))
_COVER = "GREATEST(" + ",".join(f"COUNT(*) FILTER ({c})/{n * WALL}.0" for c, n in _STRIPS) + ")"


@query("m2_wall_border_score", f"WITH RECURSIVE {ACT}, {FIELDS}, t AS (SELECT u, field, {_COVER} AS c, SUM(v*LEAST(xb-{ACROSS[0]},{ACROSS[1]}-xb,yb-{ALONG[0]},{ALONG[1]}-yb)/3.0) AS d, SUM(v) AS v FROM fl GROUP BY 1,2), z AS (SELECT u, MAX(c) AS coverage, SUM(d)/SUM(v) AS distance FROM t GROUP BY u) SELECT u, ROUND(coverage,6) AS coverage, ROUND(distance,6) AS distance, ROUND(CASE WHEN coverage+distance>0 THEN (coverage-distance)/(coverage+distance) END,6) AS score FROM z")
def m2(spark, d):
    m = _unit_maps(spark, d)
    b = MS.wall_border_score(m, MS.labelled_fields(m, ["u"], "v", SHARE, FIELD), ["u"], "v", ACROSS, ALONG, WALL)
    return b.select("u", *[R(c).alias(c) for c in ("coverage", "distance", "score")])


#: The steps of the grid score on a table f (u, xb, yb, v).
GRID_STEPS = """p AS (SELECT a.u, b.xb-a.xb AS dx, b.yb-a.yb AS dy, ROUND(SUM(a.v*b.v),9) AS s FROM f a JOIN f b ON a.u=b.u GROUP BY 1,2,3),
k AS (SELECT p.u, p.dx, p.dy, p.s FROM p JOIN p q ON p.u=q.u AND ABS(p.dx-q.dx)<=1 AND ABS(p.dy-q.dy)<=1 GROUP BY 1,2,3,4 HAVING p.s>=MAX(q.s)-1e-7),
c AS (SELECT k.* FROM k JOIN p z ON z.u=k.u AND z.dx=0 AND z.dy=0 WHERE (k.dx<>0 OR k.dy<>0) AND k.s>0.01*z.s QUALIFY ROW_NUMBER() OVER (PARTITION BY k.u ORDER BY k.dx*k.dx+k.dy*k.dy, k.dx, k.dy)<=6),
h AS (SELECT u, AVG(SQRT(dx*dx+dy*dy)) AS scale, MIN(ABS(ATAN2(dy,dx))) AS phase FROM c GROUP BY u HAVING COUNT(*)>=2),
t AS (SELECT p.u, p.s, i, CAST(FLOOR(p.dx*COS(i*PI()/6)-p.dy*SIN(i*PI()/6)+0.5+1e-9) AS BIGINT) AS tx, CAST(FLOOR(p.dx*SIN(i*PI()/6)+p.dy*COS(i*PI()/6)+0.5+1e-9) AS BIGINT) AS ty FROM p JOIN h ON p.u=h.u, UNNEST(range(1,6)) AS q(i) WHERE SQRT(p.dx*p.dx+p.dy*p.dy) BETWEEN 0.5*scale AND 2*scale),
r AS (SELECT t.u, t.i, COVAR_POP(t.s, COALESCE(p.s,0))/NULLIF(STDDEV_POP(t.s)*STDDEV_POP(COALESCE(p.s,0)),0) AS r FROM t LEFT JOIN p ON p.u=t.u AND p.dx=t.tx AND p.dy=t.ty GROUP BY 1,2)
SELECT h.u, ROUND(AVG(CASE WHEN i%2=0 THEN r END)-AVG(CASE WHEN i%2=1 THEN r END),5) AS score, ROUND(MIN(scale),5) AS scale, ROUND(MIN(phase),5) AS phase FROM r JOIN h ON r.u=h.u GROUP BY h.u"""


@query("m4_grid_score_sharpened", f"WITH {ACT}, {UNIT_MAPS}, f AS (SELECT u, xb, yb, 1/(1+EXP(-10*(v/MAX(v) OVER (PARTITION BY u)-0.5))) AS v FROM g), {GRID_STEPS}")
def m4(spark, d):
    """Grid score of whole maps whose peaks a sigmoid lifts from the ground; no bin is left out."""
    g = M.grid_score(MS.sharpened(_unit_maps(spark, d), ["u"], "v"), ["u"], "v", tie=1e-7, digits=9)
    return g.select("u", *[F.round(c, 5).alias(c) for c in ("score", "scale", "phase")])


def _sweep(name: str, rows: str, s: str, a: str) -> str:
    wave = f"{4 * pi}/SQRT(3.0)/({s})"
    turn = lambda i: f"COS({wave}*(dx*COS({a}+{i * pi / 3})+dy*SIN({a}+{i * pi / 3})))"
    return f"{name}w AS (SELECT u, CAST({s} AS DOUBLE) AS s, CAST({a} AS DOUBLE) AS a, v, ({turn(0)}+{turn(1)}+{turn(2)}+1.5)/4.5 AS f FROM {rows}), {name}e AS (SELECT u, s, a, AVG((v-f)*(v-f)) AS mse FROM {name}w GROUP BY 1,2,3), {name} AS (SELECT * FROM {name}e QUALIFY ROW_NUMBER() OVER (PARTITION BY u ORDER BY ROUND(mse,9), ROUND(s,6), ROUND(a,6))=1)"


@query("m5_best_grid", f"WITH {ACT}, {UNIT_MAPS}, p AS (SELECT u, MIN(v) AS lo, MAX(v) AS hi FROM g GROUP BY u HAVING MAX(v)>MIN(v)), t AS (SELECT g.u, g.xb AS px, g.yb AS py FROM g JOIN p ON g.u=p.u AND g.v=p.hi QUALIFY ROW_NUMBER() OVER (PARTITION BY g.u ORDER BY g.xb, g.yb)=1), q AS (SELECT g.u, (v-lo)/(hi-lo) AS v, xb-px AS dx, yb-py AS dy FROM g JOIN p ON g.u=p.u JOIN t ON g.u=t.u), {_sweep('b0', 'q, range(0,8) AS x(i), range(0,6) AS y(j)', '2+0.5*i', f'j*{pi / 18}')}, {_sweep('b1', 'q JOIN (SELECT u AS bu, s AS bs, a AS ba FROM b0) ON u=bu, range(-3,4) AS x(i), range(-3,4) AS y(j)', 'bs+0.125*i', f'ba+j*{pi / 72}')}, w AS (SELECT w.u, CORR(w.v,w.f) AS r FROM b1w w JOIN b1 ON w.u=b1.u AND w.s=b1.s AND w.a=b1.a GROUP BY w.u) SELECT b1.u, ROUND(s,6) AS scale, ROUND(a,6) AS angle, ROUND(mse,6) AS mse, ROUND(r,5) AS r FROM b1 JOIN w ON b1.u=w.u")
def m5(spark, d):
    """The hexagonal pattern nearest to each unit's map: a coarse sweep, then one four times as fine around its best."""
    g = MS.grid_fit(_unit_maps(spark, d), ["u"], "v", (2.0, 0.5, 8), 6, rounds=1)
    return g.select("u", R("scale").alias("scale"), R("angle").alias("angle"), R("mse").alias("mse"), F.round("r", 5).alias("r"))


@query("m5_field_encoder", f"WITH RECURSIVE {ACT}, {FIELDS}, ee AS (SELECT act.u, act.tr%5 AS fold, COALESCE(field,-1) AS f, fr FROM act LEFT JOIN fl ON fl.u=act.u AND fl.xb=CAST(FLOOR(x/10000) AS BIGINT) AND fl.yb=act.ln), kk AS (SELECT UNNEST(range(0,5)) AS fold), cc AS (SELECT e.u, f, k.fold, AVG(fr) AS coef FROM ee e JOIN kk k ON e.fold<>k.fold GROUP BY 1,2,3) SELECT e.u, c.fold, CASE WHEN e.fold=c.fold THEN 'test' ELSE 'train' END AS split, COUNT(*) AS n, ROUND(CASE WHEN VAR_POP(fr)>1e-9*AVG(fr*fr) THEN 1-SUM((fr-coef)*(fr-coef))/(COUNT(*)*VAR_POP(fr)) END,5) AS r2 FROM ee e JOIN cc c ON e.u=c.u AND e.f=c.f GROUP BY 1,2,3")
def m5_fields(spark, d):
    """Activity encoded by the field a sample is in (one more feature for those in none), scored by fold."""
    m = _unit_maps(spark, d)
    fields = MS.labelled_fields(m, ["u"], "v", SHARE, FIELD)
    e = _samples(spark, d).join(fields, ["u", "xb", "yb"], "left").select("u", (F.col("tr") % 5).alias("fold"), F.coalesce("field", F.lit(-1)).alias("f"), "fr")
    g = E.fold_scores(E.fold_coefficients(e, ["u"], "fold", "f", "fr", 5), ["u"], "fold")
    return g.select("u", "fold", "split", "n", F.round("r2", 5).alias("r2"))

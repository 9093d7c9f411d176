"""Tables by role: events of sessions, and activity of units by trial and zone."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUES = {"signup": "L", "view": "R"}


def read(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def events(spark: SparkSession, where: str) -> DataFrame:
    """s session, id, ev event code, t seconds, value, k second measurement."""
    d = read(spark, where, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return d.select(F.col("user_id").alias("s"), F.col("event_id").alias("id"), F.col("event_type").alias("ev"), t.alias("t"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def tracking(spark: SparkSession, where: str) -> DataFrame:
    """s session, id sample, t seconds, x and y position, ha head angle in radians."""
    turn = 2 * pi * (F.floor("t") % 86400) / 86400.0
    return events(spark, where).select("s", "id", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), turn.alias("ha"))


def activity(spark: SparkSession, where: str) -> DataFrame:
    """tr trial, u unit, z zone, fr activity, cond condition, st outcome, ln row number in the trial, x position."""
    li, o, p = (read(spark, where, n) for n in ("lineitem", "orders", "part"))
    d = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return d.select(F.col("l_orderkey").alias("tr"), F.col("l_suppkey").alias("u"), F.col("p_brand").alias("z"), F.col("l_quantity").alias("fr"), F.col("o_orderpriority").alias("cond"), F.col("o_orderstatus").alias("st"), F.col("l_linenumber").cast("bigint").alias("ln"), F.col("l_extendedprice").alias("x"))


#: The same tables in SQL.
EV = "ev AS (SELECT user_id AS s, event_id AS id, event_type AS ev, CAST(epoch_us(ts) AS DOUBLE)/1e6 AS t, value, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"
ACT = "act AS (SELECT l_orderkey AS tr, l_suppkey AS u, p_brand AS z, l_quantity AS fr, o_orderpriority AS cond, o_orderstatus AS st, CAST(l_linenumber AS BIGINT) AS ln, l_extendedprice AS x FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)"
TRK = f"{EV}, trk AS (SELECT s, id, t, value AS x, CAST(k AS DOUBLE) AS y, 2*PI()*(CAST(FLOOR(t) AS BIGINT)%86400)/86400.0 AS ha FROM ev)"

"""Cuts lineage on the storage that the cluster shares."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame


def root(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset: the warehouse, which executors share, or in local mode (tests) a temporary folder of our own.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tracklane"
    if not where:
        where = getattr(sc, "_tracklane_tables", None) or tempfile.mkdtemp(prefix="spark-")
        sc._tracklane_tables = where
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint under root()."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root(spark))
    return df.checkpoint()


def materialized(build, spark, where: str, name: str, params: dict, defaults: dict) -> DataFrame:
    """The table that build(**params) gives, written once for each set of parameters that differs from the defaults.

    A finished table (with its _SUCCESS file) is read back; an unfinished one is written again.
    """
    changed = {k: v for k, v in sorted((defaults | params).items()) if k not in defaults or defaults[k] != v}
    digest = hashlib.sha256(json.dumps(changed, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{where}/{name}/params={digest}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        build(**(defaults | params)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def exported(tables: dict[str, DataFrame], where: str, session: str) -> dict[str, DataFrame]:
    """Writes each table under where/<name>, in files of neighbouring sessions; returns them as read back.

    Files are ranges of sessions and sorted by session, so a filter on it skips files and row groups by their statistics;
    a folder for each session would give small files without bound.
    """
    out = {}
    for name, df in tables.items():
        path = f"{where}/{name}"
        df.repartitionByRange(session).sortWithinPartitions(session).write.mode("overwrite").parquet(path)
        out[name] = df.sparkSession.read.parquet(path)
    return out

"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. When a stage is called, the result of the one before is
such a table, so the working tables that one left on shared storage are deleted then.

Null ids, rows that share an id, repeated rows, empty tables and columns with clashing names: as each operator states; no
stage tells rows apart by their id.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklane.llm import bpe
from tracklane.llm.common import delete, discard, noted, written
from tracklane.llm.decontaminate import decontaminate
from tracklane.llm.line_dedup import line_dedup
from tracklane.llm.near_dedup import near_dedup
from tracklane.llm.quality_rules import quality_filter

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Working tables of the stage called last.
_LEFT: list[str] = []


def _stage(function):
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            delete(spark, _LEFT.pop())
        with noted(_LEFT):
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", encoding),
]

#: SQL can't express the fingerprints and the byte merges; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}-{name}")
            if i:
                discard(before)
    return docs

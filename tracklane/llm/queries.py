"""Registered queries of the operators in this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import anchor_dedup, bpe, chat_format, decontaminate, html_crf, lexical_search, line_dedup, ngram_join, pitman_yor, quality_rules, simhash_dedup, spelling_variants, suffix_dedup
from tracklane.llm.oracle import ORACLE

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs.withColumn("before", F.length("text")))
    n = F.length(F.coalesce("text", F.lit("")))
    return out.select("doc_id", n.cast("bigint").alias("n_chars"), (F.coalesce("before", F.lit(0)) - n).cast("bigint").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_crf.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anchor_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(r"select cast(-7 as bigint) conv_id, cast(x as bigint) turn, r as role, '\\### Assistant: </turn> ok' as text from values (0, 'user'), (1, 'assistant') as t(x, r)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat_format.chat_format(chat_format.turns_of_rows(chat_format.in_layouts(rows, "conv_id", "turn", "role", "text"), chat_format.PLAIN))
    read = out.select("conv_id", "formatted", "loss_spans", chat_format.parsed(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", *bpe.digests(out))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measures(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    bad = (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names], bad.alias("base_failed"), (~bad & quality_rules.verdict()).alias("kept"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"), drop_every=199)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pitman_yor": op1,
        "op2_decontamination": op2,
        "op3_line_dedup": op3,
        "op4_html_crf": op4,
        "op5_simhash": op5,
        "op6_substring_dedup": op6,
        "op7_chat_format": op7,
        "op8_bpe": op8,
        "op9_suffix_dedup": op9,
        "op10_quality_rules": op10,
        "op11_lexical_search": op11,
        "op12_spelling_variants": op12,
        "op13_ngram_join": op13,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

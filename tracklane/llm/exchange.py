"""Blocks and buckets: documents in blocks of neighbouring ids tell hash buckets which hashes they hold, and get answers.

A block sends each hash once, however often its documents repeat it, and many hashes travel in one binary value, so a
hash that is in a third of all documents costs a bucket one entry a block. Three Spark shuffles: the texts by block (one
exchange, reused by every step of a plan), the hashes by bucket and the answers by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import shuffle_partitions

#: Null ids count as the smallest.
LOWEST = -(1 << 63)


def blocked(docs: DataFrame, id_col: str, text: str, per_block: int) -> DataFrame:
    """(block, key, id, text), dealt by block; blocks are ranges of ids, so their order is that of the ids."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = docs.select(F.floor(key / F.lit(per_block)).cast("long").alias("block"), key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.repartition(shuffle_partitions(docs.sparkSession), "block")


def by_bucket(hashes: DataFrame) -> DataFrame:
    return hashes.repartition(shuffle_partitions(hashes.sparkSession), "bucket").groupBy("bucket")


def n_buckets(df: DataFrame) -> int:
    """Some buckets for each shuffle partition: a bucket is what one call holds in memory."""
    return 4 * shuffle_partitions(df.sparkSession)


def bucket_cuts(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; a bucket is a range of hashes."""
    if len(hashes):
        least = ((np.arange(buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets)
        first = np.searchsorted(hashes, least << np.uint64(32)).tolist()
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(hashes)])):
            if a < b:
                yield k, a, b


def texts_in_order(table: pa.Table) -> tuple[list, list]:
    """Ids and texts of a block by id, then text (null first)."""
    keys, ids, texts = table["key"].to_pylist(), table["id"].to_pylist(), table["text"].to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] is not None, texts[i] or ""))
    return [ids[i] for i in order], [texts[i] for i in order]


def joined(values: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype)


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions inside any of the ranges start .. end."""
    change = np.zeros(length + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0

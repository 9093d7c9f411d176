"""Helpers that several operators share: words, shared storage, block/bucket exchange, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of what separates words: blank, tab, \n, \v, \f, \r (bytes.split() uses the same set).
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return (text or "").encode("utf-8", "replace").split()


def native_words(text):
    """Column of the words of a text column; empty array for null and blank texts."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset: the warehouse, which executors share, or in local mode (tests) a temporary folder of our own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local"):
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tracklane"
    if not root:
        root = getattr(sc, "_tracklane_root", None) or tempfile.mkdtemp(prefix="spark-")
        sc._tracklane_root = root
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df on shared storage, without lineage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


#: Where written() notes its tables while a caller asks for that, see noted().
_NOTES: list[list[str]] = []


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Appends to paths the tables that written() makes in this block, so that their owner can delete them later."""
    _NOTES.append(paths)
    try:
        yield
    finally:
        _NOTES.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table on shared storage, read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _NOTES:
        _NOTES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished job once its driver has collected garbage; ask for that now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, r): r holds a row's own columns, whatever their names, and row is a private key, fixed by writing it."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")), name)


def of_row(name: str):
    """A column of the struct r of numbered()."""
    return F.col("r")[name]


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that a later one has replaced."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over edges, by alternating large-star and small-star rounds.

    Each round is two grouped minima and two joins; a hub's edges are split by adaptive skew joins, and the
    rows of a round live on shared storage. Nodes without an edge to another node are not returned.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    pairs = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now


# ---- hashing of words and windows in numpy ----

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x + _C1
    x ^= x >> np.uint64(30)
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


#: Powers that are kept between calls, and how many of each base at most.
_KEPT: dict[int, np.ndarray] = {}
_KEEP = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    if len(_KEPT.get(base, ())) < n:
        out = np.full(n if n > _KEEP else min(2 * n, _KEEP), base, dtype=np.uint64)
        out[:1] = 1
        out = np.multiply.accumulate(out)
        out.flags.writeable = False
        if n > _KEEP:
            return out
        _KEPT[base] = out
    return _KEPT[base][:n] if n else np.zeros(0, np.uint64)


def ranked(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) of integers from 0 to 2 ** bits - 1.

    Sorts values that end in their places, which is faster than to sort places. Low bits that don't fit are left out; where
    that isn't enough to tell values apart, np.unique does the work.
    """
    n = len(x)
    if not n:
        return x, np.zeros(0, np.int64)
    low = (n - 1).bit_length()
    left_out = np.uint64(max(bits + low - 64, 0))
    order = np.sort(((x.astype(np.uint64) >> left_out) << np.uint64(low)) | np.arange(n, dtype=np.uint64))
    order = (order & np.uint64((1 << low) - 1)).astype(np.int64)
    values = x[order]
    if left_out and (values[1:] < values[:-1]).any():
        return np.unique(x, return_inverse=True)
    new = np.concatenate([[True], values[1:] != values[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return values[new], rank


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_IS_SPACE = bytes(x == 32 or 9 <= x < 14 for x in range(256))


class Batch:
    """Words of a list of texts as flat arrays: byte ranges, 64-bit word hashes and the text each word is from."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        raw = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "replace") for x in texts]
        if lower:
            raw = [x.lower() for x in raw]
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        data = b"\n".join(raw) + b"\n"
        self.data = data
        self.base = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        space = np.frombuffer(data.translate(_IS_SPACE), dtype=bool)
        edge = np.flatnonzero(space != np.concatenate([[True], space[:-1]]))
        self.start, self.end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
        #: word range of each text: words first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, np.concatenate([self.base, [len(data)]])).astype(np.int64)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.n_words)

    def word_hashes(self) -> np.ndarray:
        buf = np.frombuffer(self.data, dtype=np.uint8)
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 1 << 19  # bounds the scratch arrays for very long blocks
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + step)))
            lo, hi = self.start[i], self.end[j - 1]
            with np.errstate(over="ignore"):
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                each = _BYTE.take(buf[lo:hi], mode="wrap")
                each *= _powers(_BASE, hi - lo)
                np.cumsum(each, out=sums[1:])
                s, e = self.start[i:j] - lo, self.end[i:j] - lo
                out[i:j] = mix64((sums[e] - sums[s]) * _powers(_INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64))
            i = j
        return out


def window_hashes(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of width consecutive values (ignoring text borders); empty if there are too few."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        v = mix64(values ^ np.uint64(salt)) if salt else values
        out = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            out = out * np.uint64(_BASE) + v[j : j + n]
        return mix64(out)

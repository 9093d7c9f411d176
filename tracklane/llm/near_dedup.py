"""Near-duplicate removal at a similarity of 0.8 over bags of five-word shingles: SimHash, rare shingles, exact check.

The j-th copy of a shingle is an element of its own, so that the Jaccard similarity of element sets is sum(min) / sum(max)
of the bags. SimHash is the first way in which pairs meet: all fingerprints within BITS bits, by op 5's pigeonhole blocks,
which miss none. At 0.8 fingerprints differ in 10 of 64 bits on average, and a radius that covers this cuts 64 bits into
blocks of three bits, which nearly all pairs of a corpus share; pairs beyond BITS meet by rare shingles.

1. Rows of the same words are one node. Nodes whose fingerprints hang together by steps of BITS bits or fewer have a key
   in common.
2. Of each node the SAMPLE elements of the smallest hash are counted over the corpus; with at least `threshold` of its
   elements in a partner, one of its rarest PREFIX is shared, and these are keys, too. That is certain where the sample is
   the whole text; else a partner beyond BITS is missed if 16 of 32 draws at 0.8 or more all fail, below 2 in 10,000 pairs.
3. Keys of the same members are one. Inside a key, pairs that aren't connected yet and whose SimHashes are within the radius
   (4 standard deviations above the mean at 0.8) are compared exactly, by the 64-bit hashes of all elements.
4. Of each connected component the row of the smallest id stays (null ids last), and just one.

Defined cases: words are lower-cased; a text under five words has one shingle, the whole sequence; texts without words are
copies of each other; each row is judged by its own text, whatever its id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm import simhash_dedup
from tracklane.llm.common import Batch, connected_components, delete, mix64, noted, numbered, of_row, shuffle_partitions, window_hashes, written

WIDTH = 5
SAMPLE, PREFIX = 32, 16
#: Fingerprints that differ in so many bits or fewer meet by their blocks.
BITS = 4


def elements(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted element hashes of each text."""
    b = Batch(texts, lower=True)
    words = b.word_hashes()
    out = []
    for i, n in enumerate(b.n_words.tolist()):
        w = words[b.first[i] : b.first[i + 1]]
        h = np.sort(window_hashes(w, min(width, n), salt=n if n < width else 0)) if n else np.zeros(0, np.uint64)
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        copy = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            out.append(np.sort(mix64(h + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    return out


def simhash(e: np.ndarray, step: int = 1 << 16) -> int:
    """64 majority bits of an array of hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(e), step):
        part = e[i : i + step]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(e), bitorder="little").view("<u8")[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_links(texts: list[str | None], threshold: float, radius: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest over all pairs at the threshold; only pairs not yet connected are compared."""
    sets = elements(texts)
    fp = np.array([simhash(e) for e in sets], dtype=np.uint64)
    size = np.array([len(e) for e in sets])
    order = np.lexsort((size, fp))
    fp, size = fp[order], size[order]
    group, out = np.arange(len(order)), []
    for s in range(1, len(order)):
        near = (np.bitwise_count(fp[:-s] ^ fp[s:]) <= radius) & (group[:-s] != group[s:])
        near &= np.minimum(size[:-s], size[s:]) >= threshold * np.maximum(size[:-s], size[s:]) - 1e-9
        for i in np.flatnonzero(near).tolist():
            a, b = group[i], group[i + s]
            if a != b and similarity(sets[order[i]], sets[order[i + s]]) >= threshold - 1e-12:
                out.append((int(order[i]), int(order[i + s])))
                group[group == max(a, b)] = min(a, b)
        if not group.any():
            break
    return out


def _sampled(nodes: DataFrame, threshold: float) -> DataFrame:
    """(row, fp, need, es): the fingerprint of each node, its sampled elements and how many of the rarest are keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = elements(b.column(1).to_pylist())
            need = [PREFIX if len(e) > SAMPLE else len(e) - int(np.ceil(threshold * len(e) - 1e-9)) + 1 for e in sets]
            fp = np.array([simhash(e) for e in sets], dtype=np.uint64).view(np.int64)
            kept = pa.array([e[:SAMPLE].view(np.int64) for e in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array(need, pa.int32()), kept], names=["row", "fp", "need", "es"])

    return nodes.select("row", "text").mapInArrow(run, "row bigint, fp bigint, need int, es array<bigint>")


def simhash_keys(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(row, key) of rows (row, fp): one key for all fingerprints that are reachable by steps of so many bits or fewer."""
    distinct = written(prints.select(F.col("fp").alias("id"), "fp").distinct(), "bag-fingerprints")
    groups = connected_components(simhash_dedup.links(distinct, bits)).withColumnRenamed("node", "fp")
    return prints.join(groups, "fp", "left").select("row", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))


def near_links(nodes: DataFrame, threshold: float = 0.8, radius: int = 22) -> DataFrame:
    """(a, b): verified links between nodes (row, text) of different words that hold all of their connections."""
    sample = written(_sampled(nodes, threshold), "sampled-shingles")
    by_print = simhash_keys(sample.select("row", "fp"))
    sample = sample.select("row", "need", F.explode("es").alias("e"))
    count = sample.groupBy("e").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = sample.join(count, "e", "left").groupBy("row").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "e"))).alias("es"))
    keyed = ranked.select("row", F.explode(F.expr("filter(slice(es, 1, need), x -> x.n > 1)")).alias("x")).select("row", F.col("x.e").alias("key"))
    keyed = written(keyed.unionByName(by_print), "meeting-keys")
    who = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in range(2)]
    live = keyed.groupBy("key").agg(F.count("*").alias("n"), *who).filter("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    members = keyed.join(live, "key").join(nodes.select("row", "text"), "row").select("key", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, texts = None, [], []

        def flush() -> pa.RecordBatch:
            found = similar_links(texts, threshold, radius)
            return pa.RecordBatch.from_arrays([pa.array([rows[i] for i, _ in found], pa.int64()), pa.array([rows[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key and rows:
                    yield flush()
                    rows, texts = [], []
                key = k
                rows.append(r)
                texts.append(t)
        if rows:
            yield flush()

    return members.repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _digests(docs: DataFrame) -> DataFrame:
    """(row, id, digest): digest of the lower-cased words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [xxhash.xxh3_128_digest(b" ".join((x or "").encode("utf-8", "replace").lower().split())) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.binary())], names=["row", "id", "digest"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "text").mapInArrow(run, f"row bigint, id {kind}, digest binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, radius: int = 22) -> DataFrame:
    """One row of each component of near copies; all columns stay."""
    names = docs.columns
    docs = numbered(docs, "near-dedup-rows")
    slim = docs.select("row", of_row(id_col).alias("id"), of_row(text).alias("text"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    rows = written(_digests(slim), "word-digests")
    nodes = written(rows.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).select("digest", "n", "o.id", "o.row"), "distinct-texts")
    scratch: list[str] = []
    with noted(scratch):
        groups = connected_components(near_links(slim.join(nodes.select("row"), "row"), threshold, radius))
    for path in scratch:  # the components are on shared storage
        delete(docs.sparkSession, path)
    heads = groups.join(nodes.select("row", "id"), F.col("row") == F.col("node")).groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.row").alias("head"))
    later = groups.join(heads, F.col("node") == F.col("head"), "left_anti").select(F.col("node").alias("row"))
    copies = rows.join(nodes.filter("n > 1").select("digest", F.col("row").alias("first")), "digest").filter("row <> first").select("row")
    return docs.join(later.unionByName(copies), "row", "left_anti").select(*[of_row(c).alias(c) for c in names])

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Texts are lower-cased; shingles are five words with their multiplicity as weight; the similarity of two shingle bags is
sum(min) / sum(max). A document window of as many words as an item (the whole document, if it is shorter) matches at
`threshold` or more. DataFrame expressions only.

1. Anchors. A window at the threshold has at least 2tm/(1+t) of the item's m shingles, so it has a run of matching
   shingles no shorter than `anchor_step` gives; hashing every anchor_step-th shingle of a document misses no such window.
2. The windows that hold an anchor get a SimHash. Fingerprints within the radius agree in at least one of radius + 1
   blocks; (size, block, value) is the join key. At a similarity of 0.8 the expected distance is 10 of 64 bits; the default
   radius 20 is 3.5 standard deviations above it.
3. Pairs within the radius are compared exactly, shingle by shingle as words.

Defined cases: null or empty texts and items under five words match nothing; an id on several rows is judged by all of
them; null ids are left out; empty tables give empty results; other columns are ignored. The benchmark side is broadcast
only after its shingles were counted (limit `broadcast_rows`), and joined by shuffle beyond that.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import native_words

WIDTH = 5


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(hashes: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(WIDTH)])


def anchor_step(shingles: int, threshold: float) -> int:
    """A window that matches an item of so many shingles has a run of matching shingles at least this long."""
    unmatched = shingles - ceil(2 * threshold * shingles / (1 + threshold) - 1e-9)
    return max(1, ceil((shingles - unmatched) / (unmatched + 1)))


def simhash(shingles: Column) -> Column:
    """64 majority bits of an array of hashes, ties as 0."""
    bit = lambda a, b: a.bitwiseOR(F.when(F.aggregate(shingles, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int")) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    # never null, or the optimizer would test that in a filter below, with a second copy of all this
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit), F.lit(0).cast("bigint"))


def block_array(fp: Column, blocks: int) -> Column:
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cut, cut[1:])])


def weighted_similarity(a: Column, b: Column) -> Column:
    """sum(min) / sum(max) over two bags given as arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def _bag(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WIDTH), lambda i: F.array_join(F.slice(words, i + 1, WIDTH), " "))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8, radius: int = 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, item, start, n, hamming, similarity): the best window of each document and item that match."""
    items = benchmark.select(F.col(item_col).alias("item"), native_words(F.lower(F.col(item_text))).alias("iw")).filter(f"item is not null and size(iw) >= {WIDTH}")
    items = items.withColumn("n", F.size("iw")).withColumn("ih", _hashes(F.col("iw")))
    items = items.withColumn("ish", F.transform(F.sequence(F.lit(0), F.col("n") - WIDTH), lambda i: _shingle(F.col("ih"), i)))
    sizes = [(r["n"] - WIDTH + 1, r["items"]) for r in items.groupBy("n").agg(F.count("*").alias("items")).collect()]
    small = sum(m * k for m, k in sizes) * (radius + 1) <= broadcast_rows
    side = F.broadcast if small else lambda x: x
    step = min((anchor_step(m, threshold) for m, _ in sizes), default=1)

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    hashed = rows.select("id", _hashes(native_words(F.lower(F.col("body")))).alias("wh"))
    anchors = hashed.filter(F.size("wh") >= WIDTH).select("id", F.size("wh").alias("total"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("wh") - WIDTH, F.lit(step)), lambda i: F.struct(i.alias("p"), _shingle(F.col("wh"), i).alias("h")))).alias("a")).select("id", "total", "a.*")
    # outer, as the optimizer copies the input of other generators into a filter below, word hashes and all
    wanted = items.select("n", F.explode_outer("ish").alias("h")).distinct()
    hits = anchors.join(side(wanted), "h").select("id", "n", "total", "p").distinct()
    low = F.greatest(F.lit(0), F.least(F.col("p") - F.col("n") + WIDTH, F.col("total") - F.col("n")))
    high = F.greatest(F.lit(0), F.least(F.col("p"), F.col("total") - F.col("n")))
    starts = hits.select("id", "n", F.explode(F.sequence(low, high)).alias("start"))
    places = starts.groupBy("id").agg(F.collect_set(F.struct("n", "start")).alias("places"))

    found = rows.join(places, "id").withColumn("w", native_words(F.lower(F.col("body")))).withColumn("wh", _hashes(F.col("w")))
    found = found.withColumn("sh", F.transform(F.sequence(F.lit(0), F.size("wh") - WIDTH), lambda i: _shingle(F.col("wh"), i)))
    windows = found.select("id", "w", "sh", F.explode("places").alias("p")).select("id", "p.n", "p.start", F.slice("w", F.col("p.start") + 1, F.col("p.n")).alias("w"), F.slice("sh", F.col("p.start") + 1, F.col("p.n") - WIDTH + 1).alias("sh"))
    windows = windows.withColumn("fp", simhash(F.col("sh"))).withColumn("blocks", block_array(F.col("fp"), radius + 1))
    ifp = items.select("item", "n", "iw", "ish", simhash(F.col("ish")).alias("ifp"))
    keyed = ifp.select("item", "n", "iw", "ish", "ifp", F.posexplode_outer(block_array(F.col("ifp"), radius + 1)).alias("block", "value"))
    probe = windows.select("id", "n", "start", "w", "sh", "fp", "blocks", F.posexplode_outer("blocks").alias("block", "value"))
    near = probe.join(side(keyed), ["n", "block", "value"])
    # a pair that shares several blocks is passed on at the first of them
    first = F.array_position(F.zip_with("blocks", block_array(F.col("ifp"), radius + 1), lambda x, y: x == y), F.lit(True)) - 1
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    near = near.filter(F.when(hamming <= radius, F.when(first == F.col("block"), weighted_similarity(F.col("sh"), F.col("ish")) >= threshold)))
    # a generated row, so that the bags are built once and only for the pairs left
    bags = near.select("id", "item", "start", "w", "fp", "ifp", F.inline(F.array(F.struct(_bag(F.col("w")).alias("x"), _bag(F.col("iw")).alias("y")))))
    scored = bags.select("id", "item", "start", "w", "fp", "ifp", F.inline(F.array(F.struct(weighted_similarity(F.col("x"), F.col("y")).alias("similarity"))))).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct(F.col("similarity"), (-hamming).alias("closeness"), (-F.col("start")).alias("early"), F.size("w").alias("n")))
    out = scored.groupBy("id", "item").agg(best.alias("b"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.early")).cast("bigint").alias("start"), F.col("b.n").cast("bigint").alias("n_words"), (-F.col("b.closeness")).cast("bigint").alias("hamming"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows without a match, each judged by its own text, whatever its id. All columns stay, whatever their names."""
    names = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{text}`").alias("body"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("digest"))
    # the verdict depends on the text alone, so rows of one text share it
    bad = contaminated(docs.select("digest", F.col("body").alias("text")), benchmark, "digest", "text", **options).select("digest").distinct()
    return docs.join(bad, "digest", "left_anti").select(*[F.col("r")[c].alias(c) for c in names])

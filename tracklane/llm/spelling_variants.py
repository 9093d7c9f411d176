"""Spelling variant grouping: exact neighbours at one edit from a dictionary of trie-node pairs.

1. Words are counted: tasks send each word once for every so many different ones; no text is shuffled.
2. The nodes of the trie of all words, and of the trie of all words reversed, are numbered. A place in a word is then two
   integers: the node of what stands before it and the node of what stands after it.
3. A word files each of its letters as a skipped place (prefix node before it, suffix node after it) and each gap between
   letters as a place of insertion. Two words that skip to the same pair differ in that letter; a word that skips to the
   pair at which another inserts has that letter more. A letter equal to the one before it isn't skipped for insertions,
   as this gives the same word, so every pair of neighbours is found exactly once.
4. The members of a pair differ in one letter, so there are at most as many as the alphabet has letters, and one that
   inserts. Counts and best neighbours come from that bounded group; pairs of words are never listed.
5. Forms are followed to their ends by doubling. A form is `factor` times as frequent, so chains are short.

All joins merge: compressed tables of words and nodes look small enough to broadcast and are many times as large in memory.

Defined cases: null, empty and letterless texts have no words; a null id is an empty string in the hash that drops letters;
repeated rows count again; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import discard, written

#: Letters of words (A-Z are lower-cased before).
LETTERS = "a-zÀ-ÿ"
#: Different words that a task counts before it sends them.
HELD = 200_000


def with_drops(doc_id: int | None, run: str, every: int) -> str:
    """The run without one letter where the hash of id and run says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if every and h % every == 0:
        i = h % len(run)
        return run[:i] + run[i + 1 :]
    return run


def counted_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n): words of at least that many letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{least_length},}}").findall
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in Counter(find((x.as_py() or "").encode("utf-8", "replace").lower().decode())).items():
                    held[with_drops(i, word, drop_every)] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _nodes(words: DataFrame, part: str, name: str) -> DataFrame:
    """(word, nodes): the trie nodes on the way to each word, from the root (0); part is an expression of word and i > 0."""
    parts = words.select("word", F.explode(F.expr("sequence(1, length(word))")).alias("i")).withColumn("part", F.expr(part))
    numbers = written(parts.select("part").distinct().select("part", (F.monotonically_increasing_id() + 1).alias("node")), name)
    ways = parts.join(numbers.hint("merge"), "part").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("way"))
    return ways.select("word", F.expr("concat(array(0L), transform(way, x -> x.node))").alias(name))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word with a word at one edit, their number and the most frequent (n, word)."""
    both = words.join(_nodes(words, "left(word, i)", "prefix_nodes").hint("merge"), "word").join(_nodes(words, "right(word, i)", "suffix_nodes").hint("merge"), "word")
    size = "length(word)"
    skips = f"transform(sequence(1, {size}), i -> struct(prefix_nodes[i - 1] as p, suffix_nodes[{size} - i] as s, true as skips, i = 1 or substr(word, i, 1) <> substr(word, i - 1, 1) as counts))"
    gaps = f"transform(sequence(0, {size}), i -> struct(prefix_nodes[i] as p, suffix_nodes[{size} - i] as s, false as skips, true as counts))"
    places = both.select("word", "n", F.expr(f"inline(concat({skips}, {gaps}))"))
    # least first: most frequent, then the smallest word
    groups = places.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word", "skips", "counts"))).alias("all")).filter("size(all) > 1")
    groups = groups.select("all", F.expr("filter(all, x -> x.skips)").alias("same"), F.expr("filter(all, x -> x.skips and x.counts)").alias("longer"), F.expr("filter(all, x -> not x.skips)").alias("shorter"))
    other = "case when same[0].word <> x.word then same[0] else get(same, 1) end"
    seen = groups.select(F.explode("all").alias("x"), "same", "longer", "shorter").select(
        F.col("x.word").alias("word"),
        F.expr("case when not x.skips then size(longer) else size(same) - 1 + if(x.counts, size(shorter), 0) end").alias("k"),
        F.expr(f"case when not x.skips then get(longer, 0) when not x.counts then {other} else array_min(array({other}, get(shorter, 0))) end").alias("top"),
    )
    seen = seen.filter("k > 0").select("word", "k", F.struct("top.m", "top.word").alias("top"))
    return seen.groupBy("word").agg(F.sum("k").cast("bigint").alias("n_near"), F.min("top").alias("top")).select("word", "n_near", F.struct((-F.col("top.m")).alias("n"), F.col("top.word").alias("word")).alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word -> form -> ... of each word that has a form. Chains have no cycles."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = at.join(on.hint("merge"), "root", "left")
        if stepped.filter("next is not null").isEmpty():
            return at
        before, at = at, written(stepped.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(before)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is frequent enough; its form is its most frequent
    neighbour, if that is at least `factor` times as frequent.

    drop_every plants misspellings: a letter goes from each run of a document whose hash that number divides.
    """
    words = written(counted_words(docs, id_col, text, least_length, least_count, drop_every), "spelling-words")
    rows = words.join(near_words(words).hint("merge"), "word", "left")
    is_form = F.col("best.n") >= factor * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")), "spelling-forms")
    roots = followed(rows.filter("form is not null"))
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

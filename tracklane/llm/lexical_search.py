"""Ranked lexical search: no-random-access (NRA) reading of impact-sorted lists, shard by shard, with exact final scores.

1. Statistics, one pass: the number of documents and of terms, and for the terms that are asked for the documents that
   hold them. Tasks send one row a term.
2. Search, one pass: a shard is some thousand documents of one input partition, so that a word in a third of all
   documents is a third of every shard's list and never one task's. A shard sorts its lists by impact. For each item its
   lists are read from the front in growing steps. A document's score lies between the sum of the impacts read and that
   sum plus, for each list in which it hasn't been met, the next impact there. Reading goes on until no other document,
   met or not, can reach the k-th place or tie with it from before, and until the bounds of every member are equal.
3. The best k of each shard are merged; only these rows are shuffled.

Items are a stated query set: they are answered in blocks of bounded size (QUERY_BYTES of text), each block against all rows.

Defined cases: null, empty and termless texts hold no term and are never found; an item without terms, or whose terms are in
no document, has no rows; equal scores are ordered by id, null ids last; repeated rows are documents of their own; each row
of the items is answered by itself; very long texts are read whole; an empty table gives an empty result; only the id and
text columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents, and bytes of their text, that one shard holds lists of.
SHARD_ROWS, SHARD_BYTES = 8192, 64 << 20
#: Text of the items that one pass answers.
QUERY_BYTES = 4 << 20
#: Postings of each list that the first step reads; every step reads twice as many as the one before.
FIRST_STEP = 32

#: Bytes of terms (0-9, A-Z, a-z and all of UTF-8's multi-byte characters), A-Z in lower case; other bytes become blanks.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def statistics(texts: DataFrame, vocabulary: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, terms with repeats, and for each term of the vocabulary the documents that hold it."""
    known = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, df = known.value, np.zeros(len(known.value) + 2, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                words = terms_of(x.as_py())
                if words:
                    df[-2] += 1
                    df[-1] += len(words)
                    df[[at[t] for t in at.keys() & set(words)]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["i", "n"])

    got = {r.i: r.n for r in texts.mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row for each term asked for
    m = len(vocabulary)
    return got.get(m, 0), got.get(m + 1, 0), {t: got.get(i, 0) for i, t in enumerate(vocabulary)}


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the best k (score falling, then number), and how many postings were read.

    lists: documents and impacts of each list, impacts falling. Documents are numbers below n_docs, each at most once in a list.
    """
    lower, met = np.zeros(n_docs, dtype=np.int64), np.zeros((n_docs, len(lists)), dtype=bool)
    ahead = np.array([x[1][0] if len(x[1]) else 0 for x in lists], dtype=np.int64)
    depth, read = 0, 0
    while True:
        for j, (docs, impact) in enumerate(lists):
            if ahead[j]:
                part = docs[depth : depth + step]
                lower[part] += impact[depth : depth + step]
                met[part, j] = True
                read += len(part)
                ahead[j] = impact[depth + step] if len(impact) > depth + step else 0
        depth, step = depth + step, 2 * step
        unmet = int(ahead.sum())
        found = np.flatnonzero(lower > 0)
        found = found[np.argsort(-lower[found], kind="stable")]  # equal bounds stay in the order of their numbers
        members, others = found[:k], found[k:]
        if unmet:
            if len(members) < k or unmet >= lower[members[-1]]:
                continue  # a document that hasn't been met may become a member
            most = lower[others] + unmet - met[others] @ ahead
            last, least = members[-1], lower[members[-1]]
            if ((most > least) | ((most == least) & (others < last))).any():
                continue
            if (met[members] @ ahead < unmet).any():
                continue  # a member's score, and so its place, is still an interval
        return members, lower[members], read


class Shard:
    """Impact-sorted lists of some documents; documents are numbered by id."""

    def __init__(self, ids: list, lengths: list[int], postings: list[tuple[int, int, int]], weights: np.ndarray, n_docs: int, n_terms: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([100 - 75 + 75 * n * n_docs // n_terms for n in lengths], dtype=np.int64)
        term, doc, tf = np.array(postings, dtype=np.int64).reshape(-1, 3).T
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        doc = place[doc]
        by = np.lexsort((doc, -impact, term))
        by = by[impact[by] > 0]
        self.doc, self.impact = doc[by], impact[by]
        self.first = np.searchsorted(term[by], np.arange(len(weights) + 1))

    def best(self, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """asked: terms and how often the item has them."""
        cut = [(slice(self.first[t], self.first[t + 1]), c) for t, c in asked]
        return nra([(self.doc[s], c * self.impact[s]) for s, c in cut if s.start < s.stop], len(self.ids), k)


def _answers(docs: DataFrame, asked: list[Counter], k: int) -> DataFrame:
    """(q, id, score): the best k of each shard for each item."""
    spark = docs.sparkSession
    vocabulary = sorted({t for c in asked for t in c})
    n_docs, n_terms, df = statistics(docs.select("text"), vocabulary)
    at = {t: i for i, t in enumerate(vocabulary)}
    weights = np.array([term_weight(n_docs, df[t]) for t in vocabulary], dtype=np.int64)
    items = [[(at[t], n) for t, n in sorted(c.items()) if df[t]] for c in asked]
    given = spark.sparkContext.broadcast((at, weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, items = given.value
        ids, lengths, postings, size = [], [], [], 0

        def answer() -> pa.RecordBatch:
            shard = Shard(ids, lengths, postings, weights, n_docs, n_terms)
            q, found, score = [], [], []
            for i, terms in enumerate(items):
                d, s, _ = shard.best(terms, k)
                q += [i] * len(d)
                found += [shard.ids[j] for j in d]
                score += s.tolist()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["q", "id", "score"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(x.as_py())
                count = Counter(words)
                held = [(at[t], len(ids), count[t]) for t in at.keys() & count.keys()]
                if held:
                    ids.append(i)
                    lengths.append(len(words))
                    postings += held
                    size += 8 * len(words)
                if len(ids) >= SHARD_ROWS or size >= SHARD_BYTES:
                    yield answer()
                    ids, lengths, postings, size = [], [], [], 0
        if ids:
            yield answer()

    return docs.select("id", "text").mapInArrow(run, "q int, id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, rank from 1."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # query_bytes of text
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"q int, item_id {items.schema['item_id'].dataType.simpleString()}")
        top = _answers(docs, [Counter(terms_of(r.text)) for r in rows], k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        top = top.join(named, "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = top if out is None else out.unionByName(top)
    return out

"""Substring dedup over words by difference-cover anchors.

Positions of a document modulo the period 13 that lie in {0, 1, 3, 9} carry an anchor, the hash of 8 words. The set is a
difference cover: for any two positions some shift below 13 brings both into it. So two equal runs of 20 words, wherever
they start, share an aligned anchor (12 + 8 = 20). Only anchors that occur more than once in the corpus are extended to
the windows of 20 words around them, inside a block as between blocks; no window without such an anchor is looked at.
Each of these windows is removed unless it is the first of its kind.

Inside a block the windows of one hash are compared word by word; between blocks by two independent 64-bit hashes of
their words, both of which must agree. Order: by id (null ids first, rows of one id by text), then by place; windows are
judged on the input. Null, empty and short texts lose nothing; an empty table gives an empty result; a text of any length
is one row; other columns are ignored. Blocks of documents and buckets of hashes bound what a task holds; see exchange.py
for hot passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklane.llm.common import Batch, window_hashes
from tracklane.llm.exchange import blocked, bucket_cuts, by_bucket, covered, joined, n_buckets, texts_in_order

WIDTH, PERIOD, ANCHOR = 20, 13, 8
COVER = (0, 1, 3, 9)
SALT = 0x5851F42D4C957F2D


def _anchors(words: Batch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their hashes."""
    place = np.arange(len(hashes)) - words.first[words.doc]
    left = words.n_words[words.doc] - place
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= ANCHOR))
    h = window_hashes(hashes, ANCHOR)
    return at, h[at]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    among = np.sort(among)
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _around(words: Batch, at: np.ndarray) -> np.ndarray:
    """Places where a window of WIDTH words of one text starts that holds one of the anchors at these places."""
    doc = words.doc[at]
    low, high = np.maximum(words.first[doc], at - (WIDTH - ANCHOR)), np.minimum(at, words.first[doc + 1] - WIDTH)
    fits = low <= high
    return np.flatnonzero(covered(len(words.doc), low[fits], high[fits] + 1)) if len(words.doc) else np.zeros(0, np.int64)


class Candidates:
    """Of a block: the windows around repeated anchors, their two hashes, and which repeat an earlier one of the block."""

    def __init__(self, texts: list, repeated: np.ndarray):
        self.words = words = Batch(texts)
        hashes = words.word_hashes()
        at, h = _anchors(words, hashes)
        self.start = start = _around(words, at[_member(h, repeated)])
        self.one, self.two = window_hashes(hashes, WIDTH)[start], window_hashes(hashes, WIDTH, SALT)[start]
        order = np.lexsort((start, self.two, self.one))
        self.first = np.ones(len(start), dtype=bool)
        i, j = order[1:], order[:-1]
        same = (self.one[i] == self.one[j]) & (self.two[i] == self.two[j])
        i, j = i[same], j[same]
        self.first[i[self._equal(start[i], start[j])]] = False

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Extends pairs of windows word by word, by the bytes: words of these windows get a number for each spelling."""
        w = self.words
        number, at = np.zeros(len(w.doc), dtype=np.int64), np.concatenate([a, b])
        at = np.flatnonzero(covered(len(w.doc), at, at + WIDTH)) if len(at) else at
        spelling: dict[bytes, int] = {}
        number[at] = [spelling.setdefault(w.data[x:y], len(spelling)) for x, y in zip(w.start[at].tolist(), w.end[at].tolist())]
        same = np.ones(len(a), dtype=bool)
        for k in range(WIDTH):
            same &= number[a + k] == number[b + k]
        return same

    def among(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which windows have both hashes in a row of the two arrays."""
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        hit, at = np.zeros(len(self.one), dtype=bool), np.searchsorted(one, self.one)
        while True:  # once, but for different windows of one hash
            open_ = np.flatnonzero(~hit & (at < len(one)))
            open_ = open_[one[at[open_]] == self.one[open_]]
            if not len(open_):
                return hit
            hit[open_] = two[at[open_]] == self.two[open_]
            at[open_] += 1


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", per_block: int = 512) -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the words that stay, joined by one blank."""
    rows = blocked(docs, id_col, text, per_block)
    buckets = n_buckets(docs)

    def anchors(key, table):
        words = Batch(texts_in_order(table)[1])
        _, h = _anchors(words, words.word_hashes())
        h, times = np.unique(h, return_counts=True)
        cuts = list(bucket_cuts(h, buckets))
        return pa.table({
            "bucket": pa.array([c for c, _, _ in cuts], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "hashes": pa.array([h[a:b].tobytes() for _, a, b in cuts], pa.binary()),
            "twice": pa.array([np.packbits(times[a:b] > 1).tobytes() for _, a, b in cuts], pa.binary()),
        })

    def repeated(key, table):
        parts = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["twice"].to_pylist(), parts)]
        h, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = times > 1
        often[at[np.concatenate(twice) > 0]] = True
        hit, n = often[at], np.cumsum([0, *map(len, parts)])
        return pa.table({"block": table["block"], "hashes": pa.array([p[hit[a:b]].tobytes() for p, a, b in zip(parts, n, n[1:])], pa.binary())})

    def windows(key, left, right):
        c = Candidates(texts_in_order(left)[1], joined(right["hashes"].to_pylist(), "<u8"))
        one, two = c.one[c.first], c.two[c.first]
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        cuts = list(bucket_cuts(one, buckets))
        return pa.table({
            "bucket": pa.array([c for c, _, _ in cuts], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "one": pa.array([one[a:b].tobytes() for _, a, b in cuts], pa.binary()),
            "two": pa.array([two[a:b].tobytes() for _, a, b in cuts], pa.binary()),
        })

    def later(key, table):
        table = table.sort_by("block")
        parts = [np.frombuffer(x, "<u8") for x in table["one"].to_pylist()]
        one, two = np.concatenate(parts), joined(table["two"].to_pylist(), "<u8")
        order = np.lexsort((np.arange(len(one)), two, one))
        again = np.zeros(len(one), dtype=bool)
        again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        n = np.cumsum([0, *map(len, parts)])
        cut = lambda x: pa.array([x[a:b][again[a:b]].tobytes() for a, b in zip(n, n[1:])], pa.binary())
        return pa.table({"block": table["block"], "one": cut(one), "two": cut(two)})

    def removed(key, left, right):
        ids, texts = texts_in_order(left)
        of = {k: [x for x in right[k].to_pylist() if x is not None] for k in ("hashes", "one", "two")}
        c = Candidates(texts, joined(of["hashes"], "<u8"))
        words = c.words
        start = c.start[~c.first | c.among(joined(of["one"], "<u8"), joined(of["two"], "<u8"))]
        gone = covered(len(words.start), start, start + WIDTH) if len(words.start) else np.zeros(0, bool)
        lost, kept = [], []
        for i in range(len(ids)):
            a, b = words.first[i], words.first[i + 1]
            lost.append(int(gone[a:b].sum()))
            s, e = words.start[a:b][~gone[a:b]].tolist(), words.end[a:b][~gone[a:b]].tolist()
            kept.append(b" ".join([words.data[x:y] for x, y in zip(s, e)]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(words.n_words), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    sent = rows.groupBy("block").applyInArrow(anchors, "bucket int, block bigint, hashes binary, twice binary")
    told = by_bucket(sent).applyInArrow(repeated, "block bigint, hashes binary")
    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(windows, "bucket int, block bigint, one binary, two binary")
    earlier = by_bucket(sent).applyInArrow(later, "block bigint, one binary, two binary")
    answers = told.unionByName(earlier, allowMissingColumns=True).select("block", "hashes", "one", "two")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)

"""Suffix-array dedup over bytes: deep-shallow sorting finds the 400-byte strings that occur more than once.

Sorting every suffix of a corpus is not needed to find its long repeats. Each window of 400 bytes is filed under the
position of the smallest hash of 16 bytes among its first 100 positions; equal windows are filed alike. Only the first 300
bytes from such a position (part of each window filed there) are counted over the corpus. Where they repeat, and the whole
surrounding does not, the surroundings (under 500 bytes) of all occurrences meet, and the suffixes of all their windows
are sorted: multikey quicksort on words of 8 bytes to a shallow depth, then blind tries order the groups that still share
a prefix. Windows that agree over 400 bytes are repeats. Surroundings that repeat as a whole are recognised by two 64-bit
hashes, of the core and of the whole, and enter the sort once, however many documents have them; a document finds its answer
by the hash of the whole.

All occurrences go, the first included; matches never cross documents; strings are judged on the input. Null, empty and
short texts lose nothing; rows of one id are separate texts; null ids come back as null; an empty table gives an empty
result; other columns are ignored. Texts of any length are filed in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklane.llm.common import _BASE, _BYTE, _INVERSE, _powers, mix64
from tracklane.llm.exchange import blocked, bucket_cuts, by_bucket, covered, joined, n_buckets, texts_in_order

LENGTH, SPREAD, GRAM, SHALLOW = 400, 100, 16, 32
CORE = LENGTH - SPREAD
#: Windows of one text that are filed at once.
PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _words8(buf: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at every position, zeros past the end."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | pad[j : j + len(buf)]
    return out


class Places:
    """Of a block of texts: filing positions x and, for each, the windows low .. high (starts in data) filed there."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.data = b"".join(raw)
        buf = np.frombuffer(self.data, dtype=np.uint8)
        xs, lows, highs = [], [], []
        for i, a, b in zip(range(len(raw)), self.base, self.base[1:]):
            if b - a >= LENGTH:
                for at in range(a, b - LENGTH + 1, PIECE):
                    x, low, high = self._file(buf[at : min(b, at + PIECE + LENGTH - 1)])
                    xs.append(x + at), lows.append(low + at), highs.append(high + at)
        one = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        self.x, self.low, self.high = one(xs), one(lows), one(highs)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, len(buf) + 1)
        self.core = self._hash(self.x, self.x + CORE)
        shape = mix64(((self.x - self.low) * 1000 + (self.high - self.x + 500)).astype(np.uint64))
        self.whole = mix64(self._hash(self.low, self.high + LENGTH) ^ shape)

    @staticmethod
    def _file(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(buf) - LENGTH + 1
        w = _words8(buf)
        m = n + SPREAD - 1
        place = np.arange(m, dtype=np.uint64)
        h = mix64(w[:m] ^ (mix64(w[8 : 8 + m]) * np.uint64(3)))
        v = (h & ~_PLACE) | place  # the smallest hash, the leftmost of equal ones
        v = np.concatenate([v, np.full(-m % SPREAD + SPREAD, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, SPREAD)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[SPREAD - 1 : SPREAD - 1 + n])
        x = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[first], first, np.concatenate([first[1:], [n]]) - 1

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


class BlindTrie:
    """Patricia trie that stores branching depths only: find a candidate leaf, compare once, branch at the first difference."""

    def __init__(self, data: bytes, limit: int):
        self.data, self.limit, self.root = data, limit, None

    def _string(self, at: int) -> bytes:
        return self.data[at : at + self.limit]

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def add(self, at: int) -> None:
        s = self._string(at)
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, sons = node
            node = sons.get(s[depth]) if depth < len(s) else None
            if node is None:
                node = next(iter(sons.values()))
        other = self._string(node[0])
        shared = self._common(s, other)
        if shared == len(s) == len(other):
            node.append(at)
            return
        up, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            up, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][s[shared]] = [at]
            return
        fork = (shared, {other[shared]: node, s[shared]: [at]})
        if up is None:
            self.root = fork
        else:
            up[1][key] = fork

    def leaves(self) -> list[list[int]]:
        """Groups of equal strings, in lexicographic order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow(data: bytes, start: np.ndarray, limit: int = LENGTH, shallow: int = SHALLOW) -> list[np.ndarray]:
    """Groups of positions whose next `limit` bytes are equal, in suffix order; groups of one are left out."""
    words = _words8(np.frombuffer(data, dtype=np.uint8))
    order, depth = np.asarray(start, dtype=np.int64), 0
    group = np.zeros(len(order), dtype=np.int64)
    while depth < shallow and len(order):  # multikey quicksort, a word at a time; what is alone leaves
        w = words[order + depth]
        by = np.lexsort((w, group))
        order, group, w = order[by], group[by], w[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (w[1:] != w[:-1])])
        group = np.cumsum(new)
        times = np.bincount(group)[group]
        order, group, depth = order[times > 1], group[times > 1], depth + 8
    out = []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        members = order[a:b].tolist()
        if len(members) == 2:  # a trie of two leaves is one comparison
            if data[members[0] : members[0] + limit] == data[members[1] : members[1] + limit]:
                out.append(order[a:b])
            continue
        trie = BlindTrie(data, limit)
        for m in members:
            trie.add(m)
        out += [np.array(x) for x in trie.leaves() if len(x) > 1]
    return out


def _order(core: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.lexsort((whole, core))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal keys."""
    return np.concatenate([np.ones(min(1, len(keys[0])), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", per_block: int = 512) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay."""
    rows = blocked(docs, id_col, text, per_block)
    buckets = n_buckets(docs)
    hashes = ("core", "whole")

    def filed(key, table):
        p = Places(texts_in_order(table)[1])
        order = _order(p.core, p.whole)
        first = np.flatnonzero(_new(p.core[order], p.whole[order]))
        times = np.diff([*first, len(order)])
        order = order[first]
        cuts = list(bucket_cuts(p.core[order], buckets))
        return pa.table({
            "bucket": pa.array([c for c, _, _ in cuts], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            **{k: pa.array([getattr(p, k)[order[a:b]].tobytes() for _, a, b in cuts], pa.binary()) for k in hashes},
            "twice": pa.array([np.packbits(times[a:b] > 1).tobytes() for _, a, b in cuts], pa.binary()),
        })

    def verdicts(key, table):
        """1: the whole surrounding repeats; 2: it has to be sorted with the others of its core."""
        table = table.sort_by("block")
        parts = [np.frombuffer(x, "<u8") for x in table["whole"].to_pylist()]
        core, whole = (joined(table[k].to_pylist(), "<u8") for k in hashes)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["twice"].to_pylist(), parts)])
        by = _order(core, whole)
        core, whole = core[by], whole[by]
        head, of_core = _new(core, whole), np.cumsum(_new(core)) - 1
        of = np.cumsum(head) - 1
        again = (np.bincount(of) > 1) | (np.bincount(of, twice[by]) > 0)
        kinds = np.bincount(of_core, head)  # different surroundings of a core
        code = np.zeros(len(by), np.uint8)
        code[by] = again[of] + 2 * (head & (kinds[of_core] > 1))
        n = np.cumsum([0, *map(len, parts)])
        some = [np.flatnonzero(code[a:b]) for a, b in zip(n, n[1:])]
        return pa.table({"block": table["block"], "whole": pa.array([p[i].tobytes() for p, i in zip(parts, some)], pa.binary()), "code": pa.array([code[a:][i].tobytes() for a, i in zip(n, some)], pa.binary())})

    def codes(p: Places, told: pa.Table) -> np.ndarray:
        whole, code = joined(told["whole"].to_pylist(), "<u8"), joined(told["code"].to_pylist(), "u1")
        if not len(whole):
            return np.zeros(len(p.x), np.uint8)
        by = np.argsort(whole)
        at = np.minimum(np.searchsorted(whole[by], p.whole), len(whole) - 1)
        return np.where(whole[by][at] == p.whole, code[by][at], 0)

    def surroundings(key, left, right):
        p = Places(texts_in_order(left)[1])
        send = np.flatnonzero(codes(p, right) & 2)
        send = send[np.unique(p.whole[send], return_index=True)[1]]
        send = send[np.argsort(p.core[send], kind="stable")]
        cuts = list(bucket_cuts(p.core[send], buckets))
        span = [p.data[a:b] for a, b in zip(p.low[send].tolist(), (p.high[send] + LENGTH).tolist())]
        return pa.table({
            "bucket": pa.array([c for c, _, _ in cuts], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "whole": pa.array([p.whole[send[a:b]].tobytes() for _, a, b in cuts], pa.binary()),
            "size": pa.array([np.array([len(x) for x in span[a:b]], "<u2").tobytes() for _, a, b in cuts], pa.binary()),
            "bytes": pa.array([b"".join(span[a:b]) for _, a, b in cuts], pa.binary()),
        })

    def sorted_windows(key, table):
        data = b"".join(table["bytes"].to_pylist())
        sizes = [np.frombuffer(x, "<u2").astype(np.int64) for x in table["size"].to_pylist()]
        size = np.concatenate(sizes)
        base = np.cumsum(size) - size
        n = size - LENGTH + 1
        owner = np.repeat(np.arange(len(size)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.zeros(len(data) + 1, dtype=bool)
        for g in deep_shallow(data, base[owner] + inside):
            hit[g] = True
        masks = np.zeros((len(size), SPREAD), dtype=np.uint8)
        masks[owner, inside] = hit[base[owner] + inside]
        packed = np.packbits(masks, axis=1)
        cut = np.cumsum([0, *map(len, sizes)])
        return pa.table({"block": table["block"], "whole": table["whole"], "mask": pa.array([packed[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def removed(key, left, right):
        ids, texts = texts_in_order(left)
        p = Places(texts)
        is_mask = np.array([m is not None for m in right["mask"].to_pylist()], dtype=bool)
        told, masks = right.filter(pa.array(~is_mask)), right.filter(pa.array(is_mask))
        code = codes(p, told)
        full = np.flatnonzero(code & 1)
        start, end = [p.low[full]], [p.high[full] + LENGTH]
        whole, mask = joined(masks["whole"].to_pylist(), "<u8"), joined(masks["mask"].to_pylist(), "u1").reshape(-1, (SPREAD + 7) // 8)
        if len(whole):
            by = np.argsort(whole)
            at = np.minimum(np.searchsorted(whole[by], p.whole), len(whole) - 1)
            some = np.flatnonzero(whole[by][at] == p.whole)
            which, off = np.nonzero(np.unpackbits(mask[by][at[some]], axis=1))
            s = p.low[some[which]] + off
            start.append(s), end.append(s + LENGTH)
        gone = covered(len(p.data), np.concatenate(start), np.concatenate(end)) if p.data else np.zeros(0, bool)
        lost, spans, kept = [], [], []
        for a, b in zip(p.base.tolist(), p.base[1:].tolist()):
            g = gone[a:b]
            lost.append(int(g.sum()))
            spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
            kept.append(np.frombuffer(p.data, np.uint8)[a:b][~g].tobytes() if lost[-1] else p.data[a:b])
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(p.size), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    sent = rows.groupBy("block").applyInArrow(filed, "bucket int, block bigint, core binary, whole binary, twice binary")
    told = by_bucket(sent).applyInArrow(verdicts, "block bigint, whole binary, code binary")
    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(surroundings, "bucket int, block bigint, whole binary, size binary, bytes binary")
    masks = by_bucket(sent).applyInArrow(sorted_windows, "block bigint, whole binary, mask binary")
    answers = told.unionByName(masks, allowMissingColumns=True).select("block", "whole", "code", "mask")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)

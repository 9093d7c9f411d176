"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves pre-tokens that are themselves tokens, each
candidate confirmed by comparing bytes. Tier two: the others are merged with a heap of ranked neighbour pairs over their
bytes, linked in both directions, O(n log n) for a pre-token of n bytes.

Rows are independent: one pass, no shuffle. Null and empty texts give no ids; very long texts only cost their length;
repeated rows are encoded alike; an empty table gives an empty result; all input columns stay (an input column named like
an output is replaced). Of two pairs of equal rank the left one is joined first.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers remembered by one worker, in each of two generations; bounds memory, not results.
CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hashing and displacing: n keys fill slots 0..n-1, one displacement a bucket of keys.

    Buckets go from large to small and try displacements until all their keys fall on free slots; buckets of one key
    take the slots that are left, stored as a negative number.
    """

    def __init__(self, ranks: dict[bytes, int], keys_per_bucket: int = 2, seed: int = 0):
        keys = list(ranks)
        n = self.n = len(keys)
        self.buckets, self.seed = max(1, n // keys_per_bucket), seed
        hashes = [xxhash.xxh64_intdigest(k, seed) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        shift, at = [0] * self.buckets, [-1] * n
        order = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        for b, members in order:
            if len(members) == 1:
                break
            for d in range(1, 100 * n + 1000):
                slots = [(hashes[i] >> 20 ^ d * 0x9E3779B1) % n for i in members]
                if len(set(slots)) == len(slots) and all(at[s] < 0 for s in slots):
                    break
            else:  # two keys move alike: another hash
                return self.__init__(ranks, keys_per_bucket, seed + 1)
            shift[b] = d
            for i, s in zip(members, slots):
                at[s] = i
        free = iter([s for s in range(n) if at[s] < 0])
        for b, members in order:
            if len(members) == 1:
                s = next(free)
                shift[b], at[s] = -s - 1, members[0]
        self.shift, self.keys, self.ids = shift, [keys[i] for i in at], [ranks[keys[i]] for i in at]

    def find(self, key: bytes) -> int:
        """Rank of a byte string, -1 if it isn't in the vocabulary."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else (h >> 20 ^ d * 0x9E3779B1) % self.n
        return self.ids[s] if self.keys[s] == key else -1


class Remembered(dict):
    """Answers of a function, in two generations: when the newer one is full it replaces the older one."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, key):
        answer = self.old.get(key)
        if answer is None:
            answer = self.ask(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = answer
        return answer


def merge(piece: bytes, find) -> list[int]:
    """Ids of a pre-token: again and again the leftmost pair of lowest rank is joined. Every byte must be a token.

    A part starts at i and ends at end[i], where the next one starts; a part that is gone has the end 0. Heap entries hold
    rank, start and end of a pair as one number; one is stale if no two neighbours span it any more.
    """
    n = len(piece)
    b = n.bit_length()
    low = (1 << b) - 1
    end, left = list(range(1, n + 1)), list(range(-1, n))
    heap = [r << 2 * b | i << b | i + 2 for i in range(n - 1) if (r := find(piece[i : i + 2])) >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        i, stop = x >> b & low, x & low
        j = end[i]
        if not j or j == n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            k = end[stop]
            if (r := find(piece[i:k])) >= 0:
                push(heap, r << 2 * b | i << b | k)
        if i:
            h = left[i]
            if (r := find(piece[h:stop])) >= 0:
                push(heap, r << 2 * b | h << b | stop)
    out, i = [], 0
    while i < n:
        out.append(find(piece[i : end[i]]))
        i = end[i]
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. Its memory lives as long as the worker."""

    def __init__(self, table: PerfectHash, pattern: str):
        self.rank, self.split = Remembered(table.find), regex.compile(pattern).findall
        self.token = Remembered(self._token)

    def _token(self, token: str) -> bytes:
        raw = token.encode("utf-8", "replace")
        one = self.rank[raw]
        ids = [one] if one >= 0 else merge(raw, self.rank.__getitem__)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.token.__getitem__, self.split(text or "")))


class Coder:
    """What is sent to the workers: the perfect hash and the bytes of every id; encoders are made there, once."""

    def __init__(self, ranks_path: str):
        ranks = read_ranks(ranks_path)
        self.table, self.bytes_of, self.encoders = PerfectHash(ranks), {i: k for k, i in ranks.items()}, {}

    def encoder(self, pattern: str) -> Encoder:
        if pattern not in self.encoders:
            self.encoders[pattern] = Encoder(self.table, pattern)
        return self.encoders[pattern]

    def decode(self, ids: bytes | None) -> bytes | None:
        return None if ids is None else b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))


def _schema(df: DataFrame, *added: str) -> str:
    names = {a.split(" ")[0] for a in added}
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names] + list(added))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Appends `n_tokens` and `token_ids`, the ids as little-endian unsigned 32-bit integers.

    `decoded` adds the column of that name in the same pass, decoded from the ids. The table is built once on the driver
    and broadcast: its size is that of the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Coder(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        encoder = coder.encoder(pattern)
        for b in batches:
            ids = [encoder.encode(x.as_py()) for x in b.column(text)]
            more = {"decoded": pa.array(map(coder.decode, ids), pa.binary())} if decoded else {}
            yield _with(b, n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), token_ids=pa.array(ids, pa.binary()), **more)

    return docs.mapInArrow(run, _schema(docs, "n_tokens bigint", "token_ids binary", *["decoded binary"] * decoded))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """Appends `decoded`, the bytes that the ids stand for (null for null)."""
    shared = df.sparkSession.sparkContext.broadcast(Coder(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _with(b, decoded=pa.array([shared.value.decode(x.as_py()) for x in b.column(ids)], pa.binary()))

    return df.mapInArrow(run, _schema(df, "decoded binary"))


def digests(df: DataFrame) -> list:
    return [F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]

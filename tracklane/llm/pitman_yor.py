"""LM scoring by a hierarchical Pitman-Yor model.

Levels: a uniform base over the vocabulary and one unknown word; a restaurant of single words above it; and above that a
restaurant for each previous word, which all share the word restaurant as parent. Words are told apart by 64 bits of hash,
previous words by 56; no two share a restaurant otherwise.

Customers of a dish sit at tables; each table is a customer of the parent. Seatings are sampled by Gibbs: in a sweep as
many customers as a dish has leave and sit down again, one after the other for dishes of up to ROUNDS customers, in ROUNDS
blocks for larger ones (members of a block don't see each other). A table that opens or closes is passed to the word
restaurant at once. Table sizes are kept between sweeps. Random numbers are hashes of seed, sweep, round, word and context,
so seatings don't depend on the number of partitions. The predictive probability is averaged over the sweeps after burn-in.
Discounts come from counts of counts over the whole corpus.

Pairs of word and context are bucketed by word. A context's totals are sums over buckets of words: after each sweep buckets
send the tables of their contexts to buckets of contexts, which add them up and answer by position, so that no task and no
driver sees the totals of all contexts. Only pairs of two customers or more ever move, and only they are kept and
exchanged between sweeps; pairs seen once are counted again from the texts when these are scored.

Texts meet the model by bucket, in chunks, and only packed sums by chunk travel back.

Defined cases: null and empty texts are one end token; rows of one id are scored apart; a null id trains; with no training
token every word is unknown and scores base log10(1 / (N + V + 1)); an empty table gives an empty result; a very long text
is one chunk; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import Batch, discard, mix64, ranked, release, shuffle_partitions, written
from tracklane.llm.exchange import bucket_cuts, joined

#: Blocks in which the customers of a large dish are seated again in a sweep.
ROUNDS = 32
END, BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
STRENGTH = 1.0
#: Bytes of text that one chunk holds in memory at most, unless a single text is longer.
CHUNK = 6 << 20
#: Rows of a chunk at most: a text of a chunk and whether it is held out are one number of 16 bits.
ROWS = 30_000
#: Contexts that buckets of words send to one bucket of contexts, about.
PART = 1 << 19


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // CHUNK if len(sizes) else np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(sizes) else []
    for a, b in zip(first, [*first[1:], len(sizes)]):
        for lo in range(int(a), int(b), ROWS):
            yield batch.slice(lo, min(ROWS, int(b) - lo))


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context (hash of the word before, its last byte zero) and text of each token, sorted by word and context."""
    words = Batch(texts, lower=True)
    n = len(words.start) + len(texts)
    word = np.full(n, END, dtype=np.uint64)
    word[np.arange(len(words.start)) + words.doc] = words.word_hashes()
    doc = np.repeat(np.arange(len(texts)), words.n_words + 1)
    told = pa.array(np.append(word, BEGIN)).dictionary_encode()  # words repeat much, so this is faster than a sort
    known, rank = ranked(told.dictionary.to_numpy())
    rank = rank[told.indices.to_numpy()]
    before = np.concatenate([rank[-1:], rank[:-2]])[:n]
    before[np.concatenate([[0], np.cumsum(words.n_words + 1)[:-1]]).astype(np.int64)] = rank[-1]
    order = _order((rank[:-1] << _bits(len(known))) | before, 2 * _bits(len(known)))
    return word[order], known[before[order]] & ~np.uint64(255), doc[order]


def _bits(n: int) -> int:
    """Of the numbers 0 .. n - 1."""
    return max(n - 1, 0).bit_length()


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable np.argsort of integers of so many bits, by a sort of keys that end in their places, where that fits."""
    low = _bits(len(key))
    if bits + low > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << low) | np.arange(len(key))) & ((1 << low) - 1)


def _pairs(words: np.ndarray, times: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different words and contexts, of each different pair the places of both, and of each row the place of its pair.

    The rows have the contexts, and each of the words is that of so many rows.
    """
    words, w = ranked(words)
    contexts, x = ranked(context)
    low = _bits(len(contexts))
    keys, pair = ranked((np.repeat(w, times) << low) | x, _bits(len(words)) + low)
    return words, contexts, keys >> low, keys & ((1 << low) - 1), pair


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def uniform(key: np.ndarray, *more: int) -> np.ndarray:
    """Numbers in [0, 1) that are a hash of the key and further numbers."""
    salt = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for x in more:
            salt = mix64(salt ^ (np.uint64(x) * np.uint64(0x9E3779B97F4A7C15)))
    key = mix64(key ^ salt)
    return (key >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _nth(n: np.ndarray) -> np.ndarray:
    """0 .. n[i] - 1 for each i, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Seats:
    """Tables of dishes: t tables of each dish, their sizes one after the other, and a key of each dish for its random numbers."""

    def __init__(self, key: np.ndarray, t: np.ndarray, size: np.ndarray):
        self.key, self.owner, self.size = key, np.repeat(np.arange(len(key)), t), size.astype(np.int64)

    @classmethod
    def dealt(cls, key: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> Seats:
        """The start: customers dealt evenly over so many tables."""
        each, rest = np.divmod(customers.astype(np.int64), np.maximum(tables, 1))
        return cls(key, tables, np.repeat(each, tables) + (_nth(tables) < np.repeat(rest, tables)))

    def part(self, dish: np.ndarray) -> Seats:
        """Some dishes (ascending) by themselves."""
        at = np.full(len(self.key), -1)
        at[dish] = np.arange(len(dish))
        mine = at[self.owner] >= 0
        return Seats.of(self.key[dish], at[self.owner[mine]], self.size[mine])

    @classmethod
    def of(cls, key: np.ndarray, owner: np.ndarray, size: np.ndarray) -> Seats:
        seats = cls(key, np.zeros(len(key), np.int64), size)
        seats.owner = owner
        return seats

    def put(self, parts: list[tuple[np.ndarray, Seats]]) -> None:
        """Takes the tables of all dishes from parts, each with its dishes."""
        owner = np.concatenate([dish[x.owner] for dish, x in parts])
        order = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[order], np.concatenate([x.size for _, x in parts])[order]

    def tables(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=len(self.key))

    def customers(self) -> np.ndarray:
        return np.bincount(self.owner, self.size, len(self.key)).astype(np.int64)

    def change(self, dish: np.ndarray, leave: np.ndarray, join: np.ndarray, discount: float, fresh: np.ndarray, *stamp: int) -> tuple[np.ndarray, np.ndarray]:
        """Some customers of the dishes (ascending) leave, drawn evenly, then some join; fresh is the weight of a new table.

        Returns the tables closed and opened for each of these dishes.
        """
        k, every = len(dish), len(dish) == len(self.key)
        first = np.concatenate([[0], np.cumsum(self.tables())])
        n = first[dish + 1] - first[dish]
        edge = np.concatenate([[0], np.cumsum(n)])
        at = slice(None) if every else np.arange(edge[-1]) + np.repeat(first[dish] - edge[:-1], n)
        size, key = self.size[at], self.key if every else self.key[dish]
        total = np.concatenate([[0], np.cumsum(size)])
        had = total[edge[1:]] - total[edge[:-1]]
        # customer (j + u) * had / leave of a dish leaves for j = 0 .. leave - 1: as many of each table as lie between its ends
        shift, some = np.zeros(k), n > 1
        shift[some] = uniform(key[some], *stamp, 1)
        end = (total[1:] - np.repeat(total[edge[:-1]], n)) * np.repeat(leave / np.maximum(had, 1), n) - np.repeat(shift, n)
        gone, some = np.ceil(end).astype(np.int64), n > 0
        gone[edge[1:][some] - 1] = leave[some]
        before = np.concatenate([[0], gone])[:-1]
        before[edge[:-1][some]] = 0
        size = size - (gone - before)
        cum = np.concatenate([[0.0], np.cumsum(np.maximum(size - discount, 0.0))])
        old = np.where(had > leave, cum[edge[1:]] - cum[edge[:-1]], 0.0)
        of, j = np.repeat(np.arange(k), join), _nth(join)
        with np.errstate(over="ignore"):
            pick = uniform(key[of] + j.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), *stamp, 2) * (old + fresh)[of]
        weight = old[of]
        new = pick >= weight
        stay = np.flatnonzero(~new)  # none at an empty dish, where the first opens a table and the others of the block sit down there
        new = of[new & ((weight > 0) | (j == 0))]
        table, last = edge[:-1][of[stay]], edge[1:][of[stay]] - 1
        many = np.flatnonzero(last > table)  # where there is but one table, that is it
        lowest = table[many]
        found = np.searchsorted(cum, cum[lowest] + pick[stay[many]], side="right") - 1
        table[many] = np.minimum(np.maximum(found, lowest), last[many])
        size = size + np.bincount(table, minlength=len(size))
        opened, empty = np.bincount(new, minlength=k), np.flatnonzero(size == 0)
        closed = np.bincount(np.searchsorted(edge, empty, side="right") - 1, minlength=k)
        if every:
            self.size = size
        else:
            self.size[at] = size
        if len(empty):
            keep = self.size > 0
            self.owner, self.size = self.owner[keep], self.size[keep]
        if len(new):
            place = np.searchsorted(self.owner, dish[new], side="right")
            self.owner = np.insert(self.owner, place, dish[new])
            self.size = np.insert(self.size, place, np.where(old > 0, 1, np.maximum(join, 1))[new])
        return closed, opened


def blocks(customers: np.ndarray, r: int) -> np.ndarray:
    """How many customers of each dish are seated again in round r of a sweep; all of them in ROUNDS rounds."""
    return np.where(customers <= ROUNDS, (customers > r).astype(np.int64), customers * (r + 1) // ROUNDS - customers * r // ROUNDS)


def gibbs(pairs: Seats, of: np.ndarray, words: Seats, d1: float, d0: float, weight: np.ndarray, fresh0: float, parent, number: int) -> None:
    """A sweep: pairs are dishes of context restaurants (word `of`, weight of a new table before its dish `weight`).

    words are the dishes of the parent; parent(customers, tables) is the parent's probability of each dish, by itself.
    Customers of the parent that don't come from `pairs` are the tables of dishes with one customer, which never move.
    Dishes that have no customer left to move are put aside, so a round costs what it moves.
    """
    mine, of = np.unique(of, return_inverse=True)
    above, parts, live = words.part(mine), [], np.arange(len(of))
    customers, seats = pairs.customers(), pairs
    for r in range(ROUNDS if len(of) else 0):
        n = blocks(customers[live], r)
        dish = np.flatnonzero(n)
        if not len(dish):
            break
        if len(dish) < 0.8 * len(live):
            rest = np.flatnonzero(n == 0)
            parts.append((live[rest], seats.part(rest)))
            seats, live, n = seats.part(dish), live[dish], n[dish]
            dish = np.arange(len(live))
        at = of[live[dish]]
        p = parent(above.customers(), above.tables())
        closed, opened = seats.change(dish, n[dish], n[dish], d1, weight[live[dish]] * p[at], number, r, 3)
        less, more = np.bincount(at, closed, len(mine)).astype(np.int64), np.bincount(at, opened, len(mine)).astype(np.int64)
        some = np.flatnonzero(less + more)
        above.change(some, less[some], more[some], d0, np.full(len(some), fresh0), number, r, 4)
    if parts:
        pairs.put([*parts, (live, seats)])
    others = np.setdiff1d(np.arange(len(words.key)), mine)
    words.put([(mine, above), (others, words.part(others))])
    customers, seats, live, parts = words.customers(), words, np.arange(len(words.key)), []
    for r in range(ROUNDS):
        n = blocks(customers[live], r)
        dish = np.flatnonzero(n)
        if not len(dish):
            break
        if len(dish) < 0.8 * len(live):
            rest = np.flatnonzero(n == 0)
            parts.append((live[rest], seats.part(rest)))
            seats, live, n = seats.part(dish), live[dish], n[dish]
            dish = np.arange(len(live))
        seats.change(dish, n[dish], n[dish], d0, np.full(len(dish), fresh0), number, r, 5)
    if parts:
        words.put([*parts, (live, seats)])


def expected_tables(customers: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where the sampler starts: tables that so many arrivals with a new-table weight of `fresh` open on average."""
    f = np.maximum(fresh, 1e-12)
    return np.clip(np.rint(f * np.log1p(customers / f)), 1, np.maximum(customers, 1)).astype(np.int64)


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05, 0.95))


def _planes(x: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, byte by byte: zeros of small ones lie together and compress well."""
    top = int(x.max()) if x.size else 0
    if top < 1 << 8:
        return b"\1" + x.astype("u1").tobytes()
    k = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([k]) + np.ascontiguousarray(x.astype(f"<u{k}")).view("u1").reshape(-1, k).T.tobytes()


def _ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    k = data[0]
    if k == 1:
        return np.frombuffer(data, "u1", offset=1).astype(np.int64)
    return np.ascontiguousarray(np.frombuffer(data, "u1", offset=1).reshape(k, -1).T).view(f"<u{k}").ravel().astype(np.int64)


#: The bytes of a context.
_TAIL = np.dtype([("zero", "u1"), ("tail", "V7")])


def _contexts(x: np.ndarray) -> bytes:
    """Contexts without their last byte, which is zero."""
    return x.astype("<u8").view(_TAIL)["tail"].tobytes()


def _of_contexts(data: list[bytes]) -> np.ndarray:
    tail = joined(data, "V7")
    out = np.zeros(len(tail), dtype="<u8")
    out.view(_TAIL)["tail"] = tail
    return out


class Model:
    """Totals of a seating: customers and tables of some contexts, of the word restaurant (-1), and discounts."""

    def __init__(self, totals: dict[int, tuple[float, float]], vocabulary: int, d1: float, d0: float):
        contexts = [totals[k] for k in sorted(totals) if k >= 0]
        self.c, self.t = np.array([c for c, _ in contexts]), np.array([t for _, t in contexts])
        self.c0, self.t0 = totals.get(-1, (0.0, 0.0))
        self.d1, self.d0, self.base = d1, d0, 1.0 / (vocabulary + 1)

    def of_contexts(self, c: np.ndarray, t: np.ndarray) -> Model:
        out = copy(self)
        out.c, out.t = c, t
        return out

    def word(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        return (c0 - self.d0 * t0 + (STRENGTH + self.d0 * self.t0) * self.base) / (STRENGTH + self.c0)

    def fresh(self, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.d1 * self.t[context]) * parent

    def pair(self, context: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (c - self.d1 * t + self.fresh(context, parent)) / (STRENGTH + self.c[context])


#: Of a bucket: its contexts with customers and words; of its words with a customer, those of single customers (alone) and
#: the pairs of two or more: their contexts as places in `moving`, and customers.
COUNTS = "bucket int, contexts binary, customers binary, kinds binary, words binary, alone binary, pairs binary, moving binary, context binary, c binary, n bigint, v bigint, pair1 bigint, pair2 bigint, word1 bigint, word2 bigint, n_contexts bigint"
#: Seats of the pairs that move and of words; kinds: words of each moving context; more: tables beyond one for each pair.
SEATS = "bucket int, words binary, alone binary, pairs binary, moving binary, context binary, c binary, kinds binary, t binary, sizes binary, t0 binary, sizes0 binary, more binary, samples binary, samples0 binary, extra binary, n_tables bigint, n_tables0 bigint"


def count_words(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of (word, context) over the rows of (held_out, text) that aren't held out, packed by bucket of words.

    The contexts of held-out texts are in `contexts` too, as these texts will ask for their totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                word, context, doc = tokens(part.column("text").cast(pa.binary()).to_pylist())
                trains = ~np.array(part.column("held_out").to_pylist(), dtype=bool)
                at = _runs(word, context)
                n = np.add.reduceat(trains[doc].astype(np.int64), at)
                word, context = word[at], context[at]
                out = []
                for k, a, b in bucket_cuts(word, buckets):
                    first = _runs(word[a:b])
                    out.append((k, word[a:b][first].tobytes(), np.diff(first, append=b - a).astype("<u4").tobytes(), _contexts(context[a:b]), _planes(n[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "words", "pairs", "context", "n"])

    def merge(key, table):
        if not table.num_rows:
            return pa.table({})
        words, pairs = joined(table["words"].to_pylist(), "<u8"), joined(table["pairs"].to_pylist(), "<u4")
        context, n = _of_contexts(table["context"].to_pylist()), np.concatenate([_ints(x) for x in table["n"].to_pylist()])
        words, contexts, of, place, pair = _pairs(words, pairs, context)
        c = np.bincount(pair, n, len(of)).astype(np.int64)
        customers, kinds = np.bincount(place, c, len(contexts)), np.bincount(place, c > 0, len(contexts))
        cw = np.bincount(of, c, len(words))
        of, place, c = (np.cumsum(cw > 0) - 1)[of[c > 0]], place[c > 0], c[c > 0]  # what only held-out texts have goes
        words, cw, many = words[cw > 0], cw[cw > 0], c > 1
        moving, place = np.unique(contexts[place[many]], return_inverse=True)
        held = {
            "contexts": contexts.tobytes(), "customers": _planes(customers), "kinds": _planes(kinds), "words": words.tobytes(), "alone": _planes(np.bincount(of[~many], minlength=len(words))),
            "pairs": _planes(np.bincount(of[many], minlength=len(words))), "moving": moving.tobytes(), "context": _planes(place), "c": _planes(c[many]),
        }
        sums = {"n": c.sum(), "v": len(words), "pair1": (c == 1).sum(), "pair2": (c == 2).sum(), "word1": (cw == 1).sum(), "word2": (cw == 2).sum(), "n_contexts": len(contexts)}
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in held.items()}, **{k: pa.array([int(x)], pa.int64()) for k, x in sums.items()}})

    sent = rows.mapInArrow(run, "bucket int, words binary, pairs binary, context binary, n binary")
    return sent.repartition(shuffle_partitions(rows.sparkSession), "bucket").groupBy("bucket").applyInArrow(merge, COUNTS)


def _to_contexts(rows: DataFrame, context: str, values: list[str], before: int, after: int, reply: bool, parts: int) -> DataFrame:
    """Messages of each bucket of words to each bucket of contexts: contexts with their values, zeros before and after them.

    A column of values holds one or more values of every context, all of the first, then all of the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                told = np.frombuffer(row[context], "<u8")
                own = [_ints(row[v]).reshape(-1, len(told)) for v in values] if len(told) else []
                zeros = lambda k: np.zeros((k, len(told)), np.int64)
                sums = np.concatenate([zeros(before), *own, zeros(after)])
                out = [(k, row["bucket"], reply, told[a:b].tobytes(), _planes(sums[:, a:b])) for k, a, b in bucket_cuts(told, parts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "bucket", "reply", "told", "sums"])

    return rows.select("bucket", context, *values).mapInArrow(run, "part int, bucket int, reply boolean, told binary, sums binary")


def context_totals(messages: DataFrame) -> DataFrame:
    """(bucket, part, sums): for each message that wants a reply the totals of its contexts, in its order."""

    def add(key, table):
        told = [np.frombuffer(x, "<u8") for x in table["told"].to_pylist()]
        sums = np.concatenate([_ints(x).reshape(-1, len(c)) for x, c in zip(table["sums"].to_pylist(), told)], axis=1)
        known, place = np.unique(np.concatenate(told), return_inverse=True)
        total = np.stack([np.bincount(place, x, len(known)) for x in sums])
        cut = np.cumsum([0, *map(len, told)])
        wanted = [i for i, x in enumerate(table["reply"].to_pylist()) if x]
        return pa.table({
            "bucket": pa.array([table["bucket"][i].as_py() for i in wanted], pa.int32()),
            "part": pa.array([key[0].as_py()] * len(wanted), pa.int32()),
            "sums": pa.array([_planes(total[:, place[cut[i] : cut[i + 1]]]) for i in wanted], pa.binary()),
        })

    return messages.repartition(shuffle_partitions(messages.sparkSession), "part").groupBy("part").applyInArrow(add, "bucket int, part int, sums binary")


def _replies(table: pa.Table, values: int) -> np.ndarray:
    """Totals of all contexts of a bucket, a row for each value."""
    rows = sorted(zip(table["part"].to_pylist(), table["sums"].to_pylist()))
    return np.concatenate([np.zeros((values, 0), np.int64), *[_ints(x).reshape(values, -1) for _, x in rows]], axis=1)


def sweep(state: DataFrame, replies: DataFrame, model: Model, tokens_total: float, number: int, keep: bool, seed: int) -> DataFrame:
    """A Gibbs sweep over every bucket; keep adds the seating to the samples.

    state is of COUNTS before the first sweep, and replies are then the words of each moving context; later state is of
    SEATS and replies are the tables beyond one for each pair.
    """

    def run(key, left, right):
        if not left.num_rows:
            return pa.table({})
        row = left.to_pylist()[0]
        words, alone, of, place, c = np.frombuffer(row["words"], "<u8"), *(_ints(row[k]) for k in ("alone", "pairs", "context", "c"))
        of, moving, told = np.repeat(np.arange(len(words)), of), np.frombuffer(row["moving"], "<u8"), _replies(right, 1)[0]
        kinds = told if "t" not in row else _ints(row["kinds"])
        m = model.of_contexts(None, kinds if "t" not in row else kinds + told)
        fresh0 = (STRENGTH + m.d0 * m.t0) * m.base
        with np.errstate(over="ignore"):
            key_of = mix64(words[of] ^ mix64(moving[place] + np.uint64(seed)))
            above = mix64(words + np.uint64(seed))
        if "t" in row:
            pairs, root = Seats(key_of, _ints(row["t"]), _ints(row["sizes"])), Seats(above, _ints(row["t0"]), _ints(row["sizes0"]))
        else:
            share = (alone + np.bincount(of, c, len(words))) / max(tokens_total, 1)
            pairs = Seats.dealt(key_of, c, expected_tables(c, m.fresh(place, share[of])))
            c0 = alone + np.bincount(of, pairs.tables(), len(words)).astype(np.int64)
            root = Seats.dealt(above, c0, expected_tables(c0, np.full(len(c0), fresh0)))
        gibbs(pairs, of, root, m.d1, m.d0, STRENGTH + m.d1 * m.t[place], fresh0, m.word, number)
        t, t0 = pairs.tables(), root.tables()
        more = _planes(np.bincount(place, t - 1, len(moving)))
        row |= {"kinds": _planes(kinds), "t": _planes(t), "sizes": _planes(pairs.size), "t0": _planes(t0), "sizes0": _planes(root.size), "more": more}
        row |= {"n_tables": int(t.sum() + alone.sum()), "n_tables0": int(t0.sum())}
        for name, one in (("samples", t), ("samples0", t0), ("extra", _ints(more))):
            row[name] = _planes(np.concatenate([_ints(row.get(name) or b""), one])) if keep else b""
        return pa.Table.from_pylist([row], schema=SCHEMA)

    return state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(run, SEATS)


SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}[x.split()[1]]) for x in SEATS.split(", ")])
SUMS = "row bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
#: What a bucket returns for a chunk of texts: sums for each text of the chunk that has a word there.
PACKED = "chunk bigint, doc binary, unknown binary, base binary, score binary, row binary, ids binary, held binary, n binary"
_OWN = ("row", "ids", "held", "n")


def score_rows(rows: DataFrame, known: DataFrame, samples: list[Model], n: float, vocabulary: int, buckets: int) -> DataFrame:
    """Sums for each row of (row, id, held_out, text).

    Texts go to the buckets in chunks, and the sums of a chunk come back packed, so what travels is counted in chunks, not
    in pairs of text and bucket. A bucket counts the pairs of its texts again; known (bucket, part, sums, samples, samples0)
    has the tables of those with two customers or more, of its words, and the totals of its contexts, all in the order of
    the hashes. Ids of a chunk wait in a bucket of their own (negative) that has no model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                word, context, doc = tokens(part.column("text").cast(pa.binary()).to_pylist())
                row, ids = part.column("row").to_numpy(), part.column("id")
                null = np.array(ids.is_null())
                ids, held = np.where(null, 0, ids.fill_null(0).to_numpy()), np.array(part.column("held_out").to_pylist(), dtype=np.uint8)
                chunk, size = int(row[0]), np.bincount(doc, minlength=len(row))
                out = [(-1 - int(mix64(row[:1].astype(np.uint64))[0] % np.uint64(buckets)), chunk, None, None, None, None, None, row.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), (held + 2 * null).astype("u1").tobytes(), _planes(size))]
                marked = (2 * doc + held[doc]).astype("<u2")
                for k, a, b in bucket_cuts(word, buckets):
                    at = _runs(word[a:b], context[a:b])
                    first = _runs(word[a:b][at])
                    out.append((k, chunk, word[a:b][at][first].tobytes(), np.diff(first, append=len(at)).astype("<u4").tobytes(), _contexts(context[a:b][at]), _planes(np.diff(at, append=b - a)), marked[a:b].tobytes(), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 9))], names=["bucket", "chunk", "words", "pairs", "context", "times", "doc", *_OWN])

    def score(key, left, right):
        sums = ("doc", "unknown", "base", "score")
        if not left.num_rows or key[0].as_py() < 0:
            none = pa.nulls(left.num_rows, pa.binary())
            return pa.table({"chunk": left["chunk"], **dict.fromkeys(sums, none), **{k: left[k] for k in _OWN}}) if left.num_rows else pa.table({})
        joint = lambda name, kind: joined(left[name].to_pylist(), kind)
        times = np.concatenate([_ints(x) for x in left["times"].to_pylist()])
        marked = joint("doc", "<u2")
        trains = np.add.reduceat((marked & 1 == 0).astype(np.int64), np.cumsum(times) - times)
        words, contexts, of, place, pair = _pairs(joint("words", "<u8"), joint("pairs", "<u4"), _of_contexts(left["context"].to_pylist()))
        c = np.bincount(pair, trains, len(of)).astype(np.int64)
        cw = np.bincount(of, c, len(words))
        seats = right.filter(pc.is_valid(right["samples"])).to_pylist()[0]
        customers, kinds, *extra = _replies(right.filter(pc.is_valid(right["sums"])), 2 + len(samples))
        if len(customers) != len(contexts):
            raise ValueError(f"{len(customers)} totals for {len(contexts)} contexts")
        p = np.zeros(len(c))
        for m, seated, seated0, x in zip(samples, _ints(seats["samples"]).reshape(len(samples), -1), _ints(seats["samples0"]).reshape(len(samples), -1), extra):
            t, t0 = np.minimum(c, 1), np.zeros(len(cw), np.int64)
            t[c > 1], t0[cw > 0] = seated, seated0
            parent = m.word(np.bincount(of, t, len(cw)), t0)
            p += m.of_contexts(customers, kinds + x).pair(place, c, t, parent[of]) / len(samples)
        logs, base, unknown = (np.repeat(x[pair], times) for x in (np.log10(p), np.log10((cw + 1) / (n + vocabulary + 1))[of], (cw == 0)[of]))
        out, a = [], 0
        for chunk, doc in zip(left["chunk"].to_pylist(), left["doc"].to_pylist()):
            doc = (np.frombuffer(doc, "<u2") >> 1).astype(np.int64)
            b = a + len(doc)
            docs = np.flatnonzero(np.bincount(doc))
            told = [np.bincount(doc, x[a:b])[docs] for x in (unknown, base, logs)]
            out.append((chunk, docs.astype("<u2").tobytes(), _planes(told[0]), told[1].tobytes(), told[2].tobytes()))
            a = b
        none = pa.nulls(len(out), pa.binary())
        return pa.table({k: pa.array(x, t) for k, x, t in zip(("chunk", *sums), zip(*out), (pa.int64(), *[pa.binary()] * 4))} | dict.fromkeys(_OWN, none))

    def total(key, table):
        rows = table.to_pylist()
        head = next(x for x in rows if x["row"] is not None)
        row, ids, held = np.frombuffer(head["row"], "<i8"), np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["held"], "u1")
        parts = [x for x in rows if x["doc"] is not None]
        doc, unknown = joined([x["doc"] for x in parts], "<u2"), np.concatenate([_ints(x["unknown"]) for x in parts])
        unknown, base, score = (np.bincount(doc, x, len(row)) for x in (unknown, *(joined([x[k] for x in parts], "<f8") for k in ("base", "score"))))
        n_tokens = _ints(head["n"])
        return pa.table({"row": row, "id": pa.array(ids, mask=held > 1), "held_out": pa.array((held & 1) > 0), "n_tokens": n_tokens, "n_known": n_tokens - unknown.astype(np.int64), "base_score": base, "score": score})

    partitions = shuffle_partitions(rows.sparkSession)
    sent = rows.mapInArrow(run, f"bucket int, chunk bigint, words binary, pairs binary, context binary, times binary, doc binary, {', '.join(f'{x} binary' for x in _OWN)}")
    back = sent.repartition(partitions, "bucket").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(score, PACKED)
    return back.repartition(partitions, "chunk").groupBy("chunk").applyInArrow(total, SUMS)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sweeps: int = 5, burn_in: int = 2, seed: int = 7) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row for each row of docs."""
    spark = docs.sparkSession
    buckets = 2 * shuffle_partitions(spark)  # a bucket's state is one row
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("id")))
    counts = written(count_words(rows.select("held_out", "text"), buckets), "lm-counts")
    names = ("n_contexts", "n", "v", "pair1", "pair2", "word1", "word2")
    n_contexts, n, vocabulary, *seen = (x or 0 for x in counts.agg(*[F.sum(x) for x in names]).first())
    d1, d0 = _discount(*seen[:2]), _discount(*seen[2:])
    parts = 1 + min(n_contexts // PART, buckets)
    model = Model({-1: (n, vocabulary)}, vocabulary, d1, d0)
    totals = counts.select("bucket", "contexts", "customers", "kinds")
    asked = counts.select("bucket", "moving")
    state = counts.select("bucket", "words", "alone", "pairs", "moving", "context", "c")
    messages = _to_contexts(totals, "contexts", ["kinds"], 0, 0, False, parts).unionByName(_to_contexts(asked, "moving", [], 0, 1, True, parts))
    samples = []
    for i in range(sweeps):
        before, state = state, written(sweep(state, context_totals(messages), model, n, i, i >= burn_in, seed), "lm-seats")
        if i:
            discard(before)
        model = Model({-1: tuple(x or 0 for x in state.agg(F.sum("n_tables"), F.sum("n_tables0")).first())}, vocabulary, d1, d0)
        samples += [model] if i >= burn_in else []
        messages = _to_contexts(state, "moving", ["more"], 0, 0, True, parts)
        release(spark)
    k = len(samples)
    messages = _to_contexts(totals, "contexts", ["customers", "kinds"], 0, k, True, parts).unionByName(_to_contexts(state, "moving", ["extra"], 2, 0, False, parts))
    known = context_totals(messages).unionByName(state.select("bucket", "samples", "samples0"), allowMissingColumns=True)
    known = written(known, "lm-known")
    discard(counts)
    discard(state)
    release(spark)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    sums = score_rows(numbered, known, samples, n, vocabulary, buckets)
    return sums.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

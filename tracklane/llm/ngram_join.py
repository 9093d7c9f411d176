"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

Texts are sets of word n-grams, told apart by 64-bit hashes. Two sets of a Jaccard similarity of t percent share at least
ceil(t % of the larger) tokens, so under any order of all tokens they share k of their first n - ceil(t % of n) + k. Three
orders are used: by hash, by hash backwards, and rarest first by an upper bound of how many sets hold a token: the least of
the counts of its words and of its own hash in tables of SLOTS counters (a fixed size, whatever the corpus).

1. Sets: texts with the same set are one node (128-bit digest of the sorted hashes); prefixes are written, whole sets not.
2. Rarest-first prefix tokens that two nodes hold are keys. A node of fewer than k keys has no partner; of the others the
   rarest, all but k - 1, are enough, as the keys that a pair shares can't all be among the k - 1 others.
3. Members of a key are parted by bands of size, so that every pair that sizes allow meets in a band. Nodes are compared by
   connected component of what shares a key, where a node is sent once for each block, or by keys where that sends fewer
   tokens. Groups of many members are cut into blocks, and pairs of blocks are cells: a cell holds a bounded number of
   members and tokens, and a hot key becomes many tasks. In a cell pairs pass if they share enough prefix tokens in all
   three orders; what leaves it is a spanning forest of these pairs, not the pairs.
4. Only for the nodes in it the texts are read again for their whole sets, and these are compared likewise, by component or
   by group of the pairs that passed. A cell counts all overlaps exactly and sends the links of a spanning forest.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing, not even each other; texts of
fewer words than an n-gram have one token, the whole sequence; repeated rows and rows of one set are in one component; null
ids have no id of their own (the component is the smallest id that isn't null, null if there is none) but link what they
stand between; very long texts are processed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import Batch, connected_components, release, shuffle_partitions, window_hashes, written

#: Counters of the words' and of the tokens' table. Two tables of 64-bit counters are 4 MB.
SLOTS = 1 << 18
#: Counters that one row holds while tables are summed.
SLICE = 1 << 14
#: Members and tokens of a block; a cell is a pair of blocks.
BLOCK_ROWS, BLOCK_TOKENS = 512, 1 << 21
#: Characters of the texts that are hashed at once; a longer text is hashed by itself.
CHUNK = 1 << 21
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 2048
#: Shares of the tokens, in percent, that prefixes of the three orders must share.
DEEPER = (5, 2, 2)
LOWEST = -(1 << 63)


def least_overlap(n, percent: int):
    """Tokens that a set of n shares with any partner."""
    return -(-percent * n // 100)


def token_sets(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its n-grams, and a matrix of the hashes of each one's words."""
    edge = np.flatnonzero(np.diff(np.cumsum([0, *(len(x or "") for x in texts)]) // CHUNK)).tolist()
    for lo, hi in zip([0, *(e + 1 for e in edge)], [*(e + 1 for e in edge), len(texts)]):
        b = Batch(texts[lo:hi], lower=True)
        words = b.word_hashes()
        for i, n in enumerate(b.n_words.tolist()):
            w = words[b.first[i] : b.first[i + 1]]
            k = min(width, n)
            if not n:
                yield np.zeros(0, np.uint64), np.zeros((0, 1), np.uint64)
                continue
            h, at = np.unique(window_hashes(w, k, salt=k if k < width else 0), return_index=True)
            yield h, np.lib.stride_tricks.sliding_window_view(w, k)[at]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def counters(texts: DataFrame, width: int) -> np.ndarray:
    """Two tables of SLOTS counters: words of all sets' texts, tokens of all sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, SLOTS), dtype=np.int64)
        for b in batches:
            for h, w in token_sets(b.column(0).to_pylist(), width):
                np.add.at(table[0], _slots(w.ravel()), 1)
                np.add.at(table[1], _slots(h), 1)
        cut = table.reshape(-1, SLICE)
        some = np.flatnonzero(cut.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cut[i].tobytes() for i in some], pa.binary())], names=["slice", "counts"])

    def add(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in slices:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                held[i] = held.get(i, 0) + np.frombuffer(x.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slice", "counts"])

    kind = "slice int, counts binary"
    sums = texts.mapInArrow(count, kind).repartition(min(shuffle_partitions(texts.sparkSession), 2 * SLOTS // SLICE), "slice").mapInArrow(add, kind)
    table = np.zeros((2 * SLOTS // SLICE, SLICE), dtype=np.int64)
    for r in sums.collect():  # 4 MB
        table[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return table.reshape(2, SLOTS)


def prefixes(h: np.ndarray, w: np.ndarray, counts: np.ndarray, percent: int) -> list[np.ndarray]:
    """Prefixes of a set (sorted) under the three orders."""
    n = len(h)
    spare = n - least_overlap(n, percent)
    bound = np.minimum(counts[0][_slots(w)].min(axis=1), counts[1][_slots(h)])
    rare, low, high = (spare + asked(n, i) for i in range(3))
    return [h[np.lexsort((h, bound))[:rare]], h[:low], h[max(0, n - high) :]]


def asked(n, order: int):
    """Tokens that prefixes of an order must share."""
    return n * DEEPER[order] // 100 + 1


def described(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, th, digest, n, rare, low, high) of each row of docs (id, th, text)."""
    given = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, n, parts = [], [], [[], [], []]
            for h, w in token_sets(b.column(2).to_pylist(), width):
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                n.append(len(h))
                for to, p in zip(parts, prefixes(h, w, given.value, percent) if len(h) else [h] * 3):
                    to.append(p.view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]), pa.int32()), pa.array(np.concatenate([*p, np.zeros(0, np.int64)]))) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), *lists], names=["id", "th", "digest", "n", "rare", "low", "high"])

    return docs.mapInArrow(run, "id bigint, th bigint, digest binary, n bigint, rare array<bigint>, low array<bigint>, high array<bigint>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [h.view(np.int64) for h, _ in token_sets(b.column(1).to_pylist(), width)]
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), tokens], names=["node", "tokens"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, tokens array<bigint>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many values each two sets (distinct values each) share."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    if m == 2:
        both = size.sum() - len(np.unique(np.concatenate(sets)))
        return np.array([[size[0], both], [both, size[1]]])
    row = np.repeat(np.arange(m), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((m, m), dtype=np.int64)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        part = np.zeros((m, COLUMNS), dtype=np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        total += (part @ part.T).astype(np.int64)  # whole numbers up to COLUMNS, exact in 32 bits
    total[np.arange(m), np.arange(m)] = size
    return total


def passing(n: np.ndarray, parts: list[list[np.ndarray]], percent: int) -> np.ndarray:
    """Matrix of the pairs that sizes and the prefixes of all orders allow."""
    need = least_overlap(n, percent)
    ok = np.minimum.outer(n, n) >= np.maximum.outer(need, need)
    for order, sets in enumerate(parts):
        if not np.triu(ok, 1).any():
            break
        ok &= overlaps(sets) >= np.minimum.outer(asked(n, order), asked(n, order))
    np.fill_diagonal(ok, False)
    return ok


def spanning(ok: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix a neighbour on the way to its component's first row; itself for that one, -1 without neighbours."""
    up = np.full(len(ok), -1)
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        if up[i] < 0:
            up[i], todo = i, [i]
            while todo:
                j = todo.pop()
                new = np.flatnonzero(ok[j] & (up < 0))
                up[new] = j
                todo += new.tolist()
    return up


def live_keys(prefix: DataFrame) -> DataFrame:
    """(key, node, n) of prefixes (node, n, rare): the keys under which every pair that shares enough of them meets."""
    rows = prefix.select("node", "n", F.explode("rare").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    of_node = rows.join(held, "key").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "key"))).alias("ks"))  # a part of the node's own tokens
    spare = F.size("ks") - F.floor(F.col("n") * DEEPER[0] / 100).cast("int")
    return of_node.filter(spare > 0).select("node", "n", F.explode(F.slice("ks", F.lit(1), spare)).alias("k")).select("k.key", "node", "n")


def banded(keys: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, other) of keys (key, node, n) parted by size, each with the band's first member: one is at home in the band of its size and visits the next one, as a
    partner's size is at most 100 / percent times its own. A band that nobody is at home in has only pairs that meet elsewhere.
    """
    band = F.floor(F.ln(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9)))
    both = F.inline(F.array(F.struct(band.alias("band"), F.lit(1).alias("home")), F.struct((band + 1).alias("band"), F.lit(0).alias("home"))))
    rows = keys.select("key", "node", "n", both).select(F.xxhash64("key", "band").alias("key"), "node", "n", "home")
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("h"), F.min("node").alias("other")).filter("c > 1 and h = 1")
    return rows.join(groups.select("key", "other"), "key").select("key", "node", "n", "other")


def n_blocks(members, tokens):
    return F.greatest(F.ceil(members / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def cells(keys: DataFrame) -> DataFrame:
    """(cell, key, node) of keys (key, node, n): every two members of a key are in one cell, at least."""
    who = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in range(2)]
    groups = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), *who).filter("members > 1")
    groups = groups.groupBy("members", "tokens", "m0", "m1").agg(F.min("key").alias("key")).select("key", n_blocks(F.col("members"), F.col("tokens")).alias("blocks"))
    dealt = keys.join(groups, "key").withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    # the cells of block b: pairs (b, other), smaller first
    dealt = dealt.select("key", "node", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "key", "node")


def _by_cell(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(table of one cell) for all cells; rows are (cell, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, names = None, None
        for b in batches:
            if not b.num_rows:
                continue
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            cell = rest["cell"].to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if last:
                yield from cut(rest.slice(0, last), cell[:last])
                rest = rest.slice(last)
        if rest is not None:
            yield from cut(rest, rest["cell"].to_numpy())

    def cut(table: pa.Table, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = [*np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist(), len(cell)]
        out = [each(table.slice(a, b - a)) for a, b in zip(edge, edge[1:]) if b - a > 1]
        if out:
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in table[name]]


def _distinct_members(table: pa.Table) -> pa.Table:
    """Two cells of one hash are one cell; a node that is in both is there once."""
    node = table["node"].to_numpy()
    _, first = np.unique(node, return_index=True)
    return table if len(first) == len(node) else table.take(pa.array(np.sort(first)))


def candidates(nodes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, other): members of groups that have partners which pass the filters of all orders, with one on the way
    to the first of them (itself for that one), so that these links hold all connections between candidates.
    """

    def each(t: pa.Table):
        t = _distinct_members(t)
        n, node = t["n"].to_numpy(), t["node"].to_numpy()
        up = spanning(passing(n, [_lists(t, c) for c in ("rare", "low", "high")], percent))
        some = up >= 0
        return t["key"].to_numpy()[some], node[some], n[some], node[up[some]]

    rows = cells(groups).join(nodes, "node").select("cell", "key", "node", "n", "rare", "low", "high")
    return _by_cell(rows, each, "key bigint, node bigint, n bigint, other bigint")


def groups_to_compare(near: DataFrame) -> DataFrame:
    """(key, node, n): the components of links (key, node, n, other), or their keys where these send fewer tokens to cells."""
    part = written(connected_components(near, "node", "other").select("node", "component"), "ngram-parts")
    by_key = near.select("key", "node", "n").distinct().join(part, "node").select(F.xxhash64("key", "component").alias("key"), "node", "n", "component")
    by_part = near.select("node", "n").distinct().join(part, "node").select("component", "node", "n")
    sent = F.sum("n") * n_blocks(F.count("*"), F.sum("n"))
    cost = by_key.groupBy("component", "key").agg(sent.alias("s")).groupBy("component").agg(F.sum("s").alias("keys"))
    cost = cost.join(by_part.groupBy("component").agg(sent.alias("part")), "component").select("component", (F.col("keys") < F.col("part")).alias("split"))
    whole = by_part.join(cost.filter("not split"), "component").select(F.col("component").alias("key"), "node", "n")
    return whole.unionByName(by_key.join(cost.filter("split"), "component").select("key", "node", "n"))


def links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links that hold all connections between the nodes of each group."""

    def each(t: pa.Table):
        t = _distinct_members(t)
        n, node = t["n"].to_numpy(), t["node"].to_numpy()
        both = overlaps(_lists(t, "tokens"))
        ok = 100 * both >= percent * (np.add.outer(n, n) - both)
        np.fill_diagonal(ok, False)
        up = spanning(ok)
        some = up >= 0
        return node[some], node[up[some]]

    rows = cells(groups).join(sets.withColumn("n", F.size("tokens").cast("bigint")), "node").select("cell", "node", "n", "tokens")
    return _by_cell(rows, each, "a bigint, b bigint")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set, the smallest id reachable over links of a Jaccard
    similarity of `percent` or more."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("th"), "text")
    rows = described(docs, counters(docs.select("text"), width), width, percent)
    # whole tables are joined by merging at every size: the sides to broadcast would grow with the documents
    rows = written(rows.withColumn("node", F.monotonically_increasing_id()), "ngram-rows")
    # one row of each set, that of the smallest id, is its node
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    heads = written(rows.filter("n > 0").groupBy("digest").agg(first.alias("f")).select("digest", "f.id", "f.node"), "ngram-nodes")
    keys = written(live_keys(rows.select("node", "n", "rare").join(heads.select("node").hint("merge"), "node", "left_semi")), "ngram-keys")
    groups = written(groups_to_compare(written(banded(keys, percent), "ngram-bands")), "ngram-groups")
    release(docs.sparkSession)
    keyed = rows.select("node", "n", "rare", "low", "high").join(groups.select("node").distinct().hint("merge"), "node", "left_semi")
    near = written(candidates(keyed, groups, percent), "ngram-candidates")
    release(docs.sparkSession)
    compared = written(groups_to_compare(near), "ngram-compared")
    wanted = rows.select("node", "id", "th").join(near.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.coalesce("id", F.lit(LOWEST)).alias("key"), "th")
    texts = docs.select(F.coalesce("id", F.lit(LOWEST)).alias("key"), "th", "text").join(wanted.hint("merge"), ["key", "th"])
    sets = written(whole_sets(texts.dropDuplicates(["key", "th", "node"]), width), "ngram-sets")  # repeated rows
    release(docs.sparkSession)
    groups = written(connected_components(links(sets, compared, percent)), "ngram-components")
    lowest = groups.join(heads, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    of_set = heads.join(groups, "node", "left").join(lowest, "component", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    linked = rows.filter("n > 0").join(of_set, "digest").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")

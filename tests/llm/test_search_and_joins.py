"""Ranked search, spelling variants and the n-gram join against brute force; their defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracklane.llm import lexical_search, ngram_join, spelling_variants


def ranked(docs, items, k=10):
    fold = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(fold(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(fold(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def words(rng, n, kinds):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), kinds)}" for _ in range(n))


@pytest.mark.parametrize("shard", [7, 8192])
def test_search_equals_scoring_everything(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical_search, "SHARD_ROWS", shard)
    rng = random.Random(shard)
    docs = [(i, words(rng, rng.randint(1, 60), 40)) for i in range(150)]
    docs += [(900, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (901, None), (902, ""), (903, "?! --"), (904, "Ünïcode ÜNÏCODE w1 " * 30), (905, "w2 " * 20_000)]
    items = [("a", "w1 w2 W3"), ("b", "w5 w5 w9 w40"), ("c", None), ("d", "nowhere"), (None, "w7 Ünïcode"), ("a", "w1 w2 W3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "text AS id", "1 AS q")
    asked = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((tuple(r) for r in lexical_search.ranked_search(df.repartition(3), asked).collect()), key=repr)
    assert got == ranked(docs, items)
    assert sorted((tuple(r) for r in lexical_search.ranked_search(df, asked, query_bytes=8).collect()), key=repr) == got  # in blocks of items
    assert lexical_search.ranked_search(df.filter("false"), asked).count() == 0
    assert lexical_search.ranked_search(df, asked.filter("false")).count() == 0


def test_nra_stops_before_the_ends_of_lists():
    rng = np.random.default_rng(5)
    lists, full = [], np.zeros(5000, dtype=np.int64)
    for j in range(4):
        docs = np.concatenate([np.arange(10), 10 + rng.permutation(4990)])  # the best ten lead every list
        impact = np.concatenate([np.arange(1000 - j, 990 - j, -1) * 1000, np.sort(rng.integers(1, 500, 4990))[::-1]]).astype(np.int64)
        lists.append((docs, impact))
        full[docs] += impact
    docs, scores, read = lexical_search.nra(lists, 5000, 10)
    assert docs.tolist() == list(range(10)) and (scores == full[docs]).all() and read < 1000


def near_by_force(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 5 * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def test_spelling_variants_equal_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(60)]
    texts = []
    for w in base:
        n = rng.choice([5, 6, 30, 31, 160, 800])
        texts += [w] * n
        for _ in range(3):
            i = rng.randrange(len(w))
            texts += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])] * rng.choice([4, 5, 5, 7, 30])
    rng.shuffle(texts)
    rows = [(i if i % 9 else None, " ".join(x.upper() if j % 3 == 0 and "é" not in x else x for j, x in enumerate(texts[i * 50 : i * 50 + 50]))) for i in range(len(texts) // 50 + 1)]
    rows += [(7, None), (8, ""), (9, "12 ?"), (10, "short ab"), rows[1], (11, "zzzzzzz" * 5000)]
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 19 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    want = near_by_force({w: n for w, n in counts.items() if n >= 5 and len(w) >= 6})
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS word", "2 AS n")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(df, drop_every=19).collect()}
    assert got == want and any(v[0] and want[v[0]][0] for v in want.values())  # some form has a form itself
    assert spelling_variants.spelling_variants(df.filter("false")).count() == 0


def test_spelling_variants_broadcast_nothing(spark, monkeypatch):
    plans = []
    write = spelling_variants.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling_variants, "written", written)
    df = spark.createDataFrame([(i, "grammar grammar grammer spelling speling") for i in range(30)], "doc_id long, text string")
    out = spelling_variants.spelling_variants(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def joined_by_force(rows, width=3, percent=90):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)].append(d)
    return sorted(((d, len(sets[i]), (min(low[top(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, families, copies, length, edits):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"v{rng.randrange(300)}" for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block, split", [(512, False), (8, False), (8, True)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, block, split):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    if split:  # by keys and not by component
        monkeypatch.setattr(ngram_join, "groups_to_compare", lambda near: near.select("key", "node", "n").distinct())
    rows = near_copies(block, 3, 40, 90, 6) + near_copies(block + 1, 12, 4, 14, 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    a = " ".join(f"k{i}" for i in range(70))
    chain = [(1001, a), (None, a.replace("k5 ", "y ")), (1000, a.replace("k5 ", "y ").replace("k60 ", "z "))]
    rows += chain + [(2000, None), (2001, ""), (2002, " \n "), (2003, None), (2004, "One two"), (2005, "one TWO"), (2006, "two"), (7, rows[7][1]), (5, rows[90][1]), (None, "alone by itself here")]
    rows += [(3000, " ".join(f"l{i}" for i in range(30_000))), (3001, " ".join(f"l{i}" for i in range(30_300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "2 AS key", "3 AS n")
    got = sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=repr)
    assert got == joined_by_force(rows)
    if block == 512:
        assert ngram_join.ngram_join(df.filter("false")).count() == 0


def test_overlaps_in_chunks_of_columns(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 25)) for _ in range(9)]
    got = ngram_join.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9))

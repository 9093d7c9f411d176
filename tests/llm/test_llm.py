"""Operators against brute force on small tables with nulls, empty and long texts, copies and empty inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from tracklane.llm import anchor_dedup, bpe, chat_format, common, decontaminate, exchange, html_crf, line_dedup, near_dedup, pitman_yor, quality_rules, simhash_dedup, suffix_dedup

R = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def words(n):
    return [R.choice(VOCAB) for _ in range(n)]


def corpus():
    """Texts with passages in common, copies, near copies, a null, empties, blanks and a long repetitive one."""
    passage, line = " ".join(words(90)), " ".join(words(60))
    out = [None, "", " \n\t ", "one", "a b c"]
    for i in range(40):
        parts = [" ".join(words(R.randint(5, 120)))]
        if i % 3 == 0:
            parts.append(passage)
        if i % 4 == 0:
            parts.append(line + "\n" + line)
        parts.append(" ".join(words(R.randint(5, 60))))
        out.append("\n".join(parts))
    out += [out[6]] * 3 + [out[7] + " tail", "x " * 900, "Zé ñ — 語 " * 120]
    return out


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 37, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string").repartition(3)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_substring_dedup(docs):
    got = by_id(anchor_dedup.substring_dedup(docs, per_block=200))
    seen = set()
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        r = got[i * 37]
        assert (r.n_words, r.n_removed, r.kept.encode()) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))


def test_windows_come_from_repeated_anchors_only():
    """Without a repeated anchor no window is looked at; with them all, every repeated window of a block is found."""
    none = anchor_dedup.Candidates(TEXTS, np.zeros(0, np.uint64))
    assert not len(none.start)
    words = anchor_dedup.Batch(TEXTS)
    h, n = np.unique(anchor_dedup._anchors(words, words.word_hashes())[1], return_counts=True)
    some = anchor_dedup.Candidates(TEXTS, h[n > 1])
    seen, later = set(), []
    for i in range(len(words.n_words)):
        for k in range(words.first[i], words.first[i + 1] - 19):
            key = tuple(words.data[a:b] for a, b in zip(words.start[k : k + 20], words.end[k : k + 20]))
            later += [k] if key in seen else []
            seen.add(key)
    assert some.start[~some.first].tolist() == later and len(some.start) < words.n_words.sum()


def test_windows_are_filed_once_in_pieces_of_any_size(monkeypatch):
    texts = [*TEXTS, "ab" * 3000]
    whole = suffix_dedup.Places(texts)
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    for p in (whole, suffix_dedup.Places(texts)):
        start = np.concatenate([np.arange(a, b + 1) for a, b in zip(p.low, p.high)])
        want = np.concatenate([np.arange(a, b - 399) for a, b in zip(p.base, p.base[1:]) if b - a >= 400])
        assert (start == want).all() and (p.x >= p.high).all() and (p.x < p.low + 100).all()


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.suffix_dedup(docs, per_block=200))
    raw = [(t or "").encode() for t in TEXTS]
    count = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        r = got[i * 37]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g))
        assert r.n_spans == int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())


def test_deep_shallow_groups():
    data = b"".join(R.choice([b"ab" * 40, b"ab" * 39 + b"ac", b"xyz" * 20]) for _ in range(60))
    start = np.arange(len(data) - 100)
    want = {}
    for s in start:
        want.setdefault(data[s : s + 100], []).append(s)
    got = suffix_dedup.deep_shallow(data, start, limit=100, shallow=16)
    assert sorted(sorted(map(int, g)) for g in got) == sorted(sorted(map(int, v)) for v in want.values() if len(v) > 1)
    keys = [data[g[0] : g[0] + 100] for g in got]
    assert keys == sorted(keys)


def test_simhash(docs, spark):
    def slow(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))

    fp = [slow(t) for t in TEXTS]
    comp = list(range(len(fp)))
    for a, b in combinations(range(len(fp)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    got = by_id(simhash_dedup.simhash_components(docs).select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fp"), "component_id"))
    assert {k: (r.fp, r.component_id) for k, r in got.items()} == {i * 37: (f"{fp[i]:016x}", comp[i] * 37) for i in range(len(fp))}
    kept = simhash_dedup.simhash_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c * 37 for c in comp})
    assert simhash_dedup.simhash_dedup(docs.limit(0)).count() == 0


def test_dedup_of_null_ids_and_repeated_rows(spark):
    a, b, c = (" ".join(words(50)) for _ in range(3))
    d = spark.createDataFrame([(None, a), (3, b), (3, b), (2, c), (4, b), (3, c), (None, b)], "doc_id long, text string").repartition(2)
    for dedup in (simhash_dedup.simhash_dedup, near_dedup.near_dedup):
        assert sorted((str(x.doc_id), x.text) for x in dedup(d).collect()) == sorted([("None", a), ("3", b), ("2", c)])


def test_near_dedup_against_all_pairs(spark):
    """Near copies of all sizes with 0 to 25 % of words changed around 0.8, passages in common, copies and blanks."""
    import corpus_pipeline

    r = random.Random(11)
    texts, passage = [None, "", " ", "a b", "A b", "a b c"], [r.choice(VOCAB) for _ in range(60)]
    for n in (12, 30, 80, 300, 900):
        for i in range(10):
            w = [f"{r.choice(VOCAB)}{r.randint(0, 30)}" for _ in range(n)] + passage * (i % 3 == 0)
            texts.append(" ".join(w))
            for share in (0.01, 0.02, 0.03):
                texts.append(" ".join(f"new{r.random()}" if r.random() < share else x for x in w))

    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    bags, comp, close = [bag(t) for t in texts], list(range(len(texts))), 0
    for a, b in combinations(range(len(texts)), 2):
        s = sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())
        if s >= 0.8:
            close += s < 0.9
            x, y = sorted((comp[a], comp[b]))
            comp = [x if c == y else c for c in comp]
    assert close > 30
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, d, "")
    assert got.columns == d.columns and sorted(x.doc_id for x in got.collect()) == sorted(set(comp))
    assert near_dedup.near_dedup(d.limit(0)).count() == 0


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Pairs without a sampled shingle in common are found by the blocks of their SimHashes."""
    monkeypatch.setattr(near_dedup, "SAMPLE", 1)
    monkeypatch.setattr(near_dedup, "PREFIX", 1)
    r, pairs = random.Random(8), []
    while len(pairs) < 5:
        w = [f"{r.choice(VOCAB)}{r.randint(0, 30)}" for _ in range(300)]
        for at in range(300):
            both = [" ".join(w), " ".join([*w[:at], "other", *w[at + 1 :]])]
            a, b = near_dedup.elements(both)
            if a[0] != b[0] and (near_dedup.simhash(a) ^ near_dedup.simhash(b)).bit_count() <= 4:
                pairs.append(both)
                break
    d = spark.createDataFrame([(i, t) for i, t in enumerate(t for both in pairs for t in both)], "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in near_dedup.near_dedup(d).collect()) == [0, 2, 4, 6, 8]


def test_spanning_links_hold_every_connection():
    rng = np.random.default_rng(1)
    fp = np.concatenate([np.array([1 << int(b) for b in rng.integers(0, 64, 60)], np.uint64) ^ np.uint64(base) for base in (0, 2**40 + 999)])
    a, b = simhash_dedup.spanning_links(np.zeros(len(fp), np.int64), fp, 4)
    label = list(range(len(fp)))
    for x, y in zip(a, b):
        assert (int(fp[x]) ^ int(fp[y])).bit_count() <= 4
        u, v = label[x], label[y]
        label = [u if c == v else c for c in label]
    assert len(set(label)) == 2 and len(a) < 200


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}


def test_line_dedup(spark):
    block = "\n".join(f"line {i} {' '.join(words(5))}" for i in range(30))
    rows = [(1, "head\n" + block), (2, "other\nstart\n" + block + "\nend"), (3, None), (4, ""), (5, "single"), (5, "single")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(d).filter("text is not null").collect())
    assert got[0] == (1, rows[0][1])
    assert [x for x in got if x[0] > 2] == [(4, ""), (5, "single"), (5, "single")]
    left = got[1][1].split("\n")
    assert len(left) < 15 and left[0] == "other" and left[-1] == "end"
    assert line_dedup.line_dedup(d.limit(0)).count() == 0 and line_dedup.line_dedup(d).filter("text is null").count() == 1


def test_repeated_rows_and_tiny_runs(spark):
    long = "\n".join(f"a line of its own number {i}" for i in range(8))
    rows = [(1, long), (1, long), (1, "short"), (1, "short"), (None, long), (2, "c\n\n\nd"), (3, "e\n\n\nf"), (4, "x\n}\n}\ny"), (5, "z\n}\n}\nw"), (6, "p\none line of some size\n\nq"), (7, "r\none line of some size\n\ns")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", long), ("1", ""), ("1", "short"), ("1", "short"), ("None", "")] + [(str(i), t) for i, t in rows[5:10]] + [("7", "r\ns")])
    all_ = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=0).collect())
    assert ("3", "e\nf") in all_ and ("5", "z\nw") in all_


def test_window_moves_chunk_ends_and_copies_are_cut_alike(spark):
    passage = [f"passage {i}" for i in range(60)]
    texts = ["\n".join([f"own {k} {i}" for i in range(3 + 4 * k)] + passage) for k in range(2)]
    d = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    cut = lambda w: {(r.row, r.start, r.n, r.h) for r in line_dedup.chunk_rows(d, "text", 4, w).filter("n > 2").collect()}
    ends = {w: {(r, s + n) for r, s, n, _ in cut(w)} for w in (1, 2, 5)}
    assert ends[1] != ends[2] != ends[5] != ends[1]
    hashes = [{h for r, _, _, h in cut(2) if r == k} for k in range(2)]
    assert len(hashes[0] & hashes[1]) >= 5  # in spite of another number of lines before


def test_line_dedup_against_all_runs(spark):
    """Planted passages of 2 to 8 lines, whole and in part, between lines of their own; every repeated run goes."""
    r = random.Random(3)
    passages = [[f"p{k} line {i} {r.random()}" for i in range(2 + k % 7)] for k in range(28)]
    texts = []
    for i in range(90):
        own = lambda: [f"own {i} {r.random()}" for _ in range(r.randint(0, 3))]  # noqa: B023, E731
        p, q = r.choice(passages), r.choice(passages)
        cut = r.randint(0, len(q) - 1)
        texts.append("\n".join([*own(), *p, *own(), *q[cut:], *own(), r.choice(["", "menu"]), *own()]))
    texts += [texts[4], "", None, "\n", "\n\n\n"]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), least_chars=0).collect()}
    seen, planted = set(), 0
    for i, t in enumerate(texts):
        lines, gone = (t or "").split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                run = tuple(lines[a:b])
                gone |= set(range(a, b)) if run in seen else set()
                seen.add(run)
        planted += len(gone)
        assert got[i] == (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert planted > 300


def test_decontamination_against_all_windows(spark):
    items = [(i, " ".join(words(R.randint(13, 40)))) for i in range(6)] + [(9, "too short"), (10, None)]
    def near(t):
        w = t.split()
        w[0] = "changed"
        return " ".join(w)
    texts = [" ".join(words(50)) + " " + items[0][1] + " " + " ".join(words(50)), near(items[1][1]), items[2][1].upper(), " ".join(words(200)), None, "", " ".join(items[3][1].split()[:-1]), items[4][1] + " " + items[5][1]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for k, x in items:
            y = (x or "").lower().split()
            if len(y) < 5 or len(w) < 5:
                continue
            q = bag(y)
            for s in range(max(1, len(w) - len(y) + 1)):
                p = bag(w[s : s + len(y)])
                score = sum((p & q).values()) / sum((p | q).values())
                if score >= 0.8:
                    want[i, k] = max(want.get((i, k), 0), score)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(0, 0), (2, 2), (7, 4)} <= got.keys()
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == sorted(set(range(len(texts))) - {k[0] for k in want})
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_anchor_step_misses_nothing():
    for m in range(1, 80):
        most = m - math.ceil(1.6 * m / 1.8 - 1e-9)
        assert decontaminate.anchor_step(m, 0.8) <= math.ceil((m - most) / (most + 1))


def test_bpe_equals_tiktoken(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    table = bpe.PerfectHash(ranks)
    assert sorted(table.keys) == sorted(ranks) and all(table.find(k) == i for k, i in list(ranks.items())[:500]) and table.find(b"\xff no such") == -1
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path))
    assert got == by_id(bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True))
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN, decoded=True).count() == 0
    for i, t in enumerate(TEXTS):
        ids = np.frombuffer(got[i * 37].token_ids, "<u4").tolist()
        assert ids == real.encode_ordinary(t or "") and bytes(got[i * 37].decoded).decode() == (t or "")
    coder = bpe.Encoder(table, public_tokenizers.PATTERN)
    for t in ("z" * 3000, "aéñ語😀" * 50, "  \n\n\t x", "abc" * 500 + "!?" * 300):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == real.encode_ordinary(t)


def test_bpe_memory_is_bounded_and_keeps_answers(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    asked = []
    memory = bpe.Remembered(lambda k: asked.append(k) or -k)
    for k in [*range(30), 29, 25, 3]:
        assert memory[k] == -k and len(memory) <= 8 and len(memory.old) <= 8
    assert asked == [*range(30), 3]


def test_quality_measures(docs):
    got = by_id(quality_rules.measures(docs).select("doc_id", "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words"))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = set()
        for k in range(len(w) - 7):
            if n[tuple(w[k : k + 8])] > 1:
                hit |= set(range(k, k + 8))
        assert tuple(got[i * 37])[1:] == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
    assert quality_rules.quality_filter(docs).columns == docs.columns


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>", "<\\/turn>", "####", "", None, "a\\", "x\n### User: y</turn>\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)] + [(2, 0, None, "no: role"), (2, 0, None, "no: role")]
    d = chat_format.gather(spark.createDataFrame(rows, "c long, t int, role string, text string"), "c", "t", "role", "text")
    out = {r.c: r for r in chat_format.chat_format(d).withColumn("back", chat_format.parsed(F.col("formatted"))).collect()}
    assert [tuple(x) for x in out[1].back] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(nasty)]
    assert [tuple(x) for x in out[2].back] == [("", "no: role")] * 2
    unesc = lambda s: "".join(s[i + 1] if s[i] == "\\" else s[i] for i in range(len(s)) if not (i and s[i - 1] == "\\" and (len(s[:i]) - len(s[:i].rstrip("\\"))) % 2)) if s else ""
    texts = [out[1].formatted[s.start : s.end] for s in out[1].loss_spans]
    assert len(texts) == 4 and unesc(texts[1]) == "####"


def test_layouts_by_schema_hash(spark):
    js = ['{"prompt":"p","response":"r"}', '{"response":"r","prompt":"p"}', '{"instruction":"i","input":null,"output":"o"}', '{"messages":[{"role":"human","content":"h"},{"role":"gpt","content":"g"}]}', '{"conversations":[{"from":"gpt","value":"v"}]}', '{"other":1}', "broken", None]
    got = [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat_format.turns_of_json(spark.createDataFrame(list(enumerate(js)), "i int, j string"), "j").orderBy("i").collect()]
    assert got[0] == got[1] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("instruction_input", [("user", "i"), ("assistant", "o")])
    assert got[3] == ("messages", [("user", "h"), ("assistant", "g")]) and got[4] == ("conversations", [("assistant", "v")])
    assert got[5:] == [(None, None)] * 3


def test_extra_fields_and_mixed_messages(spark):
    js = [
        '{"id":7,"prompt":"p","response":"r","meta":{"a":1}}',
        '{"messages":[{"role":"user","content":"h","name":"n"},{"role":"gpt","content":"g"}],"source":"s"}',
        '{"messages":[{"role":"user"},{"role":"gpt","content":"g","name":"n"}]}',
        '{"messages":[{"role":"user","content":"h"},{"from":"gpt","value":"g"}]}',
        '{"prompt":"p","response":"r","system":"s","tags":[1,2]}',
    ]
    got = [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat_format.turns_of_json(spark.createDataFrame(list(enumerate(js)), "i int, j string"), "j").orderBy("i").collect()]
    assert got[0] == ("prompt", [("user", "p"), ("assistant", "r")])
    assert got[1] == ("messages", [("user", "h"), ("assistant", "g")]) and got[2] == ("messages", [("user", ""), ("assistant", "g")])
    assert got[3] == (None, None)
    assert got[4] == ("prompt_system", [("system", "s"), ("user", "p"), ("assistant", "r")])


def test_tables_select_layouts_by_hash(spark, monkeypatch):
    d = spark.sql("select 1 as id, 'p' as prompt, 'r' as response, array(named_struct('from', 'gpt', 'value', 'v', 'id', 3)) as conversations")
    told = lambda x: [tuple(t) for t in chat_format.turns_of_table(x).first().turns]
    assert told(d) == [("assistant", "v")]
    assert told(d.drop("conversations")) == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat_format.turns_of_table(d.select("id", "prompt"))
    own = chat_format.fingerprint
    calls = []
    monkeypatch.setattr(chat_format, "fingerprint", lambda p: own([*p, str(calls.append(p) or len(calls))]))
    with pytest.raises(ValueError):  # hashes that never agree select nothing
        told(d)
    assert list(chat_format.LAYOUTS[7].paths) in [sorted(p) for p in calls]


def test_rows_select_layouts_by_hash(spark, monkeypatch):
    rows = [(c, i, r, f"{r} {c}") for c in (0, 1, 2, None) for i, r in enumerate(("human", "bot", "model", "assistant"))] + [(4, 0, None, None), (5, 0, "user", None)]
    d = spark.createDataFrame(rows, "c long, t int, role string, text string")
    records = chat_format.in_layouts(d, "c", "t", "role", "text")
    told = lambda x: {r.c: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in x.collect()}
    plain = told(chat_format.turns_of_rows(records, chat_format.PLAIN))
    assert {c: v[0] for c, v in plain.items()} == {0: "turns", 1: "messages", 2: "conversations", None: "turns", 4: "messages", 5: "conversations"}
    for c in (0, 1, 2, None):  # roles as given
        assert plain[c][1] == [(r, f"{r} {c}") for r in ("human", "bot", "model", "assistant")]
    assert plain[4][1] == [("", "")] and plain[5][1] == [("user", "")]
    named = told(chat_format.turns_of_rows(records))
    assert [r for r, _ in named[1][1]] == ["user", "assistant", "assistant", "assistant"] and named[0] == plain[0]
    other = records.withColumn("messages", F.lit(None).cast("string"))  # another type of field isn't the layout's
    assert told(chat_format.turns_of_rows(other))[1] == (None, None)
    own = chat_format.fingerprint
    monkeypatch.setattr(chat_format, "fingerprint", lambda p: own(p) if isinstance(p, list | tuple) else own(["x"]))
    assert set(told(chat_format.turns_of_rows(records, chat_format.PLAIN)).values()) == {(None, None)}  # without the hash nothing is mapped


def test_fingerprints_of_null_ids_link_others(spark, monkeypatch):
    fps = {"a": 0x00, "b": 0x0F, "c": 0xFF, "d": 0xFF << 32}
    d = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, *_: docs.select("doc_id", F.create_map(*[x for k, v in fps.items() for x in (F.lit(k), F.lit(v))])[F.col("text")].cast("long").alias("fp")))
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash_dedup.simhash_components(d).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 1), (None, 0x0F, 1), (3, 0xFF, 1)] + [(None, 0xFF << 32, None)] * 2, key=repr)


def test_pitman_yor(docs):
    got = by_id(pitman_yor.lm_scores(docs))
    tok = lambda t: [w.lower() for w in (t or "").encode().split()] + [None]
    c = Counter(w for i, t in enumerate(TEXTS) if zlib.crc32(str(i * 37).encode()) % 7 != 2 for w in tok(t))
    n, v = sum(c.values()), len(c)
    total = [0.0, 0.0]
    for i, t in enumerate(TEXTS):
        r, w = got[i * 37], tok(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, zlib.crc32(str(i * 37).encode()) % 7 == 2)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        total[0] += r.base_score
        total[1] += r.score
    assert total[0] < total[1] < 0


def test_gibbs_against_the_exact_distribution_of_tables():
    """With a fixed weight f of a new table, c customers sit at t tables with a probability in proportion to S(c, t) f^t."""
    kinds, copies, d, f = [2, 3, 9, 40, 200], 600, 0.6, 0.8
    c = np.repeat(kinds, copies)
    seats = pitman_yor.Seats.dealt(pitman_yor.mix64(np.arange(len(c), dtype=np.uint64)), c, np.ones(len(c), np.int64))
    got = np.zeros(len(kinds))
    for sweep in range(30):
        for r in range(pitman_yor.ROUNDS):
            n = pitman_yor.blocks(c, r)
            dish = np.flatnonzero(n)
            if len(dish):
                seats.change(dish, n[dish], n[dish], d, np.full(len(dish), f), sweep, r)
        assert (seats.customers() == c).all() and seats.size.min() > 0
        got += seats.tables().reshape(-1, copies).mean(axis=1) / 15 if sweep >= 15 else 0
    for k, n in enumerate(kinds):
        s = np.array([0.0, 1.0])  # generalised Stirling numbers, scaled
        for i in range(1, n):
            s = np.append(s * (i - d * np.arange(len(s))), 0) + np.append(0, s)
            s /= s.max()
        weight = s * f ** np.arange(len(s))
        want = (weight * np.arange(len(s))).sum() / weight.sum()
        assert abs(got[k] - want) < 0.05 * want, (n, got[k], want)


def test_customers_leave_table_by_table():
    """Ten billion customers leave in one step: as many of each table as an even draw takes, without a row for each of them."""
    size = np.array([6 * 10**9, 24 * 10**9, 1, 5])
    seats = pitman_yor.Seats(pitman_yor.mix64(np.arange(3, dtype=np.uint64)), np.array([2, 0, 2]), size)
    closed, opened = seats.change(np.array([0, 2]), np.array([10**10, 6]), np.array([0, 1]), 0.5, np.ones(2), 1)
    assert closed.tolist() == [0, 2] and opened.tolist() == [0, 1] and seats.owner.tolist() == [0, 0, 2]
    assert seats.size.sum() == 2 * 10**10 + 1 and abs(seats.size[0] - 4 * 10**9) <= 1


def test_ranked_and_bucket_cuts():
    """Places among different values, where the bits beside the places don't tell all values apart too; buckets are ranges of hashes."""
    r = np.random.default_rng(3)
    wide = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    for x, bits in ((wide[r.integers(0, 500, 5000)], 64), (wide[r.integers(0, 500, 5000)] & np.uint64(4095), 64), (r.integers(0, 900, 5000), 10), (wide[:1], 64), (wide[:0], 64)):
        for got, want in zip(common.ranked(x, bits), np.unique(x, return_inverse=True)):
            assert (got == want).all() and len(got) == len(want)
    hashes = np.sort(np.append(wide * np.uint64(2), np.array([0, (1 << 64) - 1], dtype=np.uint64)))
    for n in (1, 3, 64, 409):
        at = [(int(x) >> 32) * n >> 32 for x in hashes]
        assert [(k, b - a) for k, a, b in exchange.bucket_cuts(hashes, n)] == sorted(Counter(at).items())


def test_pitman_yor_sums_to_one():
    """Over the vocabulary and the unknown word the predictive probability of a context is 1."""
    c = np.array([1, 4, 7, 1, 2])
    key = pitman_yor.mix64(np.arange(5, dtype=np.uint64))
    seats, above = pitman_yor.Seats.dealt(key, c, np.ones(5, int)), pitman_yor.Seats.dealt(key, np.ones(5, int), np.ones(5, int))
    for i in range(20):
        pitman_yor.gibbs(seats, np.arange(5), above, 0.6, 0.5, np.full(5, 3.0), 0.3, lambda a, b: a / a.sum(), i)
    t, c0, t0 = seats.tables(), above.customers(), above.tables()
    m = pitman_yor.Model({0: (c.sum(), t.sum()), -1: (c0.sum(), t0.sum())}, 5, 0.6, 0.5)
    parent = m.word(np.append(c0, 0), np.append(t0, 0))
    assert abs(parent.sum() - 1) < 1e-9 and (c0 == t).all()
    assert abs(m.pair(np.zeros(6, int), np.append(c, 0), np.append(t, 0), parent).sum() - 1) < 1e-9


def test_every_previous_word_has_its_own_restaurant(spark):
    """9,000 previous words, each followed by a word of its own: all are told apart, and their totals are those counted."""
    r, n = random.Random(4), 9000
    texts = []
    for _ in range(300):
        texts.append(" ".join(f"a{i} b{i}" for i in r.sample(range(n), 120)))
    seen = Counter((u, w) for t in texts for u, w in zip(["", *t.split()], [*t.split(), ""]))
    word, context, doc = pitman_yor.tokens(texts)
    assert len(word) == len(doc) == sum(seen.values()) and len(set(context.tolist())) == len({u for u, _ in seen})
    assert sorted(Counter(zip(word.tolist(), context.tolist())).values()) == sorted(seen.values())
    rows = spark.createDataFrame([(i % 5 == 0, t) for i, t in enumerate(texts)], "held_out boolean, text string").repartition(3)
    counts = pitman_yor.count_words(rows, 8)
    asked = pitman_yor._to_contexts(counts, "contexts", ["customers", "kinds"], 0, 0, True, 3)
    want = Counter((u, w) for i, t in enumerate(texts) if i % 5 for u, w in zip(["", *t.split()], [*t.split(), ""]))
    of = Counter()
    for (u, _), k in want.items():
        of[u] += k
    told = {}
    contexts = {x.bucket: np.frombuffer(x.contexts, "<u8") for x in counts.collect()}
    replies = pitman_yor.context_totals(asked).toArrow()
    for b, c in contexts.items():
        customers, kinds = pitman_yor._replies(replies.filter(pc.equal(replies["bucket"], b)), 2)
        for x in zip(c.tolist(), customers.tolist(), kinds.tolist()):
            assert told.setdefault(x[0], x[1:]) == x[1:]
    kinds = Counter(u for u, _ in want)
    assert sorted(told.values()) == sorted((of[u], kinds[u]) for u in {u for u, _ in seen})


def test_what_always_follows_is_nearly_certain(spark):
    """b after a of its own, 12 times each, among 6,000 such pairs: hashing contexts into few restaurants would blur this."""
    n = 6000
    texts = [" ".join(f"a{i} b{i}" for i in range(k, n, 60)) for k in range(60) for _ in range(14)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = pitman_yor.lm_scores(d).agg(F.avg(F.col("score") / F.col("n_tokens")), F.avg(F.col("base_score") / F.col("n_tokens"))).first()
    # an a is one of 60 lists' next words as well, which is as certain
    assert got[0] > -0.12 > got[1]


def test_scores_do_not_depend_on_partitions(docs, spark):
    told = []
    for n in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        told.append({r.doc_id: r.score for r in pitman_yor.lm_scores(docs.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert told[0].keys() == told[1].keys() and all(abs(told[0][k] - told[1][k]) < 1e-6 for k in told[0])


def test_html_blocks_and_accuracy():
    text = lambda s: [b.text for b in html_crf.blocks(s)]
    assert text("<p>a &amp; b &amp;lt; c<p>d<br>e<script>var x='<p>no</p>'</script><ul><li>f<li>g</ul>") == ["a & b &lt; c", "d e", "f", "g"]
    assert text(None) == text("") == text("<div><!-- only --></div>") == []
    chain = html_crf.train(html_crf.labelled_sequences(250), steps=100)
    test = html_crf.labelled_sequences(150, seed=77)
    wrong = sum(int((chain.viterbi(chain.states(f)) != np.array(y)).sum()) for f, y in test)
    assert wrong / sum(len(y) for _, y in test) < 0.01


def test_viterbi_against_all_labellings():
    chain = html_crf.Chain({})
    rng = np.random.default_rng(0)
    chain.trans, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    states = [tuple(x) for x in rng.normal(size=(7, 2))]
    score = lambda y: chain.start[y[0]] + sum(states[i][k] for i, k in enumerate(y)) + sum(chain.trans[a, b] for a, b in zip(y, y[1:]))
    best = max(([(k >> i) & 1 for i in range(7)] for k in range(128)), key=score)
    assert chain.viterbi(states).tolist() == best


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert 0 < out.count() <= docs.count()
        if i < 4:
            assert out.columns == docs.columns
        docs = out
    assert hashlib.sha256(b"").hexdigest() and "token_ids" in docs.columns


CLASHING = "row r id text n h start cuts body q_words q_n own words _v _paths block key fp hits first c".split()


def test_shared_and_null_ids_and_clashing_columns(spark):
    """Rows of one id are judged apart, null ids too, and columns named like the operators' own come back unchanged."""
    run = "\n".join(" ".join(words(12)) for _ in range(6))
    lone = ["\n".join(" ".join(words(9)) for _ in range(8)) for _ in range(4)]
    item = " ".join(words(40))
    rows = [(1, run), (2, "mine\n" + run), (2, lone[0]), (None, lone[1]), (None, run + "\nmore"), (None, None), (3, f"{lone[2]} {item}"), (3, lone[3]), (5, "\\n"), (5, "")]
    extra = [c for c in CLASHING if c != "text"]
    d = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{c} string' for c in extra)}").repartition(2)
    told = lambda df: {r["n"]: (r["doc_id"], r["text"]) for r in df.collect() if [r[c] for c in extra] == [f"{c}{r['n'][1:]}" for c in extra]}
    whole = {f"n{k}": x for k, x in enumerate(rows)}
    got = line_dedup.line_dedup(d)
    assert got.columns == d.columns and told(got) == whole | {"n1": (2, "mine"), "n4": (None, "more")}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.decontaminate(d, bench)
    assert got.columns == d.columns and told(got) == {k: v for k, v in whole.items() if k != "n6"}
    for dedup in (simhash_dedup.simhash_dedup, near_dedup.near_dedup):
        got = dedup(d)
        assert got.columns == d.columns and set(whole) - set(told(got)) <= {"n1", "n4", "n5", "n8", "n9"} and {"n2", "n3", "n6", "n7"} <= set(told(got))
    got = quality_rules.quality_filter(d, rules=(quality_rules.Rule("n_words", low=20),))
    assert got.columns == d.columns and told(got) == {k: (i, t) for k, (i, t) in whole.items() if len((t or "").split()) >= 20}
    assert set(quality_rules.measures(d).columns) >= set(d.columns) - {"q_n"}
    js = chat_format.turns_of_json(d.withColumn("text", F.lit('{"prompt":"p","response":"r"}')), "text")
    assert js.columns == [*d.columns, "layout", "turns"] and js.first().layout == "prompt"
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(d, path, public_tokenizers.PATTERN).columns == [*d.columns, "n_tokens", "token_ids"]
    for plain in (anchor_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash_dedup.simhash_components, pitman_yor.lm_scores):
        assert sorted(str(r.doc_id) for r in plain(d).collect()) == sorted(str(i) for i, _ in rows)


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = [
        anchor_dedup.substring_dedup(none), suffix_dedup.suffix_dedup(none), simhash_dedup.simhash_components(none), simhash_dedup.simhash_dedup(none), near_dedup.near_dedup(none),
        line_dedup.line_dedup(none), decontaminate.contaminated(none, bench), decontaminate.decontaminate(none, bench), quality_rules.quality_filter(none), pitman_yor.lm_scores(none),
        bpe.decode(bpe.encode(none, path, public_tokenizers.PATTERN), path), html_crf.main_text(none.select("doc_id", F.col("text").alias("html"))),
        chat_format.turns_of_json(none, "text"), chat_format.chat_format(chat_format.gather(none, "doc_id", "id", "id", "text")),
    ]
    assert [x.count() for x in out] == [0] * len(out)

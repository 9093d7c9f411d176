"""The registered queries themselves: against their SQL, and against plain Python where SQL can't express them."""

import hashlib
import os
import struct

import oracle
import public_tokenizers
import pytest
import xxhash

from tracklane.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def words(text):
    return text.encode().split()  # bytes.split takes the six ASCII blanks


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    assert oracle.compare(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name]) == ""


def test_fingerprints_and_components(spark, texts):
    def fingerprint(text):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == {(i, f"{f:016x}", find(i)) for i, f in fps.items()}


def test_repeated_bytes(spark, texts):
    blobs, seen = {i: t.encode() for i, t in texts.items()}, {}
    for b in blobs.values():
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    got = {r.doc_id: r for r in rows(spark, "op9_suffix_dedup")}
    assert len(got) == len(blobs)
    for i, b in blobs.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_ids_equal_tiktoken(spark, texts):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(queries.RANKS)), special_tokens={})
    for r in rows(spark, "op8_bpe"):
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes a sequence of leaf blocks, runs of text between block-level tags. Features of a block are its ancestor tags,
words of their class and id attributes, and properties of its text. A chain of two labels (main, not) is trained by maximum
likelihood on labelled pages (`n_train` of them, the documented bound of the sample) and decoded by Viterbi.

Scripts, styles and head matter are not text. Character references are decoded, white space in a block becomes one blank,
blocks are trimmed and joined by one new line. Null, empty and text-free pages give an empty text; broken markup closes
what is open; a page of any length is one pass over it; repeated rows are extracted alike; other columns stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklane.llm.labelled_pages import pages

#: Elements that end a block, that have no content, and whose content is not text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title svg iframe math".split())
#: A start tag that closes an open element of its own kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Stems that are looked for inside words of class and id attributes.
STEMS = ("comment", "discuss", "repl", "respons", "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "subscri", "newsletter", "foot", "copyright", "head", "nav", "menu", "side", "widget", "relat", "share", "social", "recommend", "form", "search", "login", "content", "article", "post", "entry", "story", "body", "main", "text")

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block:
    __slots__ = ("text", "tags", "marks", "linked")

    def __init__(self, text: str, tags: tuple, marks: tuple, linked: int):
        self.text, self.tags, self.marks, self.linked = text, tags, marks, linked


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[str, ...]:
    return tuple(w for m in _MARK.finditer(attributes) for w in re.split(r"[^a-z]+", next(x for x in m.groups() if x is not None).lower()) if w)


def _decoded(text: str) -> str:
    """html.unescape; the commonest reference is split off first, as each of the others costs a call."""
    return text if "&" not in text else "&".join([html.unescape(x) if "&" in x else x for x in text.split("&amp;")])


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_decoded("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(m for _, ms in stack for m in ms), linked))
            parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def close(names, until=BLOCK) -> None:
        """Closes the innermost element of these names unless a container of another name comes first."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                pop(k)
                return
            if stack[k][0] in until:
                return

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links and not text.isspace():
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(t in BLOCK for t, _ in stack[k:]):
                        flush()
                    pop(k)
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            if name in CLOSES_P:
                close({"p"})
            if name in SELF_CLOSING:
                close(SELF_CLOSING[name], BLOCK - {"p"} if name != "p" else BLOCK)
            flush()
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, _marks(m[3]) if m[3] else ()))
            links += name == "a"
    flush()
    return out


@lru_cache(maxsize=65536)
def structure(tags: tuple, marks: tuple) -> tuple[str, ...]:
    """Features of a block's ancestors: their tags, words of their class and id attributes, stems in those."""
    words = set(marks)
    return ("bias", f"tag={tags[-1] if tags else ''}", *sorted({f"in={t}" for t in tags}), *sorted(f"mark={w}" for w in words), *[f"stem={s}" for s in STEMS if any(s in w for w in words)])


def wording(b: Block, first: bool, last: bool) -> tuple[str, ...]:
    """Features of a block's text and of its place."""
    text = b.text
    chars = len(text)
    f = [f"words={min((text.count(' ') + 2).bit_length() - 1, 7)}", f"links={min(4 * b.linked // chars, 4)}"]
    if text[-1] in ".!?":
        f.append("stop")
    if "©" in text or "opyright" in text:
        f.append("copyright")
    if " | " in text or " · " in text:
        f.append("bars")
    if first:
        f.append("first")
    if last:
        f.append("last")
    return tuple(f)


def features(seq: list[Block]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each block its features in two parts, each from a small set of combinations."""
    end = len(seq) - 1
    return [(structure(b.tags, b.marks), wording(b, i == 0, i == end)) for i, b in enumerate(seq)]


class Chain:
    """Weights of a two-label chain: state features (F, 2), transitions (2, 2) and starts (2)."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.sums: dict[tuple[str, ...], tuple[float, float]] = {}
        self.w, self.trans, self.start = np.zeros((len(vocabulary), 2)), np.zeros((2, 2)), np.zeros(2)

    def part(self, names: tuple[str, ...]) -> tuple[float, float]:
        if names not in self.sums:
            if len(self.sums) > 65536:
                self.sums.clear()
            self.sums[names] = tuple(self.w[[self.vocabulary[x] for x in names if x in self.vocabulary]].sum(axis=0).tolist())
        return self.sums[names]

    def states(self, feats: list) -> list[tuple[float, float]]:
        """Scores of the two labels for each block; sums of combinations seen before are remembered."""
        out = []
        for one, two in feats:
            (a, b), (c, d) = self.part(one), self.part(two)
            out.append((a + c, b + d))
        return out

    def viterbi(self, states: list[tuple[float, float]]) -> np.ndarray:
        n = len(states)
        if not n:
            return np.zeros(0, dtype=np.int64)
        (t00, t01), (t10, t11) = self.trans.tolist()
        a, b = self.start[0] + states[0][0], self.start[1] + states[0][1]
        back = []
        for x, y in states[1:]:
            from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
            back.append((from0, from1))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        label = [0 if a >= b else 1]
        for two in reversed(back):
            label.append(two[label[-1]])
        return np.array(label[::-1])


def train(labelled: list[tuple[list, list[int]]], steps: int = 150, rate: float = 0.1, penalty: float = 0.02) -> Chain:
    """Maximum penalised likelihood by Adam; forward and backward run over all sequences at once, padded."""
    labelled = [x for x in labelled if x[0]]
    vocabulary = {f: i for i, f in enumerate(sorted({f for feats, _ in labelled for fs in feats for part in fs for f in part}))}
    chain = Chain(vocabulary)
    n, longest = len(labelled), max((len(x[0]) for x in labelled), default=0)
    if not n:
        return chain
    rows, cols = zip(*[(k, vocabulary[f]) for k, fs in enumerate([fs for feats, _ in labelled for fs in feats]) for part in fs for f in part])
    rows, cols = np.array(rows), np.array(cols)
    size = np.array([len(x[0]) for x in labelled])
    seq, pos = np.repeat(np.arange(n), size), np.concatenate([np.arange(k) for k in size])
    gold = np.concatenate([np.array(y) for _, y in labelled])
    real = np.arange(longest)[None, :] < size[:, None]
    onehot = np.zeros((n, longest, 2))
    onehot[seq, pos, gold] = 1
    gold_pairs = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    params = [chain.w, chain.trans, chain.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    for step in range(1, steps + 1):
        flat = np.zeros((len(seq), 2))
        np.add.at(flat, rows, chain.w[cols])
        s = np.zeros((n, longest, 2))
        s[seq, pos] = flat
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = chain.start + s[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], lse(alpha[:, t - 1, :, None] + chain.trans, 1) + s[:, t], alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], lse(chain.trans + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + chain.trans + (s + beta)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        gw = np.zeros_like(chain.w)
        np.add.at(gw, cols, (p - onehot)[seq, pos][rows])
        grads = [gw / n + penalty * chain.w / 10, (pair.sum((0, 1)) - gold_pairs) / n, (p[:, 0] - onehot[:, 0]).sum(0) / n]
        for x, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return chain


def labelled_sequences(n: int, seed: int = 1) -> list[tuple[list, list[int]]]:
    out = []
    for source, main in pages(n, seed):
        seq = blocks(source)
        out.append((features(seq), [int(b.text in main) for b in seq]))
    return out


def extract(chain: Chain, page: str | None) -> str:
    seq = blocks(page)
    label = chain.viterbi(chain.states(features(seq)))
    return "\n".join(b.text for b, y in zip(seq, label) if y)


def main_text(df: DataFrame, source: str = "html", n_train: int = 600) -> DataFrame:
    """Appends `text`, the main text of each page. The chain is trained on the driver and broadcast: a few hundred weights."""
    shared = df.sparkSession.sparkContext.broadcast(train(labelled_sequences(n_train)))
    keep = [f for f in df.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([extract(shared.value, x.as_py()) for x in b.column(source)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [text], names=[f.name for f in keep] + ["text"])

    return df.mapInArrow(run, schema)

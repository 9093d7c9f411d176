"""md5 of many short keys at once in numpy: the hashes that scalar.hash_pick() and md5 order take one by one in Spark."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import sin

import numpy as np

_K = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_AT = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_LEFT, _RIGHT = [np.array(s, np.uint32) for s in _TURN], [np.array(32 - s, np.uint32) for s in _TURN]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that are hashed together: their registers stay in the processor's cache.
_TOGETHER = 16384
#: Messages whose keys are laid out together.
HELD = 1 << 18


def _compressed(words: list, n: int, wide: bool) -> np.ndarray:
    """First 4 bytes (8 if wide) of the md5 of n messages of one block each, as big-endian numbers; words are 16 scalars or arrays."""
    out = np.empty(n, np.uint64 if wide else np.uint32)
    scratch = [np.empty(min(n, _TOGETHER), np.uint32) for _ in range(6)]
    steps = 64 if wide else 61  # the last three don't change the first register
    add, bitwise_and, bitwise_or, bitwise_xor, invert, left_shift, right_shift = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.left_shift, np.right_shift
    plus = [np.array((k + (0 if isinstance(words[i], np.ndarray) else words[i])) & 0xFFFFFFFF, np.uint32) for k, i in zip(_K, _AT)]
    words = [w if isinstance(w, np.ndarray) else None for w in words]
    for lo in range(0, n, _TOGETHER):
        m = min(_TOGETHER, n - lo)
        a, b, c, d, t, v = (x[:m] for x in scratch)
        for x, start in zip((a, b, c, d), _START):
            x.fill(start)
        for i in range(steps):
            if i < 16:
                bitwise_xor(c, d, t)
                bitwise_and(t, b, t)
                bitwise_xor(t, d, t)
            elif i < 32:
                bitwise_xor(b, c, t)
                bitwise_and(t, d, t)
                bitwise_xor(t, c, t)
            elif i < 48:
                bitwise_xor(b, c, t)
                bitwise_xor(t, d, t)
            else:
                invert(d, t)
                bitwise_or(t, b, t)
                bitwise_xor(t, c, t)
            add(t, a, t)
            word = words[_AT[i]]
            add(t, plus[i], t)
            if word is not None:
                add(t, word[lo : lo + m], t)
            left_shift(t, _LEFT[i], v)
            right_shift(t, _RIGHT[i], t)
            bitwise_or(t, v, t)
            add(t, b, t)
            a, b, c, d, t = d, t, b, c, a
        if wide:
            out[lo : lo + m] = ((a + np.uint32(_START[0])).byteswap().astype(np.uint64) << np.uint64(32)) | (b + np.uint32(_START[1])).byteswap()
        else:
            out[lo : lo + m] = (b + np.uint32(_START[0])).byteswap()  # the register that three more steps carry to the first place
    return out


def _lengths(parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of the parts of each length."""
    size = np.array([len(x) for x in parts])
    out = []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out.append((at, np.frombuffer(b"".join(parts[i] for i in at), np.uint8).reshape(len(at), n)))
    return out


@lru_cache(maxsize=64)
def _numbers(start: int, stop: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return _lengths([b"%d" % i for i in range(start, stop)])


def _part(values) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    if isinstance(values, range):
        return _numbers(values.start, values.stop), len(values)
    return _lengths([b"%d" % int(x) for x in values]), len(values)


def md5_grid(prefix: str, first, second=None, wide: bool = False) -> np.ndarray:
    """Leading 32 (wide: 64) bits of md5(prefix|f|s) for every f of first and s of second, (len(first), len(second)).

    first, second: whole numbers, a range or an array; without second it is md5(prefix|f), (len(first), 1). Callers bound the
    grid (HELD); keys that don't fit one block of md5 are hashed one by one.
    """
    head = prefix.encode() + b"|"
    (left, k), (right, m) = _part(first), _part(second) if second is not None else ([(np.zeros(1, int), np.zeros((1, 0), np.uint8))], 1)
    if not k or not m:
        return np.zeros((k, m), np.uint64 if wide else np.uint32)
    bar = 0 if second is None else 1
    most = len(head) + max(x.shape[1] for _, x in left) + bar + max(x.shape[1] for _, x in right)
    if most > 55:
        tails = [b"".join((b"|", b"%d" % int(s))) for s in second] if second is not None else [b""]
        size = 8 if wide else 4
        told = b"".join(hashlib.md5(head + b"%d" % int(f) + s).digest()[:size] for f in first for s in tails)
        return np.frombuffer(told, ">u8" if wide else ">u4").astype(np.uint64 if wide else np.uint32).reshape(k, m)
    width = most // 4 + 1  # words that hold keys and the bit behind them
    text = np.zeros((k, m, 4 * width), np.uint8)
    bits = np.zeros((k, m), np.uint32)
    for at, f in left:
        rows = text[at]
        rows[:, :, : len(head)] = np.frombuffer(head, np.uint8)
        end = len(head) + f.shape[1]
        rows[:, :, len(head) : end] = f[:, None, :]
        for to, s in right:
            if bar:
                rows[:, to, end] = ord("|")
                rows[:, to, end + 1 : end + 1 + s.shape[1]] = s[None, :, :]
            rows[:, to, end + bar + s.shape[1]] = 0x80
            bits[np.ix_(at, to)] = 8 * (end + bar + s.shape[1])
        text[at] = rows
    cells = text.reshape(k * m, 4 * width).view("<u4")
    words: list = [0] * 16
    for i in range(width):
        word = cells[:, i]
        words[i] = int(word[0]) if 4 * i + 4 <= len(head) else np.ascontiguousarray(word)
    words[14] = bits.ravel()
    return _compressed(words, k * m, wide).reshape(k, m)


def picks(prefix: str, first, second, n: int) -> np.ndarray:
    """scalar.hash_pick() of prefix|f|s for every f and s: whole numbers from 0 to n - 1."""
    h = md5_grid(prefix, first, second)
    if n > 0xFFFFFFFF:
        return h.astype(np.int64)
    return (h - h // np.uint32(n) * np.uint32(n)).astype(np.int64)

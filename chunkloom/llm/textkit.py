"""Vectorised words, hashes and windows over many texts at once, in numpy.

A slice of texts is one run of bytes with offsets. Words are runs of bytes other than 0x20 and 0x09-0x0D
(the separators are ASCII, so that cutting UTF-8 bytes equals cutting code points); a word never crosses texts.
Hashes are polynomials modulo 2^64 of random byte values, read off prefix sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd base and a random value for each byte.
BASE = int(_rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
WORD_BASE = int(_rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
SECOND_BASE = int(_rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64 (kept for sizes rounded up to a power of two)."""
    return _powers(base, 1 << max(12, (max(n, 1) - 1).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with 0 in front."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The hash of values[start:end], whatever stands before: equal runs have equal hashes."""
    back = powers(inverse(base), len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U))


class Words:
    """The words of a slice: ``start``, ``end`` (byte positions), ``doc`` (text they stand in), ``first`` (first word of each text, and the count)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a text's first byte, and the end
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before &= ~edge
        self.start = np.flatnonzero(inside & ~before)
        # a word ends where the next byte is outside, or another text begins
        ends = np.zeros(n + 1, bool)
        ends[1:] = inside[:n] & (~inside[1:] | edge[1:])
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        sums = prefix(BYTE[self.data if data is None else data], BASE)
        return span_hash(sums, self.start, self.end, BASE)


def windows(words: np.ndarray, doc: np.ndarray, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each run of ``size`` words that lies in one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    sums = prefix(words, base)
    return at, span_hash(sums, at, at + size, base)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's run first[i]:first[i+1]."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry: 0 if its key is alone in its text, 1 if it's the first of several, 2 if it comes later."""
    out = np.zeros(len(key), np.int8)
    if len(key) < 2:
        return out
    order = np.argsort(mix(key + doc.astype(U) * U(0x9E3779B97F4A7C15)), kind="stable")
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    later = np.concatenate([[False], same])
    opens = np.concatenate([same, [False]]) & ~later
    out[order[opens]] = 1
    out[order[later]] = 2
    return out


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows of ``size`` words that begin at ``at``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return np.cumsum(marks[:-1]) > 0

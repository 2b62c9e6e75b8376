"""Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text as arrays, and hashes of words and word windows.

The separators are ASCII, so splitting bytes is the same as splitting code points.  A word's hash
is a polynomial over its bytes modulo 2^64 with a final mix; a window's hash is a polynomial over
its words' hashes.  All of it is vectorised over many documents at a time.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of terms: every ASCII character but letters and digits.
PLAIN = np.zeros(256, bool)
PLAIN[:128] = True
PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 17
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(_SEGMENT + 1, n)
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, U(base & (2**64 - 1)), U)
            table[0] = U(1)
            made.append(np.multiply.accumulate(table))
        _powers[:] = made
    return _powers


def _segments(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Byte ranges that end at a document's end or after a separator."""
    n, a = len(data), 0
    while a < n:
        b = min(n, a + _SEGMENT)
        if b < n:
            at = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if at <= a:
                gaps = np.flatnonzero(separator[data[a:b]])
                if len(gaps):
                    at = a + int(gaps[-1]) + 1
                else:
                    later = np.flatnonzero(separator[data[b:]])
                    end = int(offsets[np.searchsorted(offsets, a, "right")])
                    at = min(end, b + int(later[0]) + 1) if len(later) else end
            b = at
        yield a, b
        a = b


class Words:
    """start, end: byte places of each word; first: index of each document's first word, n+1 long.

    prefix: for each asked number of bytes, hashes of the words' beginnings (0 where the word is not longer)."""

    __slots__ = ("hash", "start", "end", "first", "prefix")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, separator: np.ndarray = SEPARATOR, prefixes: tuple[int, ...] = ()) -> None:
        hs, ss, es = [], [], []
        ps: list[list[np.ndarray]] = [[] for _ in prefixes]
        for a, b in _segments(data, offsets, separator):
            part = FOLD[data[a:b]] if fold else data[a:b]
            word = ~separator[part]
            first = word.copy()
            first[1:] &= ~word[:-1]
            last = word.copy()
            last[:-1] &= ~word[1:]
            inside = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
            inside = inside[inside < b - a]
            first[inside] = word[inside]
            before = inside[inside > 0] - 1
            last[before] = word[before]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            ss.append(s + a)
            es.append(e + a)
            up, down = _power_tables(b - a + 1)
            sums = np.zeros(b - a + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[: b - a], out=sums[1:])
            hs.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
            for k, held in zip(prefixes, ps, strict=True):
                held.append(np.where(e - s > k, mix((sums[np.minimum(s + k, e)] - sums[s]) * down[s] + U(k << 32)), U(0)))
        self.start = np.concatenate(ss) if ss else np.zeros(0, np.int64)
        self.end = np.concatenate(es) if es else np.zeros(0, np.int64)
        self.hash = np.concatenate(hs) if hs else np.zeros(0, U)
        self.prefix = [np.concatenate(held) if held else np.zeros(0, U) for held in ps]
        self.first = np.searchsorted(self.start, offsets, "left")


def windows(hashes: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place, and whether those k words lie in one document."""
    n = len(hashes)
    out = np.zeros(n, U)
    if n >= k:
        base = U(WINDOW_BASES[which])
        acc = hashes[: n - k + 1].copy()
        for j in range(1, k):
            acc *= base
            acc += hashes[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    ends = np.repeat(first[1:], np.diff(first))
    return out, np.arange(n) + k <= ends


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a flag or count array over each document's range."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]

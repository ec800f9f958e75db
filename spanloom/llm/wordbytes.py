"""Words of many documents at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of ASCII letters, digits and any bytes above 127; texts come in lower case.
No Python loop runs over words: a word's 64-bit hash is a difference of prefix sums of a
polynomial over its bytes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEED = np.random.default_rng(20240229)
BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))


def word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = True
    return t


IS_WORD = word_table()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of the polynomial's base and of its inverse, as many as the longest buffer so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = IS_WORD[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers.to(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    x = BYTE[raw]
    x *= powers.up[:n]
    np.cumsum(x, out=sums[1:])
    h = sums[ends] - sums[starts]
    h *= powers.down[starts]
    return mix(h)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the bounds by document.

    A document of 1 to n - 1 words has one gram, of all its words; one without words has none.
    """
    counts = np.diff(first)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(counts)), many)
    at = first[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    left = first[1:][doc] - at
    g = np.zeros(len(at), np.uint64)
    last = len(h) - 1
    for k in range(n):
        part = h[np.minimum(at + k, last)] if last >= 0 else g
        part = np.where(left > k, part, U(0x51ED270B0A1F39C1))
        g = g * U(0xD6E8FEB86659FD93) + part
    return mix(g), bounds

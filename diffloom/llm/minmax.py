"""Word shingles, min-max signatures and their bands, in numpy.

Min-max hashing keeps both the smallest and the largest value under each hash
function: each of the two agrees between two sets with the probability of their
Jaccard similarity, so half the evaluations give a signature of full length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import xxhash

SEED = 20_240_601


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to 2 ** 17 of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return value


def shingles(text: str | None, words: WordHashes, width: int = 2) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes.

    A-Z count as a-z, words stand between ASCII white space. A text with fewer
    words than width is one shingle of all of them; one without words has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(width, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


MOST_BANDS = 150  # more only if single rows need them


@dataclass(frozen=True)
class MinMax:
    """bands of `rows` values each; every hash function gives two values, none of them in the same band.

    A pair of Jaccard similarity s shares a band with probability
    1 - (1 - s ** rows) ** bands: as set here 0.999997 at 0.8, and less than one
    in 500 at 0.2.
    """

    bands: int = 42
    rows: int = 6
    factors: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        functions = -(-self.bands // 2) * self.rows
        rng = np.random.default_rng(SEED)
        object.__setattr__(self, "factors", rng.integers(0, 2**31, functions, np.uint32) * np.uint32(2) + np.uint32(1))
        object.__setattr__(self, "_shift", rng.integers(0, 2**32, functions, np.uint32))

    @classmethod
    def of(cls, percent: int) -> MinMax:
        """Bands that miss a pair of that similarity with at most the probability of the standing ones at 0.8."""
        if not 1 <= percent <= 100:
            raise ValueError(f"percent is {percent}, not from 1 to 100")
        plain = cls()
        if percent >= 80:
            return plain
        miss = plain.bands * math.log1p(-(0.8**plain.rows))
        # the more rows, the fewer pairs that are not alike share a band
        needed = {rows: math.ceil(miss / math.log1p(-((percent / 100) ** rows))) for rows in range(1, plain.rows)}
        rows = max((r for r, bands in needed.items() if bands <= MOST_BANDS), default=1)
        return cls(needed[rows], rows)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Smallest values of all functions, then the largest ones. s: a non-empty set of shingles."""
        low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        most = np.zeros(len(self.factors), np.uint32)
        for at in range(0, len(low), 2048):
            part = self.factors[:, None] * (low[None, at : at + 2048] ^ self._shift[:, None])
            np.minimum(least, part.min(axis=1), out=least)
            np.maximum(most, part.max(axis=1), out=most)
        return np.concatenate([least, most])

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different from band to band for equal values."""
        half = len(self.factors)
        per_side = half // self.rows
        values = signature.reshape(2 * per_side, self.rows)[: self.bands].astype(np.uint64)
        keys = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for column in values.T:
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection is at least `percent` of the union, in whole numbers. Both sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)

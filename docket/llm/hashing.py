"""Word hashes and position-independent hashes of word ranges, vectorised over a batch."""

from __future__ import annotations

import numpy as np
import xxhash

from docket.llm.common import BoundedCache

# Fixed odd multipliers of the two polynomial hashes.
M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
WORDS_KEPT = 100_000


def word_cache() -> BoundedCache:
    return BoundedCache(xxhash.xxh3_64_intdigest, WORDS_KEPT)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RangeHash:
    """hash(a, b) of words[a:b], equal for equal word sequences wherever they stand."""

    def __init__(self, words: np.ndarray, multiplier: int = M1):
        n = len(words)
        inverse = pow(multiplier, -1, 1 << 64)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, multiplier, dtype=np.uint64))])
        self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, dtype=np.uint64))])
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power[:n])])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(np.uint64) * np.uint64(M2))

    def without(self, a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words[a:b] with the word at p left out."""
        raw = self.raw(a, p) + self.power[p - a] * self.raw(p + 1, b)
        return mix(raw + (b - a - 1).astype(np.uint64) * np.uint64(M2))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

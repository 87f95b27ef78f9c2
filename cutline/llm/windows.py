"""Rolling hashes of word windows over batches of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from cutline.llm.common import Ids

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of byte words; the table of seen words is bounded."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit
        self.clear()

    def clear(self):
        self.ids, self.hash = Ids(), np.empty(0, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.clear()
        known = len(self.ids)
        at = self.ids.of(words)
        new = self.ids.order[known:]
        if new:
            digest = xxhash.xxh3_64_intdigest
            self.hash = np.concatenate([self.hash, np.array([digest(w) for w in new], np.uint64)])
        return self.hash[at]


class Roller:
    """Polynomial hashes modulo 2^64 of windows of `width` values, for one odd base."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of values[k:k+width] for every k; mixed, so that any bits may be used."""
        n = len(values)
        if n < width:
            return np.empty(0, np.uint64)
        self._powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:n], dtype=np.uint64)])
        return mix((total[width:] - total[:-width]) * self.down[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[k:k+width] for every k, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def inside(lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in the joined values) of windows that lie within one document."""
    count = np.maximum(lens - width + 1, 0)
    doc = np.repeat(np.arange(len(lens)), count)
    first = np.cumsum(lens) - lens
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return doc, first[doc] + within

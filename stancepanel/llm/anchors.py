"""Anchors: places in texts that equal windows of text agree on.

Every window of `window` bytes picks the smallest hash among the k-grams inside it, the leftmost of equals. Two equal
windows pick the same place, so repeats of `window` bytes or more can be found by comparing anchors alone.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Selector:
    """Finds anchors in byte buffers. Powers of the hash base are kept for buffers of up to `size` bytes."""

    def __init__(self, window: int = 200, gram: int = 64, size: int = 1 << 20):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self._grow(size)

    def _grow(self, size: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)], dtype=np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of every k-gram, by differences of one running sum."""
        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=total[1:])
            h = (total[self.gram:] - total[:-self.gram]) * self.inverses[:len(data) - self.gram + 1]
            h ^= h >> np.uint64(32)
            h *= SPREAD
            return h ^ (h >> np.uint64(29))

    def select(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor places in the buffer and their hashes; texts are [starts, ends), and windows lie within texts."""
        if len(data) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hashes(data)
        place_bits = int(len(h)).bit_length()
        place = np.arange(len(h), dtype=np.uint64)
        key = (h >> np.uint64(place_bits) << np.uint64(place_bits)) | place  # equal hashes: the leftmost
        n = len(key) - self.span + 1
        blocks = -(-len(key) // self.span)
        padded = np.full(blocks * self.span, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(key)] = key
        grid = padded.reshape(blocks, self.span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        lowest = np.minimum(behind[:n], ahead[self.span - 1:self.span - 1 + n])
        inside = np.zeros(n + 1, np.int64)
        long = ends - starts >= self.window
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, np.minimum(ends[long] - self.window + 1, n), -1)
        chosen = lowest[np.cumsum(inside[:n]) > 0] & np.uint64((1 << place_bits) - 1)
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]].astype(np.int64)
        return chosen, h[chosen]

"""A minimal perfect hash over 64-bit keys, with the keys beside it, in numpy.

Levels of bits, as in Limasset et al. 2017: a key that falls alone on a place of a level sets that bit; keys that meet
go on to the next level. A key's slot is the number of set bits before its own, over all levels. Some three bits a key
are enough to find a slot; the stored key then tells whether the key asked for is the one that has the slot.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2, 64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of x, spread."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 of n different keys."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        words, self.sizes, rest = [], [], keys
        while len(rest):
            if len(self.sizes) == LEVELS:
                raise ValueError("the keys aren't all different")
            size = max(64, -(-GAMMA * len(rest) // 64) * 64)
            at = self._place(rest, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            rest = rest[~alone[at]]
        self.words = np.concatenate([*words, np.zeros(1, np.uint64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.keys = np.empty(len(keys), np.uint64)
        slots = self._slots(keys)
        self.keys[slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        # the high half of a product spreads 32 bits over the level's places
        return (((mixed(keys, level) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, rest, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(keys[rest], level, size) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            word, bit = word[hit], bit[hit]
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slots[rest[hit]] = self.before[word] + np.bitwise_count(below)
            rest, base = rest[~hit], base + size
            if not len(rest):
                break
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for one that isn't stored."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        found = self._slots(keys)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)

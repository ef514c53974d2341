"""Minimal perfect hashing of distinct 128-bit keys, in whole arrays.

Level by level, every key left hashes to a bit; keys that are alone at theirs are placed there, the
others go on to the next level. A key's index is the number of set bits before its own, so n keys get
the numbers 0 to n-1 at about three bits a key, whatever the keys are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLOTS_PER_KEY = 1.7


def mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another one for every level."""
    with np.errstate(over="ignore"):
        x = high ^ (low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 % 2**64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    sizes: np.ndarray  # bits of each level
    bits: np.ndarray   # one byte per bit, all levels
    ranks: np.ndarray  # set bits before each bit

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """``high`` and ``low`` are the halves of the keys; the keys must be distinct."""
        sizes, levels = [], []
        while len(high):
            size = max(64, int(SLOTS_PER_KEY * len(high)) + 1)
            slot = mixed(high, low, len(sizes)) % np.uint64(size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[slot.astype(np.int64)]
            high, low = high[rest], low[rest]
        return cls._of(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    @classmethod
    def _of(cls, sizes: np.ndarray, bits: np.ndarray) -> PerfectHash:
        return cls(sizes, bits, np.cumsum(bits) - bits)

    def packed(self) -> tuple[list[int], bytes]:
        return self.sizes.tolist(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes, bits: bytes) -> PerfectHash:
        sizes = np.asarray(sizes, np.int64)
        return cls._of(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool))

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's number; for keys it was not built from -1 or the number of some other key."""
        found = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = base + (mixed(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
            base += size
        return found

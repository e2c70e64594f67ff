"""Minimal perfect hashing in numpy: levels of bit arrays, ranked by population counts.

Each level hashes the keys that are still without a place into a bit array of about twice their
number; a key alone on its bit keeps it, the others go on to the next level. A key's index is the rank
of its bit among all set bits, so n keys have the indexes 0 to n-1. Foreign keys get -1 or a wrong
index: the caller compares a fingerprint stored under it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from formicary.llm.wordhash import mix

GAMMA = 2.0
LEVELS = 64


@dataclass
class PerfectHash:
    sizes: list[int] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    ranks: list[np.ndarray] = field(default_factory=list)
    n: int = 0

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys ^ np.uint64((0xA0761D6478BD642F * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct uint64 keys."""
        out, left = cls(), keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(-(-size // 64) * 64, np.uint8)
            flags[at[alone]] = 1
            bits = np.packbits(flags, bitorder="little").view(np.uint64)
            ranks = (out.n + np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))[:-1]])).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)
            out.sizes.append(size)
            out.bits.append(bits)
            out.ranks.append(ranks)
            out.n += int(alone.sum())
            left = left[~alone]
        if len(left):
            raise ValueError(f"{len(left)} keys are left after {LEVELS} levels: they aren't distinct")
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(todo):
                break
            at = self._place(keys[todo], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[todo[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        return found

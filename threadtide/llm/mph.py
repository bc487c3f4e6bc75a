"""Minimal perfect hashing of sets of 64-bit keys: a key's slot in one array without storing the keys.

Level by level, keys are hashed into a bit array of twice their number; a place that exactly one key hits is that
key's, and the rest go on to the next level (Limasset et al. 2017). The slot is the rank of the place among all set
bits, so n keys have the slots 0 to n - 1, and a look costs a few array reads whatever n is.
"""

from __future__ import annotations

import numpy as np

from threadtide.llm.textkit import mix64

#: Bits per key that is left at a level.
GAMMA = 2.0
MAX_LEVELS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys ^ mix64(np.array([level + 1], np.uint64) * _STEP)) % np.uint64(bits)).astype(np.int64)


class Mph:
    """Slots of a fixed set of distinct keys. Keys outside the set get -1 or the slot of some member: compare what is stored there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of 64 bits
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            before = np.concatenate(([0], np.cumsum(ones)))
            self.ranks.append(base + before[:-1])
            base += int(before[-1])
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        keys, levels = np.asarray(keys, np.uint64), []
        while len(keys):
            if len(levels) == MAX_LEVELS:
                raise ValueError("the keys of a minimal perfect hash must be distinct")
            bits = max(64, -(-int(GAMMA * len(keys)) // 64) * 64)
            at = _places(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _places(keys[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(words.astype("<u8").tobytes() for words in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Mph:
        count = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", count, 4).astype(np.int64)
        words, at = [], 4 + 4 * count
        for size in sizes:
            words.append(np.frombuffer(raw, "<u8", int(size), at))
            at += 8 * int(size)
        return cls(words)

"""A minimal perfect hash over 128-bit keys with fingerprint and value arrays, in numpy.

Levels of bit arrays: a key is settled at the first level where no other remaining key
shares its bit; its number is the count of set bits before its own. About three bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(a ^ mix(b + seed)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Built from distinct ``(a, b)`` pairs of unsigned 64-bit numbers."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.n = int(counts.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> MinimalPerfectHash:
        sizes, words = [], []
        while len(a):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("the keys are not distinct")
            size = -(-max(64, int(GAMMA * len(a))) // 64) * 64
            place = _place(a, b, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[place]
            a, b = a[rest], b[rest]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers from 0 to n - 1; -1, or any number, for keys that were not built in."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            place = _place(a[todo], b[todo], level, size)
            word, bit = base + (place >> 6), (place & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit & np.uint64(1)).astype(bool)
            below = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
            base += size >> 6
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        (n,) = struct.unpack_from("<I", data)
        return cls(list(struct.unpack_from(f"<{n}Q", data, 4)), np.frombuffer(data, "<u8", offset=4 + 8 * n))

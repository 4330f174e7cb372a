"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

A word is a run of ASCII letters, ASCII digits, underscores and non-ASCII characters in the
lower-cased text. A shingle is ``k`` words in a row; a text of fewer words, but
at least one, has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from .mph import mix

SHINGLE = 5
#: Bytes hashed at once; longer words take another hash.
_SPAN = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (int(_BASE), pow(int(_BASE), -1, 2**64)):
            steps = np.full(_SPAN, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


@dataclass
class Words:
    """Words of ``n`` texts in order: their text's number, hash and bytes' place in ``buffer``; ``first[i]`` is text i's first word."""

    n: int
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    buffer: bytes

    def text(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


def split(texts: list[str]) -> Words:
    """Words of the lower-cased texts."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buffer = b"\n".join([b"", *encoded, b""])
    data = np.frombuffer(buffer, np.uint8)
    inside = _IS_WORD[data].view(np.int8)
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    heads = np.cumsum([1, *(len(e) + 1 for e in encoded)])  # where each text begins
    first = np.searchsorted(start, heads)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(len(texts), doc, _hashes(data, buffer, start, end), start, end, first, buffer)


def _hashes(data: np.ndarray, buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + _SPAN, side="right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(buffer[start[i] : end[i]])
            i += 1
            continue
        at = start[i]
        span = data[at : end[j - 1]].astype(np.uint64)
        span += np.uint64(1)
        span *= power[: len(span)]
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(span, out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _factor(k: int) -> np.uint64:
    return np.uint64(pow(0xA0761D6478BD642F, 2 * k + 1, 2**64))


@dataclass
class Shingles:
    """Shingles in the texts' order: text number, hash, and the number of the first word among all words."""

    doc: np.ndarray
    hash: np.ndarray
    word: np.ndarray


def shingles(words: Words, k: int = SHINGLE) -> Shingles:
    h, doc = words.hash, words.doc
    n = len(h) - k + 1
    if n > 0:
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += h[j : j + n] * _factor(j)
        whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
        full_hash, full_word = mix(total[whole]), whole
    else:
        full_hash, full_word = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(words.first)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = counts[few] > j
            short[has] += h[words.first[few[has]] + j] * _factor(j)
        short = mix(short + counts[few].astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
        at = np.concatenate([full_word, words.first[few]])
        order = np.argsort(at, kind="stable")
        at, value = at[order], np.concatenate([full_hash, short])[order]
    else:
        at, value = full_word, full_hash
    return Shingles(doc[at], value, at)

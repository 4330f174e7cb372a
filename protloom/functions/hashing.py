"""64-bit k-mer hashes (MurmurHash3 x64-128, lower half) over whole arrays, and unsigned arithmetic on signed columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _finish(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def murmur(keys: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Hashes of the rows of an ``(n, k)`` array of bytes."""
    n, k = keys.shape
    words = np.zeros((n, -(-k // 16) * 16 if k else 0), np.uint8)
    words[:, :k] = keys
    words = words.view("<u8")
    with np.errstate(over="ignore"):
        a = np.full(n, seed, np.uint64)
        b = a.copy()
        for block in range(k // 16):
            low, high = words[:, 2 * block], words[:, 2 * block + 1]
            a = (_rotl(a ^ _rotl(low * _C1, 31) * _C2, 27) + b) * np.uint64(5) + np.uint64(0x52DCE729)
            b = (_rotl(b ^ _rotl(high * _C2, 33) * _C1, 31) + a) * np.uint64(5) + np.uint64(0x38495AB5)
        rest = k % 16
        if rest > 8:
            b = b ^ _rotl(words[:, -1] * _C2, 33) * _C1
        if rest:
            a = a ^ _rotl(words[:, -2] * _C1, 31) * _C2
        a, b = a ^ np.uint64(k), b ^ np.uint64(k)
        a = a + b
        b = b + a
        return _finish(a) + _finish(b)


def murmur_words(words: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Hashes of keys of ``k`` bytes, 8 at most, each given as a little-endian number."""
    with np.errstate(over="ignore"):
        b = np.uint64(seed) ^ np.uint64(k)
        a = (_rotl(words * _C1, 31) * _C2 ^ b) + b
        return _finish(a) + _finish(a + b)


#: Keys of a table of all possible keys, at most.
_TABLE = 1 << 18
#: Windows of up to 8 bytes that are hashed at once: their numbers stay in a core's cache.
_CACHED = 1 << 14


def murmur_windows(data: np.ndarray, k: int, step: int = 1 << 18) -> np.ndarray:
    """Hashes of all windows of ``k`` bytes. Where few symbols leave few possible windows, each is hashed once."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    symbols = np.flatnonzero(np.bincount(data, minlength=256)).astype(np.uint8)
    base = len(symbols)
    if base**k <= min(n, _TABLE):
        dense, codes = np.zeros(256, np.int32), np.zeros(n, np.int32)
        dense[symbols] = np.arange(base)
        own = dense[data]
        for j in range(k):
            codes *= base
            codes += own[j : n + j]
        there = np.flatnonzero(np.bincount(codes, minlength=base**k))
        table = np.zeros(base**k, np.uint64)
        table[there] = murmur(symbols[there[:, None] // base ** np.arange(k - 1, -1, -1) % base])
        return table[codes]
    if k <= 8:
        out = np.empty(n, np.uint64)
        for at in range(0, n, _CACHED):
            wide = data[at : at + _CACHED + k - 1].astype(np.uint64)
            words = wide[: len(wide) - k + 1].copy()
            for j in range(1, k):
                words |= wide[j : len(words) + j] << np.uint64(8 * j)
            out[at : at + len(words)] = murmur_words(words, k)
        return out
    view = np.lib.stride_tricks.sliding_window_view(data, k)
    return np.concatenate([murmur(view[at : at + step]) for at in range(0, n, step)])


def mixed(hashed: np.ndarray, place: np.ndarray, factor: int) -> np.ndarray:
    """Another 64 bits of a hash and a number."""
    with np.errstate(over="ignore"):
        return _finish(hashed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(factor))


def max_hash(scaled: int) -> int:
    """The largest hash that is kept."""
    return 2**64 - 1 if scaled <= 1 else int(float(2**64 - 1) / scaled)


def unsigned(hashed: Column) -> Column:
    """The bits of a BIGINT as DECIMAL(20,0)."""
    wide = hashed.cast("decimal(20,0)")
    return F.when(hashed < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def unsigned_text(hashed: Column) -> Column:
    """The bits of a BIGINT as unsigned decimal text: of a number above 2^63, the text of its tens and its last digit, so that all stay BIGINT."""
    half = F.shiftrightunsigned(hashed, 1)
    last = half % 5 * 2 + hashed.bitwiseAND(F.lit(1).cast("long"))
    return F.when(hashed < 0, F.concat(F.call_function("div", half, F.lit(5).cast("long")).cast("string"), last.cast("string"))).otherwise(hashed.cast("string"))


def sortable(hashed: Column) -> Column:
    """A BIGINT that orders as the bits do unsigned."""
    return hashed.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def wrapped_sum_hex(hashed: Column) -> Column:
    """The sum of the hashes modulo 2^64 in hexadecimal, as an aggregate."""
    total = F.sum(unsigned(hashed).cast("decimal(38,0)")) % F.lit(str(2**64)).cast("decimal(38,0)")
    return F.lower(F.conv(total.cast("decimal(20,0)").cast("string"), 10, 16))


def sketch_md5(hashes: Column, ksize: int) -> Column:
    """Digest of the nucleotide k-mer size and the ascending hashes in decimal; ``hashes`` is an array of BIGINT."""
    return F.md5(F.concat(F.lit(str(3 * ksize)), F.array_join(F.transform(F.array_sort(F.transform(hashes, unsigned)), lambda x: x.cast("string")), "")).cast("binary"))

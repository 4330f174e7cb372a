"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact verification.

Texts and items become five-word shingles. For every length class of items (their number
of shingles) each window of so many shingles of a document gets a 64-bit SimHash from running sums
of bit counts. Fingerprints within ``RADIUS`` of an item's must agree with it in one of four
16-bit blocks up to ``RADIUS // 4`` bits; posting lists from all such block values to items find every one of them. A candidate is then
verified by the weighted Jaccard similarity of the two multisets of shingles, weights
falling with the number of items that hold a shingle; ``THRESHOLD`` or more is a match. Every window that holds a
shingle of an item of its length is fingerprinted; all others have similarity 0 with those items. Around a candidate, up to
its own length away, every place is bounded by running sums of weights, and verified where the bound reaches the threshold. A
document shorter than an item is one window.

The items are searched in blocks of ``ITEM_BLOCK``, each with tables of bounded size; weights count the items of the whole
benchmark, so that results do not depend on blocks. With several blocks all documents are read once, past a Bloom filter of the items' shingles,
and only those that may hold one are searched block by block.

Defined results: null and empty texts and items match nothing; texts of any length are searched whole; an item of fewer than five words is one shingle
and matches only documents of exactly its words; a document given several times matches each time; of several windows the most
similar is reported, then the first; empty tables give no match; further columns are carried along by ``with_matches``
in a struct, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._arrow import steps, texts
from ._store import saved, table
from .mph import mix

RADIUS = 15
THRESHOLD = 0.8
ITEM_BLOCK = 4096
#: Bits of the filter of all items' shingles, in powers of two: for each shingle, and at most in all (32 MB).
SIEVE_BITS, SIEVE_MOST = 5, 28
_BLOCKS, _BITS = 4, 16
_SPAN = 4096


#: Running sums of weights differ from sums of their own by less.
_SLACK = 1e-9


@dataclass
class Item:
    """One benchmark item: distinct shingles (ascending), their counts and weights."""

    item_id: int
    shingles: np.ndarray
    counts: np.ndarray
    weights: np.ndarray
    n: int
    fingerprint: int


def window_counts(hashes: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the bits of ``hashes``: row i holds those of the first i, 64 lanes wide enough for ``longest``.

    Lanes are added as parts of wider words; carries between them cancel in the difference of two
    rows at most ``longest`` apart.
    """
    lane = np.uint8 if longest < 2**8 else np.uint16 if longest < 2**16 else np.uint32
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(lane, copy=False)
    sums = np.zeros((len(hashes) + 1, 64 * np.dtype(lane).itemsize // 8), np.uint64)
    np.cumsum(bits.view(np.uint64), axis=0, out=sums[1:])
    return sums, lane


class Buffers:
    """Memory for the windows of one span, kept from run to run."""

    def __init__(self) -> None:
        self.counts, self.set = np.zeros(0, np.uint64), np.zeros(0, bool)

    def of(self, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.counts) < n * words:
            self.counts = np.empty(n * words, np.uint64)
        if len(self.set) < n * 64:
            self.set = np.empty(n * 64, bool)
        return self.counts[: n * words].reshape(n, words), self.set[: n * 64].reshape(n, 64)


def fingerprints(sums: np.ndarray, lane: type, n: int, first: int = 0, step: int = 1, buffers: Buffers | None = None) -> np.ndarray:
    """SimHash of windows of ``n``: a bit is set where more than half of the shingles set it."""
    ends, starts = sums[n + first :: step], sums[first : len(sums) - n : step]
    counts, is_set = (buffers or Buffers()).of(len(ends), sums.shape[1])
    np.subtract(ends, starts, out=counts)
    np.greater(counts.view(lane), n // 2, out=is_set)
    return np.packbits(is_set.reshape(-1), bitorder="little").view("<u8")


def simhash(hashes: np.ndarray) -> int:
    sums, lane = window_counts(hashes, len(hashes))
    return int(fingerprints(sums, lane, len(hashes))[0])


def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` (ascending, not empty), and whether the value is there."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return at, known[at] == values


def near_values(value: int, radius: int) -> np.ndarray:
    """All 16-bit values within ``radius`` bits of ``value``."""
    every = np.arange(1 << _BITS)
    return every[np.bitwise_count(every ^ value) <= radius]


def _merged(first: np.ndarray, last: np.ndarray, of: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ascending ranges from ``first`` to ``last``, joined where they meet (and are ``of`` the same)."""
    if not len(first):
        return iter(())
    new = first[1:] > last[:-1] + 1
    if of is not None:
        new |= of[1:] != of[:-1]
    cuts = np.flatnonzero(new)
    return zip(first[np.append(0, cuts + 1)].tolist(), last[np.append(cuts, len(last) - 1)].tolist(), strict=True)


@dataclass
class Held:
    """Of a whole benchmark, shingles that two items or more hold (ascending), by how many each, and the number of items with shingles."""

    shingles: np.ndarray
    counts: np.ndarray
    n_items: int
    n_shingles: int

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """Weights of shingles, of which one that no item holds counts as held by one."""
        out = np.full(len(hashes), math.log(1 + self.n_items))
        if len(self.shingles):
            at, same = _find(self.shingles, hashes)
            out[same] = np.log(1 + self.n_items / self.counts[at[same]])
        return out


def _shingles_of(items: list[tuple[int, str]]) -> list[np.ndarray]:
    own = _words.shingles(_words.split([t if t is not None else "" for _, t in items]))
    cuts = np.searchsorted(own.doc, np.arange(len(items) + 1))
    return [own.hash[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def held_by(blocks: Iterable[list[tuple[int, str]]]) -> Held:
    """Counts over all blocks of a benchmark."""
    known, counts, n_items = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for items in blocks:
        each = [np.unique(h) for h in _shingles_of(items)]
        n_items += sum(len(h) > 0 for h in each)
        every, place = np.unique(np.concatenate([known, *each]), return_inverse=True)
        n = np.bincount(place[len(known) :], minlength=len(every))
        n[place[: len(known)]] += counts
        known, counts = every, n
    return Held(known[counts > 1], counts[counts > 1], n_items, len(known))


class Sieve:
    """A Bloom filter: tells of texts that they hold no shingle of any item."""

    def __init__(self, n: int):
        self.bits = min(SIEVE_MOST, max(16, (max(1, n) - 1).bit_length() + SIEVE_BITS))
        self.table = np.zeros(1 << self.bits - 3, np.uint8)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        other = mix(hashes)
        for k in range(4):
            yield (hashes + np.uint64(k) * other) >> np.uint64(64 - self.bits)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, rows: list[str]) -> np.ndarray:
        own = _words.shingles(_words.split(rows))
        hit = np.ones(len(own.hash), bool)
        for at in self._places(own.hash):
            hit &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return np.bincount(own.doc[hit], minlength=len(rows)) > 0


class Index:
    """Items by length class, with the multi-index tables of each class."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, threshold: float = THRESHOLD, held: Held | None = None):
        self.radius, self.threshold = radius, threshold
        self.weights = (held_by([items]) if held is None else held).weights
        self.classes: dict[int, list[Item]] = {}
        for (item_id, _), h in zip(items, _shingles_of(items), strict=True):
            if len(h):
                distinct, counts = np.unique(h, return_counts=True)
                self.classes.setdefault(len(h), []).append(Item(item_id, distinct, counts, self.weights(distinct), len(h), simhash(h)))
        self.longest = max(self.classes, default=0)
        # for each block the values that some item of the class is near to, and, by value, the items
        self.tables: dict[int, np.ndarray] = {}
        self.postings: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, members in self.classes.items():
            marks, lists = np.zeros((_BLOCKS, 1 << _BITS), bool), []
            for b in range(_BLOCKS):
                near = [near_values(item.fingerprint >> _BITS * b & 0xFFFF, radius // _BLOCKS).astype(np.uint16) for item in members]
                value, item = np.concatenate(near), np.repeat(np.arange(len(members), dtype=np.int32), [len(x) for x in near])
                order = np.argsort(value, kind="stable")
                marks[b, value] = True
                lists.append((value[order], item[order]))
            self.tables[n], self.postings[n] = marks, lists
        # a shingle's leading bits tell whether some item may hold it
        self.held = {n: np.unique(np.concatenate([i.shingles for i in members])) for n, members in self.classes.items()}
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held.values()]))
        self.shift = np.uint64(64 - max(16, len(every).bit_length() + 4))
        self.may_hold = np.zeros(1 << 64 - int(self.shift), bool)
        self.may_hold[every >> self.shift] = True
        self.prints = {n: np.array([i.fingerprint for i in members], np.uint64) for n, members in self.classes.items()}

    def near(self, n: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``found`` and members of class ``n`` within the radius of each other."""
        parts = found.view("<u2").reshape(-1, _BLOCKS)
        rows, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b, (values, items) in enumerate(self.postings[n]):
            at = np.flatnonzero(self.tables[n][b][parts[:, b]])
            if not len(at):
                continue
            first, last = (np.searchsorted(values, parts[at, b], side=side) for side in ("left", "right"))
            size = last - first
            row = np.repeat(at, size)
            member = items[np.arange(len(row)) - np.repeat(np.cumsum(size) - size - first, size)]
            close = np.bitwise_count(found[row] ^ self.prints[n][member]) <= self.radius
            rows.append(row[close])
            members.append(member[close])
        pairs = np.unique(np.concatenate(rows) * len(self.prints[n]) + np.concatenate(members))
        return pairs // len(self.prints[n]), pairs % len(self.prints[n])

    def bounds(self, item: Item, hashes: np.ndarray, n: int) -> np.ndarray:
        """The most that the similarity of each window of ``n`` can be: that of windows without repeated shingles."""
        same, weights = _find(item.shingles, hashes)[1], self.weights(hashes)
        shared = np.append(0.0, np.cumsum(np.where(same, weights, 0.0)))
        all_ = np.append(0.0, np.cumsum(weights))
        own = float((item.counts * item.weights).sum())
        both = np.minimum(shared[n:] - shared[:-n], own)
        return both / (own + all_[n:] - all_[:-n] - both)

    def similarity(self, item: Item, hashes: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window's shingles."""
        distinct, counts = np.unique(hashes, return_counts=True)
        place, same = _find(item.shingles, distinct)
        k = place[same]
        weight = item.weights[k]
        both = float((np.minimum(counts[same], item.counts[k]) * weight).sum())
        all_ = float((item.counts * item.weights).sum()) + float((counts[same] * weight).sum()) + float((counts[~same] * self.weights(distinct[~same])).sum()) - both
        return both / all_

    def matches(self, rows: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """For each text ``(item_id, similarity, first word, number of shingles)``, one for each item that matches."""
        out: list[list] = [[] for _ in rows]
        if not self.classes:
            return out
        words = _words.split(rows)
        own = _words.shingles(words)
        h, doc = own.hash, own.doc
        size = np.bincount(doc, minlength=len(rows)) if len(doc) else np.zeros(len(rows), int)
        begin = np.cumsum(size) - size
        best: dict[tuple[int, int], tuple[float, int, int]] = {}

        def verify(d: int, item: Item, low: int, high: int, n: int) -> None:
            bound = self.bounds(item, h[low : high + n], n)
            places = np.flatnonzero(bound >= self.threshold - _SLACK)
            key = (d, item.item_id)
            for k in places[np.argsort(-bound[places], kind="stable")].tolist():
                place = low + k
                if key in best and (bound[k] < best[key][0] - _SLACK or (bound[k] < best[key][0] + _SLACK and place >= best[key][1])):
                    continue
                value = self.similarity(item, h[place : place + n])
                if self.threshold - _SLACK <= value < self.threshold:
                    value = self.threshold  # but for rounding
                if value >= self.threshold and (key not in best or (value, -place) > (best[key][0], -best[key][1])):
                    best[key] = (value, place, n)

        buffers = Buffers()
        hits = np.flatnonzero(self.may_hold[h >> self.shift])
        for n, members in self.classes.items():
            at = hits[_find(self.held[n], h[hits])[1]]
            low, end = begin[doc[at]], begin[doc[at]] + size[doc[at]] - n
            short = np.unique(doc[at[end < low]])
            # runs of windows that hold a hit and lie in its text
            first, last = np.maximum(at - n + 1, low), np.minimum(at, end)
            first, last = first[end >= low], last[end >= low]
            places, found = [], []
            for a, b in _merged(first, last):
                for s in range(a, b + 1, _SPAN):
                    e = min(b + 1, s + _SPAN)
                    place, member = self.near(n, fingerprints(*window_counts(h[s : e - 1 + n], n), n, buffers=buffers))
                    if len(place):
                        places.append(s + place)
                        found.append(member)
            if places:
                place, member = np.concatenate(places), np.concatenate(found)
                for m in np.unique(member).tolist():
                    p = place[member == m]
                    low = begin[doc[p]]
                    for a, b in _merged(np.maximum(p - n, low), np.minimum(p + n, low + size[doc[p]] - n), doc[p]):
                        verify(int(doc[a]), members[m], a, b, n)
            # texts shorter than an item are windows of their own
            for d in short.tolist():
                a, m = int(begin[d]), int(size[d])
                for k in self.near(n, np.array([simhash(h[a : a + m])], "<u8"))[1].tolist():
                    verify(d, members[k], a, a, m)
        for (d, item_id), (value, place, n) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
            out[d].append((item_id, value, int(own.word[place] - words.first[d]), n))
        return out


MATCH = "item_id long, similarity double, first_word long, n_shingles int"


def item_blocks(benchmark: DataFrame, item_block: int = ITEM_BLOCK, text_col: str = "text", id_col: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number at a time."""
    block = []
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == item_block:
            yield block
            block = []
    if block:
        yield block


_KEYS = ("r1", "r2")


def _opened(spark: SparkSession, items: list, held: Held, radius: int, threshold: float) -> Callable[[], Index]:
    """A function that gives a worker the block's index, made once; a block goes to the executors once, at most ``ITEM_BLOCK`` items."""
    told = spark.sparkContext.broadcast((items, held))
    kept: list[Index] = []

    def index() -> Index:
        if not kept:
            kept.append(Index(told.value[0], radius, threshold, told.value[1]))
        return kept[0]

    return index


def _rows(docs: DataFrame, text_col: str, id_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.xxhash64(text, F.lit(5)).alias("r1"), F.xxhash64(F.lit(6), text).alias("r2"), text.alias("text"))


def sieved(rows: DataFrame, benchmark_blocks: Iterable[list], n_shingles: int) -> DataFrame:
    """The rows that may hold a shingle of some item."""
    sieve = Sieve(n_shingles)
    for items in benchmark_blocks:
        for h in _shingles_of(items):
            sieve.add(h)
    told = rows.sparkSession.sparkContext.broadcast(sieve)  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                yield part.filter(pa.array(told.value.may_hold(texts(part))))

    return saved(rows.mapInArrow(run, rows.schema), "sieved")[0]


def found_in(rows: DataFrame, index: Callable[[], Index]) -> DataFrame:
    """``doc_id, r1, r2`` and the match, a row for each match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                keys = zip(*(part.column(c).to_pylist() for c in ("doc_id", *_KEYS)), strict=True)
                found = [(*key, *m) for key, own in zip(keys, index().matches(texts(part)), strict=True) for m in own]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(),) * 4 + (pa.float64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", *_KEYS, "item_id", "similarity", "first_word", "n_shingles"])

    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, " + MATCH)


def _by_blocks(rows: DataFrame, benchmark: DataFrame, held: Held, item_block: int, radius: int, threshold: float) -> DataFrame:
    """``found_in`` for all blocks of a benchmark."""
    spark = rows.sparkSession
    if held.n_items > item_block:
        rows = sieved(rows, item_blocks(benchmark, item_block), held.n_shingles)
    out = spark.createDataFrame([], "doc_id long, r1 long, r2 long, " + MATCH)
    for items in item_blocks(benchmark, item_block):
        out = out.unionByName(found_in(rows, _opened(spark, items, held, radius, threshold)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, radius: int = RADIUS, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_shingles``: a row for each document and item that match."""
    held = held_by(item_blocks(benchmark, item_block))
    return _by_blocks(_rows(docs, text_col, id_col), benchmark, held, item_block, radius, threshold).drop(*_KEYS)


def with_matches(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, radius: int = RADIUS, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``doc``, the row as a struct, and ``matches``, an array of its matching items (empty where there is none)."""
    kind = f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"
    none = F.array().cast(kind)
    held = held_by(item_blocks(benchmark, item_block))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if held.n_items > item_block:
        found, _ = saved(_by_blocks(_rows(docs, text_col, None), benchmark, held, item_block, radius, threshold).distinct(), "matches")
        found = found.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct(*(x.split()[0] for x in MATCH.split(", "))))).alias("m"))
        named = docs.select(F.struct("*").alias("doc"), F.xxhash64(text, F.lit(5)).alias("r1"), F.xxhash64(F.lit(6), text).alias("r2"))
        return named.join(found, list(_KEYS), "left").select("doc", F.coalesce("m", none).alias("matches"))
    blocks = list(item_blocks(benchmark, item_block))  # one block at most, but for items without a shingle
    if not held.n_items:
        return docs.select(F.struct("*").alias("doc"), none.alias("matches"))
    index = _opened(docs.sparkSession, [x for block in blocks for x in block if x[1]], held, radius, threshold)

    @F.pandas_udf(kind)
    def find(batch):  # noqa: ANN001, ANN202
        import pandas as pd

        found, at, rows = [], 0, batch.tolist()
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size < 2 << 20):
                size += len(rows[end])
                end += 1
            found += index().matches(rows[at:end])
            at = end
        return pd.Series([[dict(zip(("item_id", "similarity", "first_word", "n_shingles"), m, strict=True)) for m in own] for own in found])

    return docs.select(F.struct("*").alias("doc"), find(text).alias("matches"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

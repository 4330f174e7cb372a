"""Records of each hash, sorted by hash and record, of sequences and of postings that are there already.

A row for each posting takes more in a shuffle than the sequences themselves ten times over. So a task sorts some millions of postings, and hands on a block of bytes for each range of hashes: steps
from hash to hash, the number of records of each, and records and occurrences in as few bytes as the block's largest needs. The task that gets a range's blocks
takes them apart slice by slice, so that it never holds more than ``TAKEN`` rows as such, also where a single hash has more.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from . import kmers as km

BLOCKS = "part int, range int, first long, block binary"
POSTINGS = "bucket int, id long, hashval long, abund long"
#: Postings that a task sorts at once, and that it takes apart at once, some 60 bytes each.
HELD, TAKEN = 3 << 21, 1 << 22
#: Records whose blocks of a range go to one task: a very common hash has them all.
RECORDS = 1 << 25
_HEAD = struct.Struct("<QqQ4BQ")
_ALL = 1 << 64


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    """The lowest bytes of unsigned numbers, as many as the largest needs: first the lowest of all, then the next."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return width, np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(data: np.ndarray, width: int, n: int, a: int = 0, z: int | None = None) -> np.ndarray:
    """The numbers ``a`` to ``z`` of ``n`` packed ones."""
    planes, z = data[: width * n].reshape(width, n), n if z is None else z
    out = np.zeros((z - a, 8), np.uint8)
    out[:, :width] = planes[:, a:z].T
    return out.view("<u8").ravel()


def _block(hashed: np.ndarray, ids: np.ndarray, abund: np.ndarray) -> bytes:
    """Some postings in order, at least one."""
    first = np.flatnonzero(km._changes(hashed))
    names, base = hashed[first], int(ids.min())
    own = [_packed(x) for x in (np.diff(names), np.diff(np.append(first, len(hashed))) - 1, ids - base, abund - 1)]
    return _HEAD.pack(len(names), base, int(names[0]), *(w for w, _ in own), len(hashed)) + b"".join(x for _, x in own)


class _Read:
    """A block whose hashes are unpacked."""

    def __init__(self, block: bytes):
        kinds, self.base, start, *widths, self.n = _HEAD.unpack_from(block)
        data = np.frombuffer(block, np.uint8)[_HEAD.size :]
        sizes = (kinds - 1, kinds, self.n, self.n)
        ends = np.cumsum([0, *(w * n for w, n in zip(widths, sizes, strict=True))])
        parts = [data[a:z] for a, z in zip(ends, ends[1:], strict=False)]
        with np.errstate(over="ignore"):
            self.names = np.cumsum(np.append(np.uint64(start), _unpacked(parts[0], widths[0], kinds - 1)), dtype=np.uint64)
        self.first = np.append(0, np.cumsum(_unpacked(parts[1], widths[1], kinds).astype(np.int64) + 1))
        self._ids, self._abund = (parts[2], widths[2]), (parts[3], widths[3])

    def upto(self, hashed: int) -> int:
        """How many postings have a smaller hash."""
        return self.n if hashed >= _ALL else int(self.first[np.searchsorted(self.names, np.uint64(hashed))])

    def ids(self, a: int, z: int) -> np.ndarray:
        return _unpacked(*self._ids, self.n, a, z).astype(np.int64) + self.base

    def rows(self, a: int, z: int) -> tuple[np.ndarray, ...]:
        u, v = np.searchsorted(self.first, [a, z - 1], "right") - 1
        size = np.diff(np.clip(self.first[u : v + 2], a, z))
        return np.repeat(self.names[u : v + 1], size), self.ids(a, z), _unpacked(*self._abund, self.n, a, z).astype(np.int64) + 1


def _in_order(columns: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Parts of hashes, records and occurrences as one, by hash and record. The parts' lists are emptied, so that no column is held twice for long."""
    hashed, ids, abund = (_taken(x) for x in columns)
    order = np.argsort(hashed, kind="stable")
    hashed, ids = hashed[order], ids[order]
    if ((ids[1:] < ids[:-1]) & (hashed[1:] == hashed[:-1])).any():
        again = np.lexsort((ids, hashed))
        ids, order = ids[again], order[again]
    return hashed, ids, abund[order]


def _taken(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts)
    parts.clear()
    return out


def _merged(blocks: list[_Read], lo: int, hi: int, held: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, record and occurrences of the postings with hashes from ``lo`` to below ``hi``, in order, at most ``held`` at once."""
    spans = [(b, a, z) for b in blocks if (a := b.upto(lo)) < (z := b.upto(hi))]
    n = sum(z - a for _, a, z in spans)
    if n > held and hi - lo > 1:
        for a, z in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
            yield from _merged([b for b, _, _ in spans], a, z, held)
    elif n:
        yield from _of_ids(spans, held)


def _of_ids(spans: list[tuple[_Read, int, int]], held: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same of some rows of blocks; those of one hash, if there are more than ``held``, by halves of their records."""
    if sum(z - a for _, a, z in spans) <= held:
        yield _in_order([list(x) for x in zip(*(b.rows(a, z) for b, a, z in spans), strict=True)])
        return
    ids = [b.ids(a, z) for b, a, z in spans]  # ascending, as they are of one hash
    low, high = min(int(x[0]) for x in ids), max(int(x[-1]) for x in ids)
    middle = [a + int(np.searchsorted(x, low + (high - low + 1) // 2)) for x, (_, a, _) in zip(ids, spans, strict=True)]
    del ids
    for half in ([(b, a, m) for (b, a, _), m in zip(spans, middle, strict=True)], [(b, m, z) for (b, _, z), m in zip(spans, middle, strict=True)]):
        if own := [x for x in half if x[1] < x[2]]:
            yield from _of_ids(own, held)


def cut(hashed: np.ndarray, ids: np.ndarray, abund: np.ndarray, bits: int, split: int = 1) -> pa.RecordBatch:
    """Blocks of some postings in order, one for each range of hashes."""
    of = (hashed >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashed), np.int32)
    ends = np.append(np.flatnonzero(km._changes(of)), len(of))
    blocks = [_block(hashed[a:z], ids[a:z], abund[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    own, first = of[ends[:-1]], int(ids.min())
    return pa.RecordBatch.from_arrays([pa.array(own * split + hash(first) % split, pa.int32()), pa.array(own, pa.int32()), pa.array([first] * len(own), pa.int64()), pa.array(blocks, pa.binary())], ["part", "range", "first", "block"])


def _handed_on(found: Iterator[tuple[np.ndarray, ...]], bits: int, split: int, held: int, part: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings that come; records that differ in more than ``part`` bits are set apart, if there are many, as steps between them are wide."""
    columns: list[list[np.ndarray]] = [[], [], []]
    size = last = 0
    for own in found:
        if size and (size + len(own[0]) > held or part and size > held // 8 and last >> part != own[1][0] >> part):
            yield cut(*_in_order(columns), bits, split)
            size = 0
        for column, x in zip(columns, own, strict=True):
            column.append(x)
        size += len(own[0])
        last = own[1][-1] if len(own[1]) else last
    if size:
        yield cut(*_in_order(columns), bits, split)


def _inside(hashed: np.ndarray, bits: int, within: range) -> np.ndarray:
    """Which hashes lie in some ranges."""
    return (hashed >> np.uint64(64 - bits)) - np.uint64(within.start) < np.uint64(len(within)) if bits else np.ones(len(hashed), bool)  # below the first, the number wraps


def blocks_of(sequences: DataFrame, ksize: int, moltype: str, scaled: int, bits: int, split: int = 1, held: int = HELD, part: int = 0, within: range | None = None) -> DataFrame:
    """Blocks of the sketches of ``id, name, sequence`` rows; ``bits`` of a hash name its range, and its blocks go to ``split`` parts. With ``within``, other ranges are left out."""
    lookup, limit = km._lookup(moltype), hashing.max_hash(scaled)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, owner, hashed, abund, _ in km._counted(batch, ksize, lookup, limit):
                own = ids[rows][owner]
                if within is not None:
                    here = _inside(hashed, bits, within)
                    hashed, own, abund = hashed[here], own[here], abund[here]
                for a in range(0, len(own), held):
                    yield hashed[a : a + held], own[a : a + held], abund[a : a + held]

    return km.named(sequences).mapInArrow(lambda batches: _handed_on(found(batches), bits, split, held, part), BLOCKS)


def blocks_again(postings: DataFrame, bits: int, split: int = 1, held: int = HELD, within: range | None = None) -> DataFrame:
    """Blocks of ``id, hashval, abund`` rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("hashval", "id", "abund")]
            own[0] = own[0].view(np.uint64)
            if within is not None:
                here = _inside(own[0], bits, within)
                own = [x[here] for x in own]
            if len(own[0]):
                yield tuple(own)

    return postings.select("id", "hashval", "abund").mapInArrow(lambda batches: _handed_on(found(batches), bits, split, held, 0), BLOCKS)


def steps(n: int, scaled: int, bits: int, at_once: int) -> list[range]:
    """The ranges of sampled hashes in groups of about ``at_once`` of ``n`` postings."""
    ranges = (hashing.max_hash(scaled) >> 64 - bits) + 1
    each = max(1, ranges // max(1, -(-n // at_once)))
    return [range(a, min(a + each, ranges)) for a in range(0, ranges, each)]


def merged(blocks: DataFrame, scaled: int, bits: int, folder_bits: int, split: int = 1, held: int = TAKEN) -> DataFrame:
    """``bucket, id, hashval, abund`` of blocks, in each task by hash and record; ``folder_bits`` of a hash, at least ``bits``, are its bucket."""

    def made(hashed: np.ndarray, ids: np.ndarray, abund: np.ndarray) -> tuple:
        bucket = (hashed >> np.uint64(64 - folder_bits)).astype(np.int32) if folder_bits else np.zeros(len(hashed), np.int32)
        return bucket, ids, hashed.view(np.int64), abund

    return _of_ranges(blocks, scaled, bits, split, held, made, POSTINGS)


def added_up(blocks: DataFrame, scaled: int, bits: int, held: int = TAKEN) -> DataFrame:
    """``hashval, abund, df`` of blocks that have numbers of records in the place of records: the sums of each hash."""

    def made(hashed: np.ndarray, df: np.ndarray, abund: np.ndarray) -> tuple:
        first = np.flatnonzero(km._changes(hashed))
        return hashed[first].view(np.int64), np.add.reduceat(abund, first), np.add.reduceat(df, first)

    return _of_ranges(blocks, scaled, bits, 1, held, made, "hashval long, abund long, df long")


def _of_ranges(blocks: DataFrame, scaled: int, bits: int, split: int, held: int, made: Callable[..., tuple], schema: str) -> DataFrame:
    """Rows made of the postings of each range, slice by slice."""
    names, width = [x.split()[0] for x in schema.split(", ")], 64 - bits

    def out(own: list[_Read], at: int) -> Iterator[pa.RecordBatch]:
        for found in _merged(own, at << width, at + 1 << width, held):
            columns = made(*found)
            for a in range(0, len(columns[0]), km._STEP):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + km._STEP]) for x in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[_Read] = []
        last = -1
        for batch in batches:
            for at, block in zip(batch.column("range").to_pylist(), batch.column("block"), strict=True):
                if at != last and own:
                    yield from out(own, last)
                    own = []
                last = at
                own.append(_Read(block.as_py()))
        if own:
            yield from out(own, last)

    ranges = ((hashing.max_hash(scaled) >> 64 - bits) + 1) * split
    return blocks.repartitionById(ranges, F.col("part")).sortWithinPartitions("range", "first").mapInArrow(run, schema)

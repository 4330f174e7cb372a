"""Positioned, hashed k-mers and per-sequence sketches.

Windows are cut, encoded, hashed and sampled inside one Arrow function, on arrays of bytes: a
k-mer that the sampling leaves out never becomes a row, and a sequence's sketch needs no shuffle, as a
sequence is one row. Sequences shorter than ``ksize`` have no k-mers. Sequences longer than a step are worked off in overlapping parts.
What is grouped inside a sequence (originals, positions, counts of a hash) is grouped in the same function, without a shuffle: windows are sorted by
hash and original, a long sequence's by slices of the hash range, so that all windows of a hash are in one slice.

Records are told apart by ``id``, a BIGINT column of the sequences; where there is none it is made of the name, so that records of one name are one.
``only``, a table with a ``hashval`` column, leaves out all other hashes where the sequence is read, if it has ``ONLY`` distinct ones at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet, hashing

KMERS = "id long, name string, start int, kmer string, encoded string, hashval long"
SKETCH = "id long, name string, hashval long, abund long"
SIGNATURES = "id long, name string, n_hashes long, occurrences long, pseudo_md5 string, md5 string"
CONTENTS = f"{SIGNATURES}, content string"
PROFILES = f"{SIGNATURES}, hits array<struct<hashval:long,abund:long>>"
INFOS = "id long, name string, hashval long, encoded string, kmer string, positions array<int>"
KMER_TEXTS = "name string, start long, kmer string, encoded string, hashval string"
INFO_TEXTS = "name string, hashval string, encoded string, kmer string, positions string"
NESTED = "id long, name string, hashval long, encoded string, originals map<string,array<int>>"
ORIGINALS = "id long, name string, hashval long, encoded string, n_originals long, occurrences long"
#: Residues in one step of a worker.
_STEP = 1 << 18
#: Residues of a task whose equal k-mers come together where all k-mers are the result, some 50 bytes each.
TOGETHER = 1 << 23
#: Hashes that a broadcast filter holds at most, 8 bytes each.
ONLY = 4_000_000


def _lookup(moltype: str) -> np.ndarray | None:
    table = alphabet.table_of(moltype)
    if table is None:
        return None
    out = np.arange(256, dtype=np.uint8)
    for letter, symbol in table.items():
        out[ord(letter)] = ord(symbol)
    return out


def _steps(batch: pa.RecordBatch, ksize: int, step: int = _STEP) -> Iterator[tuple[list[int], list[bytes], int, bool]]:
    """Rows of the batch with their sequences, the first's offset, and whether the row ends there: many whole sequences, or a part of a long one."""
    rows, sequences, size = [], [], 0
    for row, sequence in enumerate(batch.column("sequence")):
        own = (sequence.as_py() or "").encode()
        if len(own) > step:
            last = len(own) - ksize
            for at in range(0, last + 1, step):
                yield [row], [own[at : at + step + ksize - 1]], at, at + step > last
            continue
        rows.append(row)
        sequences.append(own)
        size += len(own)
        if size >= step:
            yield rows, sequences, 0, True
            rows, sequences, size = [], [], 0
    if rows:
        yield rows, sequences, 0, True


@dataclass
class Windows:
    """The windows that are kept: sequence number, start and hash of each, and where they stand in the bytes of all sequences."""

    owner: np.ndarray
    start: np.ndarray
    hashed: np.ndarray
    at: np.ndarray
    data: np.ndarray
    encoded: np.ndarray
    ksize: int

    def cut(self, data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Their bytes, or those of the windows at some places."""
        if len(data) < self.ksize:
            return np.zeros((0, self.ksize), np.uint8)
        return np.lib.stride_tricks.sliding_window_view(data, self.ksize)[self.at if at is None else at]


def _whole(size: np.ndarray, ksize: int) -> np.ndarray:
    """Where the windows begin that do not run over the end of their sequence, in the bytes of sequences of some sizes."""
    size = size[size > 0]  # an empty one has no bytes that end it; those at its place are of the next
    ends = np.cumsum(size)
    whole = np.ones(max(0, int(size.sum()) - ksize + 1), bool)
    over = (ends[:, None] - np.minimum(np.arange(1, ksize), size[:, None])).ravel()
    whole[over[over < len(whole)]] = False
    return np.flatnonzero(whole)


def _windows(sequences: list[bytes], ksize: int, lookup: np.ndarray | None, keep: Callable[[np.ndarray], np.ndarray]) -> Windows:
    size = np.array([len(s) for s in sequences], np.int64)
    data = np.frombuffer(b"".join(sequences), np.uint8)
    encoded = data if lookup is None else lookup[data]
    hashed, ends, at = hashing.murmur_windows(encoded, ksize), np.cumsum(size), _whole(size, ksize)
    kept = keep(hashed[at])
    at = at if kept.all() else at[kept]
    owner = np.repeat(np.arange(len(sequences)), size)[at]
    return Windows(owner, at - (ends - size)[owner], hashed[at], at, data, encoded, ksize)


def _strings(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)[: n + 1]), pa.py_buffer(np.ascontiguousarray(rows)))


def named(df: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """``id, name, sequence``."""
    label = F.col(name).cast("string")
    own = F.col("id").cast("long") if "id" in df.columns else F.xxhash64(label)
    return df.select(own.alias("id"), label.alias("name"), F.col(sequence).cast("string").alias("sequence"))


def broadcast_hashes(only: DataFrame | None):  # noqa: ANN201
    """The distinct hashes, ascending as unsigned numbers, as a broadcast variable; None if there are more than ``ONLY``."""
    if only is None:
        return None
    found = only.select("hashval").distinct().limit(ONLY + 1).toArrow().column("hashval").to_numpy().view(np.uint64)
    return only.sparkSession.sparkContext.broadcast(np.sort(found)) if len(found) <= ONLY else None


def _kept(limit: int, told) -> Callable[[np.ndarray], np.ndarray]:  # noqa: ANN001
    """Which hashes are sampled and, with a broadcast filter, in it."""

    def keep(hashed: np.ndarray) -> np.ndarray:
        out = hashed <= np.uint64(limit)
        if told is not None:
            out &= _in(told.value, hashed)
        return out

    return keep


def _in(known: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashed), bool)
    at = np.searchsorted(known, hashed)
    at[at == len(known)] = 0
    return known[at] == hashed


def kmer_positions(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", only: DataFrame | None = None, together: int | None = None) -> DataFrame:
    """``id, name, start, kmer, encoded, hashval``: a row for each sampled k-mer of prepared sequences; starts count from 0.

    Rows come by sequence and start. With ``together``, equal k-mers of up to so many residues of a task come one after the other, by encoded and original
    k-mer: for a table that is stored as a whole, whose files take less than half as much then.
    """
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], KMERS)
    lookup, keep = _lookup(moltype), _kept(hashing.max_hash(scaled), broadcast_hashes(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, own, offset, _ in _steps(batch, ksize, together or _STEP):
                w = _windows(own, ksize, lookup, keep)
                order = np.arange(len(w.at)) if together is None else _by_kmer(w)
                for a in range(0, len(order), _STEP):
                    part = order[a : a + _STEP]
                    of, at = pa.array(np.array(rows, np.int64)[w.owner[part]]), w.at[part]
                    raw = _strings(w.cut(w.data, at))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("name").take(of), pa.array(w.start[part] + offset, pa.int32()), raw, raw if lookup is None else _strings(w.cut(w.encoded, at)), pa.array(w.hashed[part].view(np.int64))], ["id", "name", "start", "kmer", "encoded", "hashval"])

    return named(sequences, name, sequence).mapInArrow(run, KMERS)


def _by_kmer(w: Windows) -> np.ndarray:
    """The windows' order by encoded and original k-mer, and of equal ones as they are."""
    own = _sortable(w.cut(w.data))
    return np.argsort(own, kind="stable") if w.encoded is w.data else np.lexsort((own, _sortable(w.cut(w.encoded))))


#: Distinct hashes or k-mers that a task adds up before it hands them on; up to three times as many are in memory while they are merged, some 80 bytes each.
_HELD = 1 << 20


def distinct_kmers(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, held: int = _HELD) -> DataFrame:
    """``encoded, hashval``: each sampled encoded k-mer of a collection once."""
    return kmers_of_tasks(sequences, ksize, moltype, scaled, held).distinct()


def kmers_of_tasks(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, held: int = _HELD) -> DataFrame:
    """``encoded, hashval``: each sampled encoded k-mer of a task once, or again after every ``held`` ones."""
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], "encoded string, hashval long")
    lookup, limit = _lookup(moltype), np.uint64(hashing.max_hash(scaled))

    def out(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), _STEP):
            rows = _residues(keys[at : at + _STEP], ksize)
            hashed = hashing.murmur(rows)
            here = hashed <= limit
            yield pa.RecordBatch.from_arrays([_strings(rows[here]), pa.array(hashed[here].view(np.int64))], ["encoded", "hashval"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = kept = 0
        for batch in batches:
            for _, own, _, _ in _steps(batch, ksize):
                data = np.frombuffer(b"".join(own), np.uint8)
                encoded = data if lookup is None else lookup[data]
                at = _whole(np.array([len(x) for x in own], np.int64), ksize)
                if not len(at):
                    continue
                parts.append(np.unique(_sortable(np.lib.stride_tricks.sliding_window_view(encoded, ksize)[at])))
                size += len(parts[-1])
                if size > max(held // 4, 2 * kept):  # merged again only when it has doubled
                    parts = [np.unique(np.concatenate(parts))]
                    size = kept = len(parts[0])
                    if kept > held:
                        yield from out(parts[0])
                        parts, size, kept = [], 0, 0
        if parts:
            yield from out(np.unique(np.concatenate(parts)))

    return named(sequences).mapInArrow(run, "encoded string, hashval long")


def _counted(batch: pa.RecordBatch, ksize: int, lookup: np.ndarray | None, limit: int, content: bool = False) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, the sampled hashes of these with their counts (row by row, ascending), and with ``content`` each row's sums of digests."""
    keep, parts, sums = _kept(limit, None), [], None
    for rows, own, offset, ends in _steps(batch, ksize):
        w = _windows(own, ksize, lookup, keep)
        owner, hashed = w.owner, w.hashed
        told = _digest_sums(w, offset, len(rows), lookup) if content else np.zeros((len(rows), 2), np.uint64)
        sums = told if sums is None else sums + told
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        each = [np.unique(hashed[a:b], return_counts=True) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h, _ in each])
        hashed, abund = np.concatenate([h for h, _ in each]), np.concatenate([n for _, n in each])
        if not ends or parts:  # a long sequence
            parts.append((hashed, abund))
            if not ends:
                continue
            hashed, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            abund = np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(hashed)).astype(np.int64)
            owner, parts = np.zeros(len(hashed), np.int64), []
        yield rows, owner, hashed, abund, sums
        sums = None


#: Odd factors, so that each start gives each hash another number.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _digest_sums(w: Windows, offset: int, n: int, lookup: np.ndarray | None) -> np.ndarray:
    """For each of ``n`` rows, the sums modulo 2^64 of two digests of its windows' residues and starts: whatever their order, equal windows give equal sums."""
    out = np.zeros((n, 2), np.uint64)
    if len(w.owner):
        raw = w.hashed if lookup is None else hashing.murmur_windows(w.data, w.ksize)[w.at]
        names, first = np.unique(w.owner, return_index=True)
        out[names] = np.stack([np.add.reduceat(hashing.mixed(raw, w.start + offset, f), first) for f in _FACTORS], 1)
    return out


def sketches(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", only: DataFrame | None = None) -> DataFrame:
    """``id, name, hashval, abund``: each sequence's sampled hashes and how often they occur in it."""
    lookup, limit, told = _lookup(moltype), hashing.max_hash(scaled), broadcast_hashes(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, owner, hashed, abund, _ in _counted(batch, ksize, lookup, limit):
                if told is not None:
                    here = _in(told.value, hashed)
                    owner, hashed, abund = owner[here], hashed[here], abund[here]
                of = pa.array(np.array(rows, np.int64)[owner])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("name").take(of), pa.array(hashed.view(np.int64)), pa.array(abund, pa.int64())], ["id", "name", "hashval", "abund"])

    return named(sequences, name, sequence).mapInArrow(run, SKETCH)


_PAIR = pa.struct([("hashval", pa.int64()), ("abund", pa.int64())])


def _measures(n: int, owner: np.ndarray, hashed: np.ndarray, abund: np.ndarray, ksize: int) -> tuple[np.ndarray, tuple]:
    """Where each row's hashes end, and each row's number of hashes, occurrences, pseudo-digest and digest."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    total = np.concatenate([[0], np.cumsum(abund)]).astype(np.int64)
    own = [hashed[ends[k] : ends[k + 1]] for k in range(n)]
    return ends, (np.diff(ends), total[ends[1:]] - total[ends[:-1]], [f"{int(x.sum(dtype=np.uint64)):x}" for x in own], [_sketch_digest(x, ksize) for x in own])


def _sketch_digest(hashed: np.ndarray, ksize: int) -> str:
    """``hashing.sketch_md5`` of ascending hashes, whose decimal texts Arrow writes one behind the other."""
    out = hashlib.md5(str(3 * ksize).encode(), usedforsecurity=False)
    for at in range(0, len(hashed), _STEP):
        text = pa.array(hashed[at : at + _STEP]).cast(pa.string())
        out.update(text.buffers()[2][: np.frombuffer(text.buffers()[1], np.int32)[len(text)]])
    return out.hexdigest()


def profiles(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", only: DataFrame | None = None, schema: str = PROFILES) -> DataFrame:
    """``id, name, n_hashes, occurrences, pseudo_md5, md5`` of each sequence's sketch, and ``hits`` or ``content`` if the schema has it, from one reading and without a shuffle.

    The measures are of the whole sketch, also where ``only`` leaves few ``hits``. A sequence without sampled k-mers has 0, 0, ``0``
    and the digest of the k-mer size alone. ``content`` is an order-free digest of 128 bits of the sampled k-mers with their starts: sums modulo 2^64 of two digests of each one's hash and start.
    """
    lookup, limit, told = _lookup(moltype), hashing.max_hash(scaled), broadcast_hashes(only)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, owner, hashed, abund, sums in _counted(batch, ksize, lookup, limit, "content" in names):
                ends, measures = _measures(len(rows), owner, hashed, abund, ksize)
                of = pa.array(rows)
                columns = [batch.column("id").take(of), batch.column("name").take(of), *(pa.array(x) for x in measures)]
                if "content" in names:
                    columns.append(pa.array([f"{a:016x}{b:016x}" for a, b in sums.tolist()]))
                if "hits" in names:
                    here = np.ones(len(hashed), bool) if told is None else _in(told.value, hashed)
                    offsets = np.concatenate([[0], np.cumsum(here)])[ends]
                    values = pa.StructArray.from_arrays([pa.array(hashed[here].view(np.int64)), pa.array(abund[here], pa.int64())], fields=list(_PAIR))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names)

    return named(sequences, name, sequence).mapInArrow(run, schema)


def signatures(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """``id, name, n_hashes, occurrences, pseudo_md5, md5`` of each sequence's sketch."""
    return profiles(sequences, ksize, moltype, scaled, name, sequence, schema=SIGNATURES)


def _sortable(raw: np.ndarray) -> np.ndarray:
    """Keys that order and tell apart the rows of an array of residues."""
    n, k = raw.shape
    if k > 8:
        return np.ascontiguousarray(raw).view(f"S{k}").ravel()
    words = np.zeros((n, 8), np.uint8)
    words[:, :k] = raw
    return words.view(">u8").ravel().astype(np.uint64)


def _residues(keys: np.ndarray, ksize: int) -> np.ndarray:
    """The rows that ``_sortable`` made these keys of."""
    return keys.view(np.uint8).reshape(len(keys), ksize) if keys.dtype != np.uint64 else np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(len(keys), 8)[:, :ksize])


def _slices(sequence: bytes, ksize: int, lookup: np.ndarray | None, limit: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, raw and encoded bytes, and hash of a long sequence's sampled windows, by slices of the hash range in ascending order."""
    data = np.frombuffer(sequence, np.uint8)
    encoded = data if lookup is None else lookup[data]
    raw, view = (np.lib.stride_tricks.sliding_window_view(x, ksize) for x in (data, encoded))
    hashed = hashing.murmur_windows(encoded, ksize)
    kept = np.flatnonzero(hashed <= np.uint64(limit))
    parts = max(1, -(-len(kept) // step))
    of = hashed[kept] // np.uint64(limit // parts + 1) if parts > 1 else np.zeros(len(kept), np.uint64)
    for p in range(parts):
        at = kept[of == np.uint64(p)]
        yield at, raw[at], view[at], hashed[at]


def _together(rows: np.ndarray, hashed: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """An order that keeps rows, and in it puts windows of one hash, and of one original, together; else it stays as it is.

    Each row is sorted by one number, of half the bits of its hash and half of a mix of its residues; where two hashes or originals are taken for one, all are sorted by all columns.
    """
    originals = _sortable(raw)
    if originals.dtype != np.uint64 or len(rows) < 2:
        return np.lexsort((originals, hashed, rows))
    half = np.uint64(32)
    top = hashed >> half
    key = top << half | originals * np.uint64(_FACTORS[0]) >> half
    bounds = [*np.flatnonzero(_changes(rows)).tolist(), len(rows)]
    order = np.concatenate([a + np.argsort(key[a:z], kind="stable") for a, z in zip(bounds, bounds[1:], strict=False)])
    differs = lambda x: x[order[1:]] != x[order[:-1]]
    wrong = ~differs(top) & differs(hashed) | ~differs(key) & differs(originals)
    return np.lexsort((originals, hashed, rows)) if (wrong & ~differs(rows)).any() else order


def grouped(batch: pa.RecordBatch, ksize: int, lookup: np.ndarray | None, limit: int, step: int = _STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """``_sliced``, with windows of a row, a hash and an original together, by start."""
    for rows, start, raw, encoded, hashed in _sliced(batch, ksize, lookup, limit, step):
        order = _together(rows, hashed, raw)  # stable: starts ascend already
        yield rows[order], start[order], raw[order], encoded[order], hashed[order]


def _sliced(batch: pa.RecordBatch, ksize: int, lookup: np.ndarray | None, limit: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start, raw and encoded bytes, and hash of the sampled windows, by row and start: of many rows, or of a slice of a long one, which has all windows of its hashes."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def together() -> Iterator[tuple[np.ndarray, ...]]:
        if held:
            w = _windows([x for _, x in held], ksize, lookup, _kept(limit, None))
            yield np.array([r for r, _ in held], np.int64)[w.owner], w.start, w.cut(w.data), w.cut(w.encoded), w.hashed

    for row, sequence in enumerate(batch.column("sequence")):
        own = (sequence.as_py() or "").encode()
        if len(own) > step and len(own) >= ksize:
            for found in _slices(own, ksize, lookup, limit, step):
                yield np.full(len(found[0]), row, np.int64), *found
            continue
        held.append((row, own))
        size += len(own)
        if size >= step:
            yield from together()
            held, size = [], 0
    yield from together()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _in_records(sequences: DataFrame, ksize: int, moltype: str, scaled: int, name: str, sequence: str, schema: str, columns: Callable[..., list[pa.Array]], step: int) -> DataFrame:
    """Rows made of a record's own windows: ``columns`` gets the first window of each hash, of each original, and the windows."""
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], schema)
    lookup, limit, names = _lookup(moltype), hashing.max_hash(scaled), [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, raw, encoded, hashed in grouped(batch, ksize, lookup, limit, step):
                by_hash = _changes(row, hashed)
                by_original = by_hash | _changes(_sortable(raw))
                at, own = columns(np.flatnonzero(by_hash), np.flatnonzero(by_original), start, raw)
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("name").take(of), pa.array(hashed[at].view(np.int64)), _strings(encoded[at]), *own], names)

    return named(sequences, name, sequence).mapInArrow(run, schema)


def _lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values, pa.int32()))


def kmer_infos(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = _STEP) -> DataFrame:
    """``id, name, hashval, encoded, kmer, positions``: the ascending positions of each original k-mer of a sequence."""

    def columns(by_hash: np.ndarray, by_original: np.ndarray, start: np.ndarray, raw: np.ndarray) -> tuple:
        return by_original, [_strings(raw[by_original]), _lists(by_original, start)]

    return _in_records(sequences, ksize, moltype, scaled, name, sequence, INFOS, columns, step)


#: Texts of the numbers that most positions are; made once in a worker.
_DECIMALS: list[pa.Array] = []


def _decimals(values: np.ndarray) -> pa.Array:
    """Texts of numbers that are not negative."""
    if not len(values) or values.max() >= _STEP:
        return pa.array(values, pa.int32()).cast(pa.string())
    if not _DECIMALS:
        _DECIMALS.append(pa.array(np.arange(_STEP, dtype=np.int32)).cast(pa.string()))
    return _DECIMALS[0].take(pa.array(values, pa.int32()))


def _joined(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """The texts of lists of numbers, with commas, from where each list begins."""
    texts = _decimals(values)
    return texts if len(first) == len(values) else pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), texts), ",")


def _ascending(keys: np.ndarray, ksize: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``_sortable`` keys, and the keys in it, or other numbers that tell them apart.

    Keys of capital letters have 5 bits a letter; with its place behind it each is one number, and plain numbers are sorted several times faster than an order is found.
    """
    n, bits = len(keys), max(1, len(keys).bit_length())
    if n and keys.dtype == np.uint64 and 5 * ksize + bits <= 64:
        word = keys >> np.uint64(64 - 8 * ksize)
        word ^= np.uint64(int.from_bytes(b"\x40" * ksize))
        if not (word & np.uint64(int.from_bytes(b"\xe0" * ksize))).any():
            del keys  # in place from here on, as a column of all windows of a task is large
            for shift, low, high in ((3, 0x001F001F001F001F, 0x03E003E003E003E0), (6, 0x000003FF000003FF, 0x000FFC00000FFC00), (12, 0x00000000000FFFFF, 0x000000FFFFF00000)):
                right = word >> np.uint64(shift)  # two, four, then eight letters side by side
                right &= np.uint64(high)
                word &= np.uint64(low)
                word |= right
            del right
            word <<= np.uint64(bits)
            word |= np.arange(n, dtype=np.uint64)
            word.sort()
            order = (word & np.uint64((1 << bits) - 1)).view(np.int64)
            word >>= np.uint64(bits)
            return order, word
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


@dataclass
class Runs:
    """The sampled windows of some records, equal ones as a run: runs by encoded and original k-mer, the windows of a run by place.

    ``place`` has where windows stand in the bytes of all records, ``first`` and ``size`` where the runs lie in it, ``begin`` where the records begin.
    """

    names: pa.Array
    begin: np.ndarray
    place: np.ndarray
    first: np.ndarray
    size: np.ndarray
    raw: np.ndarray
    encoded: np.ndarray
    hashed: np.ndarray

    def pieces(self, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
        """Run (in the slice that is last), record and start of some windows at once; with ``whole``, a run's windows of one record are not set apart."""
        ends = np.cumsum(self.size)
        n, a, step = int(ends[-1]) if len(ends) else 0, 0, _STEP
        while a < n:
            z = min(n, a + step)
            u, v = (int(x) for x in np.searchsorted(ends, [a, z - 1], "right"))
            edges = np.clip(np.append(ends[u : v + 1] - self.size[u : v + 1], ends[v]), a, z)
            run = np.repeat(np.arange(v + 1 - u), np.diff(edges))
            at = self.place[(self.first[u : v + 1] + self.size[u : v + 1] - ends[u : v + 1])[run] + np.arange(a, z)]
            record = np.searchsorted(self.begin, at, "right") - 1
            if whole and z < n:
                last = np.flatnonzero(_changes(run, record))[-1]
                if not last:
                    step *= 2
                    continue
                run, record, at, z = run[:last], record[:last], at[:last], a + int(last)
            yield run, record, at - self.begin[record], slice(u, v + 1)
            a, step = z, _STEP


def _keys(data: np.ndarray, at: np.ndarray, ksize: int) -> np.ndarray:
    """``_sortable`` of the windows at some places."""
    if ksize > 8:
        return _sortable(np.lib.stride_tricks.sliding_window_view(data, ksize)[at])
    out = np.zeros(max(0, len(data) - ksize + 1), np.uint64)
    for j in range(ksize):
        out <<= np.uint64(8)
        out |= data[j : len(out) + j]
    out <<= np.uint64(64 - 8 * ksize)
    return out[at]


def _runs_of(names: pa.Array, begin: np.ndarray, data: np.ndarray, at: np.ndarray, ksize: int, lookup: np.ndarray | None, limit: int) -> Runs:
    order, keys = _ascending(_keys(data, at, ksize), ksize)
    first = np.flatnonzero(_changes(keys))
    del keys
    place, size = at[order], np.diff(np.append(first, len(order)))
    raw = np.lib.stride_tricks.sliding_window_view(data, ksize)[place[first]] if len(first) else np.zeros((0, ksize), np.uint8)
    encoded = raw if lookup is None else lookup[raw]
    hashed = hashing.murmur(encoded)
    here = np.flatnonzero(hashed <= np.uint64(limit))
    if lookup is not None:
        here = here[np.argsort(_sortable(encoded[here]), kind="stable")]
    return Runs(names, begin, place, first[here], size[here], raw[here], encoded[here], hashed[here])


def _runs(batches: Iterator[pa.RecordBatch], ksize: int, lookup: np.ndarray | None, limit: int, step: int) -> Iterator[Runs]:
    """Of the records of a task, about ``step`` residues at once, also over batches; of a longer record, by slices of the hash range."""
    names: list[pa.Scalar] = []
    held: list[bytes] = []
    size = 0

    def together() -> Runs:
        sizes = np.array([len(x) for x in held], np.int64)
        out = _runs_of(pa.array(names, pa.string()), np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), np.uint8), _whole(sizes, ksize), ksize, lookup, limit)
        names.clear()
        held.clear()
        return out

    for batch in batches:
        for name, sequence in zip(batch.column("name"), batch.column("sequence"), strict=True):
            own = (sequence.as_py() or "").encode()
            if len(own) < ksize:
                continue
            if len(own) > step:
                for at, *_ in _slices(own, ksize, lookup, limit, step):
                    yield _runs_of(pa.array([name.as_py()], pa.string()), np.zeros(1, np.int64), np.frombuffer(own, np.uint8), at, ksize, lookup, limit)
                continue
            if size + len(own) > step:
                yield together()
                size = 0
            names.append(name.as_py())
            held.append(own)
            size += len(own)
    if held:
        yield together()


def kmer_info_texts(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = TOGETHER) -> DataFrame:
    """The rows of ``kmer_infos`` as texts, for a table that is stored as a whole: ``name, hashval, encoded, kmer, positions``, hashes in unsigned decimals, positions with commas.

    Texts are made in the tasks, a column at a time, those of a hash once for each k-mer of a step. Equal k-mers of a step's records come one after the other, by encoded and original k-mer.
    """
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], INFO_TEXTS)
    lookup, limit, names = _lookup(moltype), hashing.max_hash(scaled), [x.split()[0] for x in INFO_TEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ksize, lookup, limit, step):
            for kind, record, start, part in own.pieces(whole=True):
                first = np.flatnonzero(_changes(kind, record))
                of = pa.array(kind[first])
                yield pa.RecordBatch.from_arrays([own.names.take(pa.array(record[first])), *(x.take(of) for x in _kind_texts(own, part)[::-1]), _joined(first, start)], names)
            del own  # before the next ones are made

    return named(sequences, name, sequence).mapInArrow(run, INFO_TEXTS)


def _kind_texts(own: Runs, part: slice) -> tuple[pa.Array, ...]:
    """Original and encoded k-mers and hashes of some runs."""
    return _strings(own.raw[part]), _strings(own.encoded[part]), pa.array(own.hashed[part]).cast(pa.string())


def kmer_position_texts(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = TOGETHER) -> DataFrame:
    """The rows of ``kmer_positions`` for a table that is stored as a whole: ``name, start, kmer, encoded, hashval``, hashes as texts in unsigned decimals, and in the order of ``kmer_info_texts``."""
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], KMER_TEXTS)
    lookup, limit, names = _lookup(moltype), hashing.max_hash(scaled), [x.split()[0] for x in KMER_TEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _runs(batches, ksize, lookup, limit, step):
            for kind, record, start, part in own.pieces(whole=False):
                of = pa.array(kind)
                yield pa.RecordBatch.from_arrays([own.names.take(pa.array(record)), pa.array(start), *(x.take(of) for x in _kind_texts(own, part))], names)
            del own  # before the next ones are made

    return named(sequences, name, sequence).mapInArrow(run, KMER_TEXTS)


def nested_infos(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = _STEP) -> DataFrame:
    """``id, name, hashval, encoded, originals``: positions by original k-mer, as a map, for each hash of a sequence."""

    def columns(by_hash: np.ndarray, by_original: np.ndarray, start: np.ndarray, raw: np.ndarray) -> tuple:
        offsets = pa.array(np.append(np.searchsorted(by_original, by_hash), len(by_original)), pa.int32())
        return by_hash, [pa.MapArray.from_arrays(offsets, _strings(raw[by_original]), _lists(by_original, start))]

    return _in_records(sequences, ksize, moltype, scaled, name, sequence, NESTED, columns, step)


def original_counts(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = _STEP) -> DataFrame:
    """``id, name, hashval, encoded, n_originals, occurrences``: how many k-mers of a sequence share a hash, and how often it stands there."""

    def columns(by_hash: np.ndarray, by_original: np.ndarray, start: np.ndarray, raw: np.ndarray) -> tuple:
        ends = np.append(by_hash[1:], len(start)) if len(by_hash) else by_hash
        originals = np.searchsorted(by_original, ends) - np.searchsorted(by_original, by_hash)
        return by_hash, [pa.array(originals, pa.int64()), pa.array(ends - by_hash, pa.int64())]

    return _in_records(sequences, ksize, moltype, scaled, name, sequence, ORIGINALS, columns, step)


def distinct_counts(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence", step: int = _STEP) -> DataFrame:
    """``id, name, n_hashes, n_originals, length``: numbers of distinct hashes and k-mers of a sequence that has any, and its bytes.

    A k-mer has one hash, so that the k-mers of all hashes are the distinct k-mers. A long sequence has a row for each slice that has a hash, and its bytes in the first of these.
    """
    schema = "id long, name string, n_hashes long, n_originals long, length long"
    if ksize < 1:
        return sequences.sparkSession.createDataFrame([], schema)
    lookup, limit = _lookup(moltype), hashing.max_hash(scaled)

    def n_distinct(values: np.ndarray, bounds: list[int]) -> list[int]:
        return [1 + int(np.count_nonzero(np.diff(np.sort(values[a:z])))) if values.dtype == np.uint64 else len(np.unique(values[a:z])) for a, z in zip(bounds, bounds[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = -1
            for row, _, raw, _, hashed in _sliced(batch, ksize, lookup, limit, step):
                if not len(row):
                    continue
                first = np.flatnonzero(_changes(row))
                bounds, of = [*first.tolist(), len(row)], pa.array(row[first])
                size = pc.fill_null(pc.binary_length(batch.column("sequence").take(of)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if row[0] == last:
                    size[0] = 0
                last = row[-1]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("name").take(of), *(pa.array(x, pa.int64()) for x in (n_distinct(hashed, bounds), n_distinct(_sortable(raw), bounds), size))], ["id", "name", "n_hashes", "n_originals", "length"])

    return named(sequences, name, sequence).mapInArrow(run, schema)


def hashes_by_count(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """``id, name, n, hashvals``: for each number of occurrences in a sequence the hashes that have it, ascending as unsigned numbers; without a shuffle."""
    lookup, limit = _lookup(moltype), hashing.max_hash(scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, owner, hashed, abund, _ in _counted(batch, ksize, lookup, limit):
                order = np.lexsort((abund, owner))
                owner, hashed, abund = owner[order], hashed[order], abund[order]
                first = np.flatnonzero(_changes(owner, abund))
                of = pa.array(np.array(rows, np.int64)[owner[first]])
                hashes = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), pa.array(hashed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("name").take(of), pa.array(abund[first], pa.int64()), hashes], ["id", "name", "n", "hashvals"])

    return named(sequences, name, sequence).mapInArrow(run, "id long, name string, n long, hashvals array<long>")


def combined_sketch(sketch: DataFrame) -> DataFrame:
    """``hashval, abund, df``: occurrences and number of sequences over the collection."""
    return sketch.groupBy("hashval").agg(F.sum("abund").alias("abund"), F.count("*").alias("df"))


#: Distinct hashes that a task adds up before it hands them on, and half as many more before it merges them; some 50 bytes each.
_ADDED = 1 << 22


def combined_of(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, held: int = _ADDED) -> DataFrame:
    """``combined_sketch`` of sequences, whose hashes are added up in the tasks first and move as blocks of bytes; in each task of the result by hash."""
    from . import postings as po

    lookup, limit = _lookup(moltype), hashing.max_hash(scaled)
    spark = sequences.sparkSession
    bits = (int(spark.conf.get("spark.sql.shuffle.partitions")) * scaled - 1).bit_length()

    def merged(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        hashed = np.concatenate([p[0] for p in parts])
        order = np.argsort(hashed, kind="stable")  # merges what is in order already
        hashed = hashed[order]
        first = np.flatnonzero(_changes(hashed))
        return [(hashed[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) if len(first) else np.zeros(0, np.int64) for i in (1, 2)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = kept = 0

        def out() -> Iterator[pa.RecordBatch]:
            hashed, abund, df = merged(parts)[0]
            if len(hashed):
                yield po.cut(hashed, df, abund, bits)

        for batch in batches:
            for _, _, hashed, abund, _ in _counted(batch, ksize, lookup, limit):
                parts.append((hashed, abund, np.ones(len(hashed), np.int64)))
                size += len(hashed)
                if size > kept + held // 2:
                    parts = merged(parts)
                    size = kept = len(parts[0][0])
                    if kept > held:
                        yield from out()
                        parts, size, kept = [], 0, 0
        if parts:
            yield from out()

    return po.added_up(named(sequences).mapInArrow(run, po.BLOCKS), scaled, bits)


def frequencies(combined: DataFrame, n_sequences: int) -> DataFrame:
    """``hashval, df, frequency, idf`` from the combined sketch of ``n_sequences``, which is read twice; a hash's frequency is its share of all occurrences."""
    total = combined.agg(F.sum("abund").alias("total"))  # one row
    return combined.crossJoin(F.broadcast(total)).select("hashval", "df", (F.col("abund") / F.col("total")).alias("frequency"), idf(F.lit(n_sequences), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def signature_names(sketch: DataFrame) -> DataFrame:
    """``id, name, n_hashes, occurrences, pseudo_md5``, the last the hexadecimal sum of the hashes."""
    return sketch.groupBy("id", "name").agg(F.count("*").alias("n_hashes"), F.sum("abund").alias("occurrences"), hashing.wrapped_sum_hex(F.col("hashval")).alias("pseudo_md5"))


def sketch_digests(sketch: DataFrame, ksize: int) -> DataFrame:
    """``id, name, md5``."""
    return sketch.groupBy("id", "name").agg(F.collect_list("hashval").alias("hashes")).select("id", "name", hashing.sketch_md5(F.col("hashes"), ksize).alias("md5"))

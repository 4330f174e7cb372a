"""Small helpers around Arrow batches for ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one step of a Python worker holds beside the Arrow batch.
STEP_BYTES = 4 << 20


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = col.nbytes
    if sizes <= limit:
        yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null becomes the empty string."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null becomes the empty string."""
    col = batch.column(column)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()) if not pa.types.is_binary(col.type) else col
    return [x if x is not None else b"" for x in col.to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that stand together by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), len(cols)]
        for s, e in zip(edges, edges[1:], strict=False):
            key = tuple(cols[s].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)

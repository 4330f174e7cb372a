"""Stretches of matching k-mers, stitched together.

``compat`` glues all hits of a query and a match, in the order of ``start_query`` (then ``start_match``), into one
row: each next k-mer adds the letters that its step from the one before leaves uncovered. A step of
``k`` or more adds the whole k-mer, without a filler for the gap; the query's and match's letters follow the steps in the match,
the encoded ones the steps in the query. ``diagonal`` starts a new row wherever the
offset between match and query changes or a gap opens, so that its ends are true ends.

Hits are sorted in ranges of pair and start, so that a pair of very many hits goes on in the next range. Each range folds its runs into fragments:
the letters so far, the first k-mers whole, and the starts of the first and the last hit. A fragment with another on either side of it in its range is a finished
row. Only those at a range's ends (two a range, and one for each ``FRAGMENT`` hits of a run) meet again, where the step from the fragment before tells what the first
k-mers add.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved

_PAIR = ["match_id", "query_id", "match_name", "query_name"]
_TEXTS = ["kmer_query", "kmer_match", "encoded"]
_FRAGMENTS = "match_id long, query_id long, match_name string, query_name string, offset int, part int, n int, border boolean, first_q int, first_m int, last_q int, last_m int, low_q int, low_m int, head_q string, head_m string, head_e string, q string, m string, e string"
#: Hits that one fragment holds at most.
FRAGMENT = 200_000


def _added(kmer: Column, step: Column) -> Column:
    """What a k-mer adds after a step; a step of 0 adds it whole, a step back drops as many letters from its front."""
    return F.when(step.isNull() | (step == 0), kmer).when(step > 0, F.right(kmer, step)).otherwise(F.substr(kmer, 1 - step))


def _glued(kmers: list[str], steps: list[int]) -> str:
    return "".join([k[-d:] if d else k for k, d in zip(kmers, steps, strict=True)])


class _Run:
    """Hits of one run that follow one another."""

    def __init__(self, key: tuple, head: tuple, part: int, n: int, border: bool):
        self.key, self.head, self.part, self.n, self.border = key, head, part, n, border
        self.texts: tuple[list[str], ...] = ([], [], [])
        self.count, self.last, self.low_q, self.low_m = 1, head[:2], *head[:2]

    def add(self, sq: np.ndarray, sm: np.ndarray, kmers: list[list[str]]) -> None:
        """Further hits, with the steps from the last one."""
        dq, dm = (np.diff(x, prepend=before).tolist() for x, before in ((sq, self.last[0]), (sm, self.last[1])))
        for text, own, steps in zip(self.texts, kmers, (dm, dm, dq), strict=True):
            text.append(_glued(own, steps))
        self.count, self.last = self.count + len(sq), (int(sq[-1]), int(sm[-1]))
        self.low_q, self.low_m = min(self.low_q, int(sq.min())), min(self.low_m, int(sm.min()))

    def row(self) -> tuple:
        return (*self.key, self.part, self.n, self.border, *self.head[:2], *self.last, self.low_q, self.low_m, *self.head[2:], *("".join(x) for x in self.texts))


def _pieces(column: pa.Array, steps: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts of runs that begin at ``first``: each k-mer adds the end of it that its step leaves uncovered, and after a step of 0 the whole."""
    k = len(column[0].as_py())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if pa.types.is_string(column.type) else np.zeros(1, np.int32)
    if k == 0 or len(bounds) == 1 or (np.diff(bounds) != k).any():  # of several lengths, or letters of several bytes
        glued = [x[-d:] if d else x for x, d in zip(column.to_pylist(), steps.tolist(), strict=True)]
        return pa.array(["".join(glued[a:z]) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(glued)], strict=True)], pa.string())
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    if (data > 127).any():
        return _pieces(column.cast(pa.large_string()), steps, first)
    kept = np.where(steps == 0, k, np.where(steps > 0, np.minimum(steps, k), np.maximum(k + steps, 0)))
    text = data.reshape(len(column), k)[np.arange(k) >= (k - kept)[:, None]]
    ends = np.concatenate([[0], np.cumsum(kept)])[np.append(first, len(column))]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))


def _inner(batch: pa.RecordBatch, starts: np.ndarray, sq: np.ndarray, sm: np.ndarray, part: int, n: int, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """Runs that begin and end in a batch, all but that of the last start; a first k-mer is added whole, as after a step of 0."""
    a, z, rows = int(starts[0]), int(starts[-1]), len(starts) - 1
    first, of = starts[:-1] - a, pa.array(starts[:-1])
    sq, sm = sq[a:z], sm[a:z]
    steps_q, steps_m = (np.diff(x, prepend=x[0]).astype(np.int64) for x in (sq, sm))
    steps_q[first] = steps_m[first] = 0
    q, m, empty = sq[first], np.minimum.reduceat(sm, first), pa.array([""] * rows)
    columns = [*(batch.column(c).take(of) for c in (*_PAIR, "offset")), np.full(rows, part), np.arange(n, n + rows), np.zeros(rows, bool), q, m, q, m, q, m, empty, empty, empty]
    columns += [_pieces(batch.column(c).slice(a, z - a), s, first) for c, s in zip(_TEXTS, (steps_m, steps_m, steps_q), strict=True)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fragments(hits: DataFrame, ksize: int | None, limit: int = FRAGMENT) -> DataFrame:
    """Fragments of the runs of each pair, or, with a ``ksize``, of each offset of a pair without gaps."""
    offset = F.lit(None).cast("int") if ksize is None else (F.col("start_match") - F.col("start_query")).cast("int")
    keys = ["match_id", "query_id", "offset"]
    rows = hits.select(*_PAIR, offset.alias("offset"), *(F.col(c).cast("int").alias(c) for c in ("start_query", "start_match")), "kmer_query", "kmer_match", "encoded")
    order = [*keys, "start_query", "start_match"]
    names = [x.split()[0] for x in _FRAGMENTS.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _FRAGMENTS.split(", ")]

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            match, query, sq, sm = (batch.column(c).to_numpy() for c in ("match_id", "query_id", "start_query", "start_match"))
            off = batch.column("offset").fill_null(0).to_numpy()
            texts = lambda a, z: [batch.column(c).slice(a, z - a).to_pylist() for c in _TEXTS]  # noqa: B023, E731
            new = np.ones(len(sq), bool)
            new[1:] = (np.diff(match) != 0) | (np.diff(query) != 0) | (np.diff(off) != 0)
            if ksize is not None:
                new[1:] |= np.diff(sq) > ksize
            label = lambda a: tuple(batch.column(c)[a].as_py() for c in (*_PAIR, "offset"))  # noqa: B023, E731
            new[0] = own is None or own.key != label(0) or (ksize is not None and int(sq[0]) - own.last[0] > ksize)
            done: list[tuple] = []
            starts = np.flatnonzero(new)
            if not new[0]:
                end = int(starts[0]) if len(starts) else len(sq)
                own.add(sq[:end], sm[:end], texts(0, end))

            def opened(a: int, z: int) -> _Run:
                nonlocal n
                kmers = texts(a, z)  # noqa: B023
                out = _Run(label(a), (int(sq[a]), int(sm[a]), *(k[0] for k in kmers)), part, n, n == 0)  # noqa: B023
                if z > a + 1:
                    out.add(sq[a + 1 : z], sm[a + 1 : z], [k[1:] for k in kmers])  # noqa: B023
                n += 1
                return out

            if len(starts) and own is None:
                own, starts = opened(int(starts[0]), int(starts[1]) if len(starts) > 1 else len(sq)), starts[1:]
            if len(starts):
                if own.count:
                    done.append(own.row())
                if len(starts) > 1:
                    yield _inner(batch, starts, sq, sm, part, n, names, types)
                    n += len(starts) - 1
                own = opened(int(starts[-1]), len(sq))
            if own.count >= limit:  # goes on as another fragment, which begins with its next hit
                own.border = True
                done.append(own.row())
                own = _Continued(own, n)
                n += 1
            yield table(done)
        if own is not None and own.count:
            own.border = True
            yield table([own.row()])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _FRAGMENTS)


class _Continued(_Run):
    """A run after a fragment of it was handed out: it has no hit yet."""

    def __init__(self, before: _Run, n: int):
        self.key, self.part, self.n, self.border, self.count, self.last = before.key, before.part, n, True, 0, before.last

    def add(self, sq: np.ndarray, sm: np.ndarray, kmers: list[list[str]]) -> None:
        if not self.count:
            _Run.__init__(self, self.key, (int(sq[0]), int(sm[0]), *(k[0] for k in kmers)), self.part, self.n, True)
            sq, sm, kmers = sq[1:], sm[1:], [k[1:] for k in kmers]
        if len(sq):
            super().add(sq, sm, kmers)


def joined(border: DataFrame, ksize: int | None) -> DataFrame:
    """Fragments that follow one another across ranges, joined in their order."""
    keys = ["match_id", "query_id", "offset"]
    order = W.partitionBy(*keys).orderBy("part", "n")
    step_q, step_m = F.col("first_q") - F.lag("last_q").over(order), F.col("first_m") - F.lag("last_m").over(order)
    rows = border.withColumns({"step_q": step_q, "step_m": step_m})
    if ksize is not None:
        opens = F.coalesce((F.col("step_q") > ksize).cast("int"), F.lit(1))
        rows = rows.withColumn("island", F.sum(opens).over(order))
        first = F.row_number().over(W.partitionBy(*keys, "island").orderBy("part", "n")) == 1
        rows = rows.withColumns({"step_q": F.when(~first, F.col("step_q")), "step_m": F.when(~first, F.col("step_m"))})
    else:
        rows = rows.withColumn("island", F.lit(0))
    text = lambda x, step: F.concat(_added(F.col(f"head_{x}"), F.col(step)), F.col(x)).alias(x)
    piece = F.struct("part", "n", text("q", "step_m"), text("m", "step_m"), text("e", "step_q"))
    whole = rows.groupBy(*_PAIR, "offset", "island").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min("low_q").alias("query_start"), F.min("low_m").alias("match_start"))  # a piece for each range or FRAGMENT hits
    glue = lambda x: F.array_join(F.col(f"p.{x}"), "")
    return whole.select(*_PAIR, "query_start", glue("q").alias("query"), "match_start", glue("m").alias("match"), glue("e").alias("encoded"))


def _finished(rows: DataFrame) -> DataFrame:
    length = F.length("query")
    return rows.select("match_name", "query_name", "query_start", (F.col("query_start") + length).alias("query_end"), "query", "match_start", (F.col("match_start") + length).alias("match_end"), "match", "encoded", length.alias("length"))


def stitch(hits: DataFrame, mode: str = "compat", ksize: int | None = None, limit: int = FRAGMENT) -> DataFrame:
    """``match_name, query_name, query_start, query_end, query, match_start, match_end, match, encoded, length``; ends are open.

    The hits are written to the shared folder first, as the ranges are chosen from a sample of them.
    """
    if mode not in ("compat", "diagonal") or (mode == "diagonal" and not ksize):
        raise ValueError("mode is compat, or diagonal with a ksize")
    gap = ksize if mode == "diagonal" else None
    stored, _ = saved(hits.select(*_PAIR, "start_query", "start_match", "kmer_query", "kmer_match", "encoded"), "hits")
    found, _ = saved(fragments(stored, gap, limit), "fragments")
    text = lambda x: F.concat(f"head_{x}", x)
    inner = found.where(~F.col("border")).select(*_PAIR, F.col("low_q").alias("query_start"), text("q").alias("query"), F.col("low_m").alias("match_start"), text("m").alias("match"), text("e").alias("encoded"))
    return _finished(inner.unionByName(joined(found.where("border"), gap)))


def shown(stitched: DataFrame) -> DataFrame:
    """The stitched rows with ``to_print``."""
    # Fixed value: the layout.
    text = F.format_string("\n---\nQuery Name: %s\nMatch Name: %s\nquery: %s (%d-%d)\nalpha: %s\nmatch: %s (%d-%d)", "query_name", "match_name", "query", "query_start", "query_end", "encoded", "match", "match_start", "match_end")
    return stitched.withColumn("to_print", text)

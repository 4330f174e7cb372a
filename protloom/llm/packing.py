"""Best-fit packing of tokenised documents into sequences of bounded length.

Every document becomes its token ids and an end id; documents longer than a
sequence are cut into full pieces and a rest. Pieces then go into sequences by
bulk-synchronous best-fit, over size classes from the longest to the shortest:

1. gaps of open sequences and unplaced pieces are range-sorted by size, descending;
2. each range sweeps once and gives every piece the smallest gap at or above its
   length (its successor), putting what is left of the gap back below;
3. gaps and pieces that a range leaves over are matched across ranges: as in
   bracket matching, a piece takes the nearest gap above it. Only the counts of
   each range meet on the driver; rank intervals settle which piece takes which;
4. gaps are updated and steps 1 to 3 repeat until (almost) no piece crosses ranges;
5. pieces that no gap can hold open sequences of their own, best-fit inside a range.

A sequence is named after the piece that opened it. Each class with at most
``rows_per_task`` rows is one range.

Defined results: a null or empty text is one piece holding the end id alone;
repeated rows are packed as often as they occur; ties in length are broken by a
hash of the piece's number; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import steps, texts
from ._store import saved, table
from .token_counts import tokenizer_path
from .word_ids import word_ids

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
ROWS_PER_TASK = 200_000
#: Lower bounds of the size classes, as fractions of the capacity.
CLASSES = (2, 4, 8, 32)
GAP, PIECE, PLACED = 0, 1, 2
_STATE = "kind int, id long, size int, used int, sequence_id long, part int, rank long, carry boolean"


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, and ``ids`` (little-endian bytes) on request."""
    end = int(end_id).to_bytes(4, "little")
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path(vocabulary)).encode
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts(part)), strict=True):
                    ids = memoryview(ids + end)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((bytes(own),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(pieces: np.ndarray, ids: np.ndarray, gaps: list[tuple[int, int, int]], opens: int) -> tuple[list, list, list]:
    """One descending sweep.

    pieces, ids: lengths (descending) and names; gaps: ``(size, sequence, used)``, descending; opens: the
    capacity of a new sequence for a piece without a gap, 0 to leave it over.
    Returns placements ``(id, sequence, offset)``, gaps left, and indices of pieces left.
    """
    placed, left = [], []
    stack: list[tuple[int, int, int]] = []  # at or above the current length, the smallest on top
    fallen: list[tuple[int, int, int]] = []  # updated gaps below the current length, the largest first
    at = 0
    for i, (size, name) in enumerate(zip(pieces.tolist(), ids.tolist(), strict=True)):
        while True:
            a = gaps[at][0] if at < len(gaps) else -1
            b = -fallen[0][0] if fallen else -1
            if max(a, b) < size:
                break
            if a >= b:
                stack.append(gaps[at])
                at += 1
            else:
                g, s, u = heapq.heappop(fallen)
                stack.append((-g, s, u))
        if stack:
            g, s, u = stack.pop()
        elif opens:
            g, s, u = opens, name, 0
        else:
            left.append(i)
            continue
        placed.append((name, s, u))
        if g - size >= size:
            stack.append((g - size, s, u + size))
        elif g > size:
            heapq.heappush(fallen, (size - g, s, u + size))
    rest = sorted(stack + gaps[at:] + [(-g, s, u) for g, s, u in fallen], reverse=True)
    return placed, rest, left


def sweep(items: DataFrame, n_rows: int, opens: int, rows_per_task: int) -> DataFrame:
    """Range-sort gaps and pieces and sweep each range once."""
    parts = max(1, math.ceil(n_rows / rows_per_task))
    order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id")]
    dealt = items.repartition(1) if parts == 1 else items.repartitionByRange(parts, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        kind, ids, size, used, part = (rows.column(c).to_numpy() for c in ("kind", "id", "size", "used", "part"))
        is_gap, is_piece = kind == GAP, kind == PIECE
        gaps = list(zip(size[is_gap].tolist(), ids[is_gap].tolist(), used[is_gap].tolist(), strict=True))
        lengths, names, here, least = size[is_piece], ids[is_piece], int(part[0]), int(size.min())
        placed, rest, left = best_fit(lengths, names, gaps, opens)
        length_of = dict(zip(names.tolist(), lengths.tolist(), strict=True))
        out = [(PLACED, i, length_of[i], u, s, here, 0, False) for i, s, u in placed]
        carried = 0
        for g, s, u in rest:
            out.append((GAP, s, g, u, s, here, carried if g >= least else 0, g >= least))
            carried += g >= least
        out += [(PIECE, int(names[i]), int(lengths[i]), 0, None, here, k, True) for k, i in enumerate(left)]
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _STATE.split(", ")])

    return dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order).mapInArrow(run, _STATE)


def rank_intervals(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Bracket matching over ranges in descending order of size.

    counts: ``(part, pieces left, gaps carried)``. Returns ``(piece part, first piece rank, gap part, first
    gap rank, n)``: the pieces' ranks from the first on take the gaps' ranks from the first on.
    """
    out, stack = [], []
    for part, pieces, gaps in sorted(counts):
        first = 0
        while pieces and stack:
            above, have = stack.pop()
            n = min(pieces, have)
            out.append((part, first, above, have - n, n))
            first, pieces = first + n, pieces - n
            if have > n:
                stack.append((above, have - n))
        if gaps:
            stack.append((part, gaps))
    return out


def across(state: DataFrame, intervals: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The left pieces that take a gap of another range, with that gap; one row each."""
    spark = state.sparkSession
    # at most two intervals for each range; whether they are broadcast is left to Spark's own check of their size
    told = spark.createDataFrame([(k, *x) for k, x in enumerate(intervals)], "m int, piece_part int, piece_rank long, gap_part int, gap_rank long, n long")
    pieces = state.where(F.col("kind") == PIECE).join(told, (F.col("part") == F.col("piece_part")) & (F.col("rank") >= F.col("piece_rank")) & (F.col("rank") < F.col("piece_rank") + F.col("n")))
    gaps = state.where((F.col("kind") == GAP) & F.col("carry")).join(told, (F.col("part") == F.col("gap_part")) & (F.col("rank") >= F.col("gap_rank")) & (F.col("rank") < F.col("gap_rank") + F.col("n")))
    pieces = pieces.select("m", (F.col("rank") - F.col("piece_rank")).alias("k"), "id", "size")
    gaps = gaps.select("m", (F.col("rank") - F.col("gap_rank")).alias("k"), F.col("id").alias("sequence_id"), F.col("size").alias("gap"), "used")
    return pieces.join(gaps, ["m", "k"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id, sequence_id, offset`` for a stored table ``id, length`` with distinct ids and lengths of 1 to the capacity."""
    spark = pieces.sparkSession
    pieces = pieces.select(F.col("id").cast("long").alias("id"), F.col("length").cast("int").alias("size"))
    bounds = [capacity, *(capacity // f for f in CLASSES), 0]
    cls = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        cls = F.when(F.col("size") > bounds[k + 1], k).otherwise(cls)
    n_of = {r["k"]: r["n"] for r in pieces.where(F.col("size") < capacity).groupBy(cls.alias("k")).agg(F.count("*").alias("n")).collect()}
    blank = {"used": F.lit(0), "part": F.lit(0)}
    done: list[DataFrame] = [pieces.where(F.col("size") >= capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).alias("offset"))]
    gaps = spark.createDataFrame([], "id long, size int, used int")
    n_gaps = 0
    for k in range(len(bounds) - 1):
        todo, n = pieces.where((F.col("size") < capacity) & (F.col("size") > bounds[k + 1]) & (F.col("size") <= bounds[k])), n_of.get(k, 0)
        while n:
            items = gaps.select(F.lit(GAP).alias("kind"), "id", "size", "used").unionByName(todo.select(F.lit(PIECE).alias("kind"), "id", "size", blank["used"].alias("used")))
            one = n + n_gaps <= rows_per_task
            state, _ = saved(sweep(items.withColumn("part", blank["part"]), n + n_gaps, capacity if one else 0, rows_per_task), "packing")
            counts: dict[int, list[int]] = {}
            n_gaps, n = 0, 0
            for r in state.groupBy("part", "kind", "carry").agg(F.count("*").alias("n")).collect():
                own = counts.setdefault(r["part"], [0, 0])
                if r["kind"] == PIECE:
                    own[0] += r["n"]
                    n += r["n"]
                elif r["kind"] == GAP:
                    own[1] += r["n"] * r["carry"]
                    n_gaps += r["n"]
            done.append(state.where(F.col("kind") == PLACED).select("id", "sequence_id", F.col("used").alias("offset")))
            gaps, todo = (state.where(F.col("kind") == x).select("id", "size", "used") for x in (GAP, PIECE))
            if not n:
                break
            moved = rank_intervals([(p, *c) for p, c in counts.items()])
            n_moved = sum(x[-1] for x in moved)
            if n_moved:
                matched, _ = saved(across(state, moved), "packing-across")
                done.append(matched.select("id", "sequence_id", F.col("used").alias("offset")))
                left = matched.select(F.col("sequence_id").alias("id"), (F.col("gap") - F.col("size")).alias("size"), (F.col("used") + F.col("size")).alias("used"))
                gaps = gaps.join(left.select("id"), "id", "left_anti").unionByName(left.where(F.col("size") > 0))
                todo = todo.join(matched.select("id"), "id", "left_anti")
                n -= n_moved
            if n and n_moved <= n // 1000:
                opened, _ = saved(sweep(todo.select(F.lit(PIECE).alias("kind"), "id", "size", blank["used"].alias("used"), blank["part"].alias("part")), n, capacity, rows_per_task), "packing-open")
                done.append(opened.where(F.col("kind") == PLACED).select("id", "sequence_id", F.col("used").alias("offset")))
                new = opened.where(F.col("kind") == GAP).select("id", "size", "used")
                gaps, n = gaps.unionByName(new), 0
                n_gaps += new.count()
            if n_moved:  # the joins above are settled before the next round reads them
                gaps, _ = saved(gaps, "packing-gaps")
                todo, _ = saved(todo, "packing-todo")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = token_pieces(docs, vocabulary, capacity, with_ids=with_ids, text_col=text_col, id_col=id_col).withColumn("id", F.monotonically_increasing_id())
    pieces, _ = saved(pieces, "pieces")
    placed = pack(pieces, capacity, rows_per_task)
    return pieces.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), *(["ids"] * with_ids))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``: ``sequence_id, n_tokens, ids, doc_ids, offsets``."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    packed = placed.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("rows", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))

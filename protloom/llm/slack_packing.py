"""Packing with minimum bin slack: whole documents are chosen for each sequence by subset sums of their lengths.

Every document becomes its token ids and an end id. In each task, as documents come:

1. full sequences are cut from the front of a document longer than a sequence; what remains joins the pieces that wait, counted by length;
2. when ``HIGH`` tokens wait, sequences are filled until half of them are left (all of them, at the end). The longest piece that fits opens a sequence.
   For the room that remains, the sums that the other lengths can reach are the set bits of one number, which each length, as often as it waits, shifts and joins;
   the sets before each length are kept, so that the sum nearest to the room is traced back to how often it takes each length. What a sequence
   takes is taken again while the counts allow it: documents of one length, however many, need one search;
3. where no sum fills the room, the front of the longest piece that waits does, and its rest waits on;
4. in the end less than a sequence is left; it fills sequences of powers of two, which need no padding, in the same way.

So every sequence has the full length or a power of two, no padding is needed, and few documents are cut. Tasks pack what they read, side by side: nothing is
shuffled, and a task holds the ids of ``HIGH`` tokens and of one document.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows are packed as often as they occur; texts of any length are
taken whole; an empty table gives an empty result; a row without an id keeps null as its id; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import steps, texts
from ._store import table
from .token_counts import tokenizer_path
from .word_ids import word_ids

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
#: Tokens that wait in a task before sequences are filled.
HIGH = 1 << 20
#: Bits of a sequence's number that count inside a task.
_BITS = 36


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, so that their sum is as near to ``room`` as it can be without exceeding it."""
    reach, trail, full = 1, [], 1 << room
    keep = 2 * full - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            n = min(times, left)
            left, times = left - n, 2 * times
            trail.append((length, n, reach))
            reach |= (reach << n * length) & keep
            if reach & full:
                break
        if reach & full:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, n, before in reversed(trail):
        if not before >> total & 1:
            total -= n * length
            taken[length] = taken.get(length, 0) + n
    return taken


class Waiting:
    """Pieces by length: ``(doc, start, ids, tokens of the document)``."""

    def __init__(self):
        self.pieces: dict[int, list[tuple]] = {}
        self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pieces.setdefault(n, []).append(piece)
        self.tokens += n

    def take(self, length: int) -> tuple:
        own = self.pieces[length]
        piece = own.pop()
        if not own:
            del self.pieces[length]
        self.tokens -= length
        return piece

    def choices(self, capacity: int) -> tuple[dict[int, int], int]:
        """Lengths of one sequence with how often it takes them, and how often the sequence can be repeated."""
        counts = {n: len(x) for n, x in self.pieces.items()}
        longest = max((n for n in counts if n <= capacity), default=0)
        if not longest:
            return {}, 1
        counts[longest] -= 1
        chosen = least_slack({n: c for n, c in counts.items() if c}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        return chosen, min(len(self.pieces[n]) // c for n, c in chosen.items())

    def sequences(self, capacity: int, least: int) -> Iterator[list[tuple]]:
        """Full sequences while more than ``least`` tokens, and a sequence's, wait."""
        while self.tokens >= max(capacity, least + 1):
            chosen, times = self.choices(capacity)
            total = sum(n * c for n, c in chosen.items())
            for _ in range(min(times, self.tokens // capacity) if total == capacity else 1):
                out = [self.take(n) for n, c in chosen.items() for _ in range(c)]
                if total < capacity:
                    doc, start, ids, tokens = self.take(max(self.pieces))
                    cut = 4 * (capacity - total)
                    out.append((doc, start, ids[:cut], tokens))
                    if len(ids) > cut:
                        self.put((doc, start + cut // 4, ids[cut:], tokens))
                yield out

    def rest(self) -> Iterator[list[tuple]]:
        """All that waits, in sequences of powers of two."""
        while self.tokens:
            yield from self.sequences(1 << self.tokens.bit_length() - 1, 0)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, high: int = HIGH, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` (little-endian bytes) on request."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    end = int(end_id).to_bytes(4, "little")
    names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting = word_ids(tokenizer_path(vocabulary)).encode, Waiting()
        number = TaskContext.get().partitionId() << _BITS
        rows: list[tuple] = []

        def placed(sequences: Iterator[list[tuple]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for doc, start, ids, tokens in sequence:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), tokens, number, at) + ((bytes(ids),) if with_ids else ()))
                    at += n
                number += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])

        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts(part)), strict=True):
                    whole = memoryview(ids + end)
                    tokens = len(whole) // 4
                    cut = tokens // capacity * capacity
                    placed([(doc, at, whole[4 * at : 4 * (at + capacity)], tokens)] for at in range(0, cut, capacity))
                    if cut < tokens:
                        waiting.put((doc, cut, whole[4 * cut :] if not cut else memoryview(bytes(whole[4 * cut :])), tokens))
                    if waiting.tokens >= high:
                        placed(waiting.sequences(capacity, high // 2))
                if rows:
                    yield batch_of()
        placed(waiting.sequences(capacity, 0))
        placed(waiting.rest())
        yield batch_of()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op13_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens that need no padding."""
    return pack_documents(table(spark, sf_dir, "documents"))

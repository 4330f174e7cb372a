"""Removal of lines that recur across documents, by a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their
lines, except in the document with the largest id among those that hold it.

1. Keys are digested to 128 bits where the text is read. Distinct pairs of key and document are counted by key, pairs first,
   so that a line of a third of all documents is spread over the tasks.
2. Digests that reach ``min_docs`` are dealt to shards of about ``keys_per_shard``; each shard
   becomes a minimal perfect hash with a 64-bit fingerprint, a count and a largest id for each number.
3. Documents' lines probe the arrays. Up to ``broadcast_bytes`` of arrays go to where the texts are read, and no text
   moves. Beyond that the digests of the lines are sent to their shard (hot shards in as many copies as
   their rows need), stream past its arrays, and come back as numbers of lines to drop.

Defined results: a null or empty text is one empty line; texts of any length are taken whole; documents are counted by their ids: rows of one id
count once, and all keep the line if their id is the largest; rows without an id count for no line and rank below all
others; an empty table gives an empty result; ``dedup_lines`` carries the row along as a struct, whatever its columns' names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import STEP_BYTES, raw, steps
from ._store import saved, table
from .mph import MinimalPerfectHash

MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 500_000
ROWS_PER_COPY = 500_000
BROADCAST_BYTES = 32 << 20
_NO_ID = -(2**63)
_ALL = (0, 0)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip().lower()  # on bytes, both know ASCII only
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _is_all() -> Column:
    return (F.col("h1") == 0) & (F.col("h2") == 0)


def _digest(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The text, the id, and a digest of both that names the row (equal rows share their fate)."""
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.xxhash64(own, text, F.lit(1)).alias("r1"), F.xxhash64(F.lit(2), text, own).alias("r2"), F.coalesce(own, F.lit(_NO_ID)).alias("own"), text.alias("text"))


def key_counts(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``h1, h2, n, last, lines`` of the keys that stand in enough documents; digest 0, 0 has the number of all lines with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int, int], int] = {}
            total = 0
            for part in steps(batch, "text"):
                for own, text in zip(part.column("own").to_pylist(), raw(part), strict=True):
                    for line in text.split(b"\n"):
                        if (key := line_key(line, min_chars)) is not None:
                            pair = (*_digest(key), own)
                            found[pair] = found.get(pair, 0) + 1
                            total += 1
            found[*_ALL, _NO_ID] = total
            h = np.array(list(found), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (*h.T, np.array(list(found.values()), np.int64))], ["h1", "h2", "own", "lines"])

    pairs = rows.select("own", "text").mapInArrow(run, "h1 long, h2 long, own long, lines long")
    pairs = pairs.groupBy("h1", "h2", "own").agg(F.sum("lines").alias("lines"))
    counted = pairs.groupBy("h1", "h2").agg(F.count(F.when(F.col("own") != _NO_ID, 1)).alias("n"), F.max("own").alias("last"), F.sum("lines").alias("lines"))
    return counted.where((F.col("n") >= min_docs) | _is_all())


INDEX = "shard int, keys long, rows long, hash binary, fingerprints binary, counts binary, lasts binary"


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row for each shard: the perfect hash and the arrays that its numbers point into."""

    def build(group: pa.Table) -> pa.Table:
        h1, h2, n, last, lines = (group.column(c).to_numpy() for c in ("h1", "h2", "n", "last", "lines"))
        a, b = h1.view(np.uint64), h2.view(np.uint64)
        own = MinimalPerfectHash.build(a, b)
        order = np.argsort(own.lookup(a, b))
        arrays = [pa.array([x], t) for x, t in ((group.column("shard")[0].as_py(), pa.int32()), (len(a), pa.int64()), (int(lines.sum()), pa.int64()), (own.to_bytes(), pa.binary()))]
        arrays += [pa.array([x[order].tobytes()], pa.binary()) for x in (b, np.minimum(n, 2**32 - 1).astype("<u4"), last)]
        return pa.Table.from_arrays(arrays, [x.split()[0] for x in INDEX.split(", ")])

    return counts.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, INDEX)


class Shard:
    """A shard's arrays, to be probed."""

    def __init__(self, packed: bytes, fingerprints: bytes, counts: bytes, lasts: bytes):
        self.hash = MinimalPerfectHash.from_bytes(packed)
        self.fingerprints, self.counts, self.lasts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(lasts, "<i8")

    def drops(self, h1: np.ndarray, h2: np.ndarray, own: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines fall."""
        at = self.hash.lookup(h1.view(np.uint64), h2.view(np.uint64))
        out = at >= 0
        k = at[out]
        out[out] = (self.fingerprints[k] == h2.view(np.uint64)[out]) & (self.counts[k] >= min_docs) & (self.lasts[k] != own[out])
        return out


def keyed_lines(rows: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the texts' lines with a key, the texts' places in ``rows``, and the lines' numbers."""
    h, at, numbers = [], [], []
    for i, text in enumerate(rows):
        for k, line in enumerate(text.split(b"\n")):
            if (key := line_key(line, min_chars)) is not None:
                h.append(xxhash.xxh3_128_digest(key))
                at.append(i)
                numbers.append(k)
    return np.frombuffer(b"".join(h), "<i8").reshape(-1, 2), np.array(at, np.int64), np.array(numbers, np.int64)


_PROBE = ("h1", "h2", "r1", "r2", "own", "line")


def dropped_lines(rows: DataFrame, index: DataFrame, n_shards: int, n_keys: int, min_chars: int, min_docs: int, rows_per_copy: int) -> DataFrame:
    """``r1, r2, drops``: the numbers of the lines that fall, for the rows that lose any."""
    # a shard gets its own keys' lines and its share of those that no shard holds
    salts = F.ceil((F.col("rows") + F.lit(n_keys // n_shards)) / F.lit(rows_per_copy)).cast("int") + 1
    copies = index.select("shard", salts.alias("copies"))  # one row for each shard

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                pair, take, numbers = keyed_lines(raw(part), min_chars)
                rest = [part.column(c).to_numpy()[take] for c in ("r1", "r2", "own")]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (pair[:, 0], pair[:, 1], *rest, numbers)], list(_PROBE))

    probes = rows.mapInArrow(lines, ", ".join(f"{c} long" for c in _PROBE))
    # lines of shards without keys need no probe
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).join(copies, "shard")
    probes = probes.select("shard", F.pmod(F.col("r1"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), *_PROBE, *(F.lit(None).cast("binary").alias(c) for c in ("hash", "fingerprints", "counts", "lasts")))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("copy"), F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in _PROBE), "hash", "fingerprints", "counts", "lasts")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            h1, h2, r1, r2, own, line = (batch.column(c).to_numpy() for c in _PROBE)
            heads = np.flatnonzero(kind == 0)
            for at, end in zip([-1, *heads.tolist()], [*heads.tolist(), len(kind)], strict=True):
                if at >= 0:
                    shard = Shard(*(batch.column(c)[at].as_py() for c in ("hash", "fingerprints", "counts", "lasts")))
                cut = slice(at + 1, end)
                if at + 1 < end:
                    fall = shard.drops(h1[cut], h2[cut], own[cut], min_docs)
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut][fall]) for x in (r1, r2, line)], ["r1", "r2", "line"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards, n_keys // rows_per_copy)
    dealt = arrays.unionByName(probes).repartition(n, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return dealt.mapInArrow(probe, "r1 long, r2 long, line long").groupBy("r1", "r2").agg(F.collect_set("line").alias("drops"))


KEPT = "kept string, n_lines long, n_dropped long"


def _without(rows: list[str], falls: list) -> object:
    """What stays of texts whose lines of the given numbers (or None) fall."""
    import pandas as pd

    out = []
    for text, fall in zip(rows, falls, strict=True):
        if fall is None or not len(fall):
            out.append((text, text.count("\n") + 1, 0))
        else:
            fall, lines = set(fall), text.split("\n")
            out.append(("\n".join([x for k, x in enumerate(lines) if k not in fall]), len(lines), len(fall)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


def kept_in_place(docs: DataFrame, text: Column, own: Column, index: DataFrame, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """``doc, k``: rows probe broadcast arrays where they are read."""
    arrays = docs.sparkSession.sparkContext.broadcast({r["shard"]: (r["hash"], r["fingerprints"], r["counts"], r["lasts"]) for r in index.collect()})
    shards: dict[int, Shard] = {}

    @F.pandas_udf(KEPT)
    def keep(text, own):  # noqa: ANN001, ANN202
        import pandas as pd

        if not shards:
            shards.update({k: Shard(*x) for k, x in arrays.value.items()})
        rows, ids, out, at = text.tolist(), own.to_numpy(), [], 0
        while at < len(rows):
            stop, size = at, 0
            while stop < len(rows) and (stop == at or size < STEP_BYTES):
                size += len(rows[stop])
                stop += 1
            pair, row, number = keyed_lines([x.encode() for x in rows[at:stop]], min_chars)
            h1, h2 = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
            shard, falls = np.mod(h1, n_shards), np.zeros(len(h1), bool)
            for k, known in shards.items():
                here = np.flatnonzero(shard == k)
                if len(here):
                    falls[here] = known.drops(h1[here], h2[here], ids[at:stop][row[here]], min_docs)
            each: list = [None] * (stop - at)
            for i, k in zip(row[falls].tolist(), number[falls].tolist(), strict=True):
                each[i] = [*(each[i] or ()), k]
            out.append(_without(rows[at:stop], each))
            at = stop
        return pd.concat(out, ignore_index=True) if out else _without([], [])

    return docs.select(F.struct("*").alias("doc"), keep(text, own).alias("k"))


def kept_by_shards(docs: DataFrame, text: Column, own: Column, drops: DataFrame) -> DataFrame:
    """``doc, k``: rows meet the numbers of their lines that fall."""
    named = docs.select(F.struct("*").alias("doc"), text.alias("text"), F.xxhash64(own, text, F.lit(1)).alias("r1"), F.xxhash64(F.lit(2), text, own).alias("r2"))

    @F.pandas_udf(KEPT)
    def keep(text, drops):  # noqa: ANN001, ANN202
        return _without(text.tolist(), drops.tolist())

    return named.join(drops, ["r1", "r2"], "left").select("doc", keep("text", "drops").alias("k"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text_col: str = "text", id_col: str = "doc_id", keys_per_shard: int = KEYS_PER_SHARD, rows_per_copy: int = ROWS_PER_COPY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc`` (the row as a struct), ``kept`` (the text of the lines that stay), ``n_lines`` and ``n_dropped``."""
    rows = _rows(docs, text_col, id_col)
    counts, _ = saved(key_counts(rows, min_chars, min_docs), "line-counts")
    n_keys = sum(r["lines"] for r in counts.where(_is_all()).collect())
    counts = counts.where(~_is_all())
    n_shards = max(1, math.ceil(counts.count() / keys_per_shard))
    index, _ = saved(build_index(counts, n_shards), "line-index")
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("hash", "fingerprints", "counts", "lasts")))).first()[0] or 0
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    if size <= broadcast_bytes:
        done = kept_in_place(docs, text, F.coalesce(own, F.lit(_NO_ID)), index, n_shards, min_chars, min_docs)
    else:
        done = kept_by_shards(docs, text, own, dropped_lines(rows, index, n_shards, n_keys, min_chars, min_docs, rows_per_copy))
    return done.select("doc", "k.kept", "k.n_lines", "k.n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, as a digest."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS falls FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE falls) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT falls), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

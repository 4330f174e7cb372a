"""Stupid-backoff scores of documents under the corpus's own n-gram counts, trigrams unless told otherwise.

A token's k-gram, for the largest k up to ``order`` with a k-gram that stands ``min_count`` times or more in the corpus (single
words always do), scores ``alpha ** (order - k) * c(k-gram) / c(context)``; the context of a single word is the
corpus. A document's score is the sum of the logarithms. Texts begin with ``order - 1`` start marks; ``c(context)`` counts it
where a token follows. All documents are counted and all are scored.

1. The n-grams of all orders of a step of texts are exploded to one row for each distinct n-gram with its count there, so a
   very common n-gram is one row a step, whoever holds it. They are dealt by ranges of their hash to the parts of the count table.
2. A part is grouped by n-gram; the totals are its share of the count table, and they are joined back to the steps' rows.
3. Totals return to their steps, every token gets its counts, and logarithms are summed per document.

Rows travel as columns: sorted hashes as differences (whole 64 bits, about 45 of them after that), counts as bytes. As rows of
their own they would take more than six times the input of disk.

The texts are read twice and must come in the same order both times; what does not is told by the sizes and fails. ``stored`` says that
``docs`` are files as they lie; all else is written first.

Defined results: a text without words (null, empty, signs only) has 0 tokens, sum 0 and a null score; repeated rows are counted and
scored each; rows without an id keep a null id; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._arrow import groups, steps, texts
from ._store import saved, table
from .mph import mix

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Tokens of a part of the count table, and text bytes of a step.
TOKENS_PER_PART, STEP_BYTES = 2_000_000, 6 << 20
_START = np.uint64(0x5BD1E9955BD1E995)


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) ^ mix(y))


def grams_of(hashes: np.ndarray, heads: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each word; ``heads`` are the texts' first words."""
    out = [hashes]
    for k in range(1, order):
        context = np.empty_like(hashes)
        context[1:] = out[-1][:-1]
        context[heads] = _START + np.uint64(k)
        out.append(pair_hash(context, hashes))
    return out


def heads_of(n_tokens: np.ndarray) -> np.ndarray:
    """First words of the texts that have words."""
    return (np.cumsum(n_tokens) - n_tokens)[n_tokens > 0]


# ---- columns as bytes ----


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, in as many bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    own = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + np.ascontiguousarray(own.T).tobytes())


def _unplanes(data: bytes, n: int) -> np.ndarray:
    got = zstandard.ZstdDecompressor().decompress(data)
    out = np.zeros((n, 8), np.uint8)
    out[:, : got[0]] = np.frombuffer(got, np.uint8, offset=1).reshape(got[0], n).T
    return out.view("<u8").reshape(-1)


def _ascending(values: np.ndarray) -> bytes:
    """Ascending numbers (one at least): the first, then the differences."""
    return int(values[0]).to_bytes(8, "little") + _planes(np.diff(values))


def _unascending(data: bytes, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = int.from_bytes(data[:8], "little")
    out[1:] = _unplanes(data[8:], n - 1)
    return np.cumsum(out, dtype=np.uint64)


def part_bounds(n_parts: int) -> np.ndarray:
    """Where each part's hashes begin, by their upper 32 bits."""
    return np.array([-(-(p << 32) // n_parts) for p in range(n_parts + 1)], np.uint64)


# ---- the tables ----

GRAMS = "step long, part int, level int, size int, hashes binary, counts binary, ends binary"
TOTALS = "step long, level int, part int, size int, a binary, b binary, tokens long, texts long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])


def step_grams(rows: DataFrame, order: int, n_parts: int) -> DataFrame:
    """The distinct n-grams of each step by level and part, with their counts and, below the highest order, how many end a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = part_bounds(n_parts)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                words = _words.split(texts(part))
                step, n_tokens = part.column("row")[0].as_py(), np.diff(words.first)
                last = words.first[1:][n_tokens > 0] - 1
                for level, own in enumerate(grams_of(words.hash, heads_of(n_tokens), order), 1):
                    distinct, counts = np.unique(own, return_counts=True)
                    ends = np.zeros(len(distinct), np.uint64)
                    if level < order:
                        ended, n = np.unique(own[last], return_counts=True)
                        ends[np.searchsorted(distinct, ended)] = n
                    cuts = np.searchsorted(distinct >> np.uint64(32), bounds)
                    out = []
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        s, e = int(cuts[p]), int(cuts[p + 1])
                        out.append((step, p, level, e - s, _ascending(distinct[s:e]), _planes(counts[s:e]), _planes(ends[s:e])))
                    for k in range(0, len(out), 512):
                        yield _batch(out[k : k + 512], GRAMS)

    return rows.mapInArrow(run, GRAMS)


def gram_totals(grams: DataFrame, n_parts: int) -> DataFrame:
    """The count table, part by part, joined to the rows it was made of: totals in the order of each row's n-grams.

    The first row of a part of single words also has the part's tokens and texts' ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["part", "level"]):
            step, size = group.column("step").to_pylist(), group.column("size").to_pylist()
            part, level = group.column("part")[0].as_py(), group.column("level")[0].as_py()
            read = lambda name, of: np.concatenate([of(x.as_py(), n) for x, n in zip(group.column(name), size, strict=True)])  # noqa: B023, E731
            hashes = read("hashes", _unascending)
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            times = np.diff(np.append(first, len(order)))
            del hashes
            joined = []
            for name in ("counts", "ends"):
                own = read(name, _unplanes)
                total = np.add.reduceat(own[order], first)
                own[order] = np.repeat(total, times)
                joined.append((own, int(total.sum()) if level == 1 else 0))
            out, s = [], 0
            for k, (x, n) in enumerate(zip(step, size, strict=True)):
                out.append((x, level, part, n, *(_planes(own[s : s + n]) for own, _ in joined), *(0 if k else total for _, total in joined)))
                s += n
            for k in range(0, len(out), 512):
                yield _batch(out[k : k + 512], TOTALS)

    return grams.repartitionById(n_parts, "part").sortWithinPartitions("part", "level", "step").mapInArrow(run, TOTALS)


def step_texts(rows: DataFrame) -> DataFrame:
    """As level 0 the steps' texts: ids and numbers of words, and the words as numbers into the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                words, ids = _words.split(texts(part)), part.column("doc_id")
                distinct, number = np.unique(words.hash, return_inverse=True)
                head = np.concatenate([ids.fill_null(0).to_numpy().view(np.uint64), np.array(ids.is_null()).astype(np.uint64), np.diff(words.first).astype(np.uint64)])
                known = _ascending(distinct) if len(distinct) else b""
                body = len(distinct).to_bytes(8, "little") + len(known).to_bytes(8, "little") + known + _planes(number.astype(np.uint64))
                yield _batch([(part.column("row")[0].as_py(), 0, 0, words.n, _planes(head), body, 0, 0)], TOTALS)

    return rows.mapInArrow(run, TOTALS)


def step_scores(rows: DataFrame, order: int, alpha: float, min_count: int, n_tokens: int, n_texts: int) -> DataFrame:
    """``doc_id, n_tokens, log_sum`` from the texts and totals of steps; ``n_texts`` have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["step"]):
            level, size = (group.column(c).to_numpy() for c in ("level", "size"))
            a, b = group.column("a"), group.column("b")
            if not len(level) or level[0] or (level[1:] == 0).any():
                raise ValueError("the texts of a step changed between two readings")
            n = int(size[0])
            head = _unplanes(a[0].as_py(), 3 * n).reshape(3, n)
            each = head[2].astype(np.int64)
            body, total = b[0].as_py(), int(each.sum())
            n_known, width = (int.from_bytes(body[k : k + 8], "little") for k in (0, 8))
            number = _unplanes(body[16 + width :], total).astype(np.int64)
            hashes = _unascending(body[16 : 16 + width], n_known)[number] if n_known else np.zeros(0, np.uint64)
            heads, values, open_ = heads_of(each), np.zeros(total), np.ones(total, bool)
            counted: list[tuple[np.ndarray, np.ndarray]] = []
            for k, own in enumerate(grams_of(hashes, heads, order), 1):
                place = number if k == 1 else np.unique(own, return_inverse=True)[1]
                at = np.flatnonzero(level == k)
                if int(size[at].sum()) != (int(place.max()) + 1 if total else 0):
                    raise ValueError("the texts of a step changed between two readings")
                got = [np.concatenate([np.zeros(0, np.uint64), *(_unplanes(col[p].as_py(), int(size[p])) for p in at.tolist())]).astype(np.int64)[place] for col in (a, b)]
                counted.append((got[0], got[0] - got[1]))  # as a whole, and where a token follows
            for k in range(order, 0, -1):
                own = counted[k - 1][0]
                context = np.full(total, n_tokens)
                if k > 1:
                    context[1:] = counted[k - 2][1][:-1]
                    context[heads] = n_texts
                here = open_ & ((own >= min_count) | (k == 1))
                values[here] = (order - k) * math.log(alpha) + np.log(own[here]) - np.log(context[here])
                open_ &= ~here
            doc = np.repeat(np.arange(n), each)
            ids = pa.array(head[0].view(np.int64), pa.int64(), mask=head[1].astype(bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(each), pa.array(np.bincount(doc, weights=values, minlength=n), pa.float64())], ["doc_id", "n_tokens", "log_sum"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "step").sortWithinPartitions("step", "level", "part").mapInArrow(run, "doc_id long, n_tokens long, log_sum double")


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, tokens_per_part: int = TOKENS_PER_PART, text_col: str = "text", id_col: str = "doc_id", stored: bool = False) -> DataFrame:
    """``doc_id, n_tokens, log_sum, score``: the sum of the tokens' logarithms and its mean."""
    if order < 1:
        raise ValueError("order is 1 or more")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not stored:
        own, _ = saved(own, "lm-texts")
    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, math.ceil(size / 6 / tokens_per_part))  # a token and what parts it have about six bytes
    totals, _ = saved(gram_totals(step_grams(rows, order, n_parts), n_parts), "gram-totals")
    n_tokens, n_texts = (x or 0 for x in totals.where("level = 1").agg(F.sum("tokens"), F.sum("texts")).first())
    found = step_scores(totals.unionByName(step_texts(rows)), order, alpha, min_count, n_tokens, n_texts)
    return found.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_sum") / F.col("n_tokens")))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, rounded so that the order of sums does not show."""
    out = lm_scores(table(spark, sf_dir, "documents", dealt=False), stored=True)
    return out.select("doc_id", "n_tokens", F.round("log_sum", 6).alias("log_sum"), F.round("score", 8).alias("score"))


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\x{80}-\x{10FFFF}]+') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
token AS (SELECT doc_id, CASE WHEN i < 3 THEN '' ELSE w[i - 2] END AS x, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS y, w[i] AS z FROM numbered),
three AS (SELECT x, y, z, count(*) AS n FROM token GROUP BY ALL),
before_three AS (SELECT x, y, count(*) AS n FROM token GROUP BY ALL),
two AS (SELECT y, z, count(*) AS n FROM token GROUP BY ALL),
before_two AS (SELECT y, count(*) AS n FROM token GROUP BY ALL),
one AS (SELECT z, count(*) AS n FROM token GROUP BY ALL),
scored AS (
  SELECT doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n) - ln(b3.n) WHEN c2.n >= 2 THEN ln(0.4) + ln(c2.n) - ln(b2.n) ELSE 2 * ln(0.4) + ln(c1.n) - ln((SELECT count(*) FROM token)) END AS v
  FROM token JOIN three c3 USING (x, y, z) JOIN before_three b3 USING (x, y) JOIN two c2 USING (y, z) JOIN before_two b2 USING (y) JOIN one c1 USING (z)),
summed AS (SELECT doc_id, count(*) AS n, sum(v) AS v FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(v, 0.0), 6) AS log_sum, round(v / n, 8) AS score FROM documents d LEFT JOIN summed USING (doc_id)
"""

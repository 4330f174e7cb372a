"""Quality scores by a regularised quadratic discriminant over document statistics.

Every text becomes a vector of transformed statistics. For each class the labelled
rows' count, mean and covariance come from distributed sums; covariances are shrunk
towards the pooled covariance and that towards its own diagonal; the inverses of their Cholesky factors are
cached once and give the Mahalanobis distances of whole batches. A score is the logistic
function of the damped difference of the two log densities and priors.

Defined results: a null or empty text has the statistics of no words and gets a score; ids that occur several times
are each learned from and scored; rows without an id are scored, not learned from; labels that are
neither 0 nor 1 are left out; without labels of both classes the score is the share of label 1 (0.5 without
labels); an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._arrow import steps, texts
from ._store import saved, table

FEATURES = ("words", "letters_a_word", "upper", "digits", "marks", "symbols", "repeats", "distinct", "words_a_line", "same_lines", "long_words", "words_a_sentence")
#: Shares of the pooled covariance in each class's, and of the diagonal in the pooled one.
POOL, DIAGONAL = 0.3, 0.05
#: The log odds are divided by this, as the statistics are no true Gaussians.
DAMPING = 3.0
THRESHOLD = 0.3
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b".,;:'\"-()?", "space": b" \t\n\r\x0b\x0c"}


def _table_of_kinds() -> np.ndarray:
    out = np.full(256, 5, np.uint8)  # other signs
    for code in range(256):
        if code >= 128 or chr(code).islower() or code == 95:
            out[code] = 4
        for k, chars in enumerate(_KINDS.values()):
            if code in chars:
                out[code] = k
    return out


_KIND = _table_of_kinds()


def statistics(rows: list[str]) -> np.ndarray:
    """One row of features for each text."""
    n = len(rows)
    raw = [t.encode("utf-8", "surrogatepass") for t in rows]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    kinds = _KIND[data]

    full = np.flatnonzero(size)
    between = np.append(starts[full][1:], len(data)) - ends[full] + 1  # line ends after a text, up to the next one that is not empty

    def per_text(hits: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(hits, starts[full], dtype=np.int64)
        return out

    upper, digits, marks, symbols = (per_text(kinds == k) for k in (0, 1, 2, 5))
    space = per_text(kinds == 3)
    space[full] -= between
    black = np.maximum(size - space, 1)
    stops = per_text(data == 46)
    words = _words.split(rows)
    count = np.diff(words.first).astype(float)
    safe = np.maximum(count, 1)
    length = words.end - words.start
    by_doc = lambda values: np.bincount(words.doc, weights=values, minlength=n)
    letters = by_doc(length.astype(float))
    long_words = by_doc((length > 12).astype(float))
    again = np.zeros(len(words.hash))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = by_doc(again)
    order = np.lexsort((words.hash, words.doc))
    new = np.ones(len(order), bool)
    h, d = words.hash[order], words.doc[order]
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    lines = np.empty(n)
    same = np.empty(n)
    for i, t in enumerate(raw):
        own = [x for x in t.split(b"\n") if x]
        lines[i], same[i] = max(1, len(own)), len(own) - len(set(own))
    root = lambda part, whole: np.sqrt(part / whole)
    return np.column_stack([
        np.log1p(count), np.log1p(letters / safe), root(upper, black), root(digits, black), root(marks, black), root(symbols, black),
        root(repeats, safe), np.log(np.maximum(distinct, 1) / safe) / (1 + np.log1p(count)), np.log1p(count / lines), root(same, lines), root(long_words, safe), np.log1p(count / (1 + stops)),
    ])


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, x`` (an array of doubles) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 2 << 20):
                x = statistics(texts(part))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of two classes."""

    means: np.ndarray
    inverses: np.ndarray
    logdets: np.ndarray
    priors: np.ndarray
    damping: float = DAMPING

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL, damping: float = DAMPING) -> Discriminant | float:
        """From each class's count, sum of vectors and sum of outer products; the share of label 1 if a class is missing."""
        if counts.min() < 2:
            return float(counts[1] / counts.sum()) if counts.sum() else 0.5
        means = sums / counts[:, None]
        scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / counts.sum()
        floor = 1e-6 + 1e-3 * np.diag(pooled).mean()
        pooled = (1 - diagonal) * pooled + np.diag(diagonal * np.diag(pooled) + floor)
        covariances = (1 - pool) * scatter / counts[:, None, None] + pool * pooled
        factors = np.linalg.cholesky(covariances)
        return cls(means, np.linalg.inv(factors), 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1), np.log(counts / counts.sum()), damping)

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, inverse, logdet, prior in zip(self.means, self.inverses, self.logdets, self.priors, strict=True):
            z = inverse @ (x - mean).T
            logs.append(prior - (logdet + (z * z).sum(0)) / 2)
        return 1 / (1 + np.exp(np.clip(-(logs[1] - logs[0]) / self.damping, -700, 700)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Ids whose digest leaves no remainder; false for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(vectors: DataFrame, labels: DataFrame, label_col: str = "quality", **kw: float) -> Discriminant | float:
    """From the labelled rows that are not held out: ``vectors`` is ``doc_id, x``, ``labels`` has ``doc_id`` and the label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out())
    rows = vectors.join(own, "doc_id")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        n = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel())], ["y", "k", "v"])

    got = rows.select("y", "x").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in got:
        total[r["y"], r["k"]] = r["v"]
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), **kw)


def score(vectors: DataFrame, model: Discriminant | float) -> DataFrame:
    """``doc_id, score`` for ``doc_id, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                found = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    vectors, _ = saved(features(table(spark, sf_dir, "documents")), "statistics")
    out = score(vectors, fit(vectors, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Centroid clustering with adaptive distance bounds.

Every vector keeps its cluster, an upper bound of the distance to that cluster's centroid, its several nearest other centroids with a lower bound of the
distance to each, and one lower bound for all centroids besides. When centroids have moved, upper bounds grow and lower bounds shrink by the
distances moved. A vector whose upper bound is under all its lower bounds stays where it is. Otherwise its own distance is taken exactly; then the listed
centroids whose bounds are not above it are compared exactly, and all centroids where the bound of the rest is not above it either. Bounds carry
a margin for rounding, and a tie is never certified, so the clusters are those of a full comparison. The list holds a quarter of the centroids at first, then as many as
any vector needed in the round before, an eighth at least.

Each round is one map over the vectors with their bounds, written to the shared folder in place of the round before; the sums of the clusters are added
up in the tasks, and then by cluster. Only centroids, at most ``k`` rows, come to the driver and go to the tasks.

Vectors are whole numbers, so distances, sums and means are exact: a component ``x`` becomes ``floor(scale * x)``; beyond ``LARGEST`` it counts as that.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite component are left out; repeated rows are vectors of their
own; vectors without an id are clustered, and come last among the first centroids; equal ids come by their components; with fewer vectors than ``k``
each is a first centroid; of equally near centroids the smaller number counts; an empty centroid stays where it is; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import forget, saved, table

K, ROUNDS, SCALE, DIMS, SALT = 40, 5, 256, 64, 2
#: Largest magnitude of a component, so that sums of squares stay in 64 bits.
LARGEST = 1 << 26
#: Magnitude up to which sums of squares are exact in doubles.
_DOUBLES = 1 << 22
#: Vectors that a worker compares at a time.
_ROWS = 2048
_STATE = "vec_id long, vec binary, cluster int, distance long, upper double, near binary, lower binary, rest double, depth int"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, v``: the vectors that are kept, in whole numbers."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = F.lit(float(LARGEST))
    return own.where((F.size("v") == dims) & finite).select("vec_id", F.transform("v", lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x).cast("double"), -limit), limit).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: int) -> np.ndarray:
    """The vectors of least digest."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def _packed(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    n, width = len(a), a.shape[1] * a.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _rows_of(column: pa.Array, dtype: str) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return data.reshape(len(column), -1)


def squared(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to as many centroids, or to each of several."""
    return ((a - c) ** 2).sum(-1)


@dataclass
class Bounds:
    """Of vectors: cluster and its exact distance if known (else -1), upper bound, listed centroids with lower bounds, ascending, and the rest's bound."""

    cluster: np.ndarray
    distance: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    depth: np.ndarray

    @classmethod
    def full(cls, v: np.ndarray, centroids: np.ndarray, listed: int) -> Bounds:
        """By comparison with all centroids."""
        n, k = len(v), len(centroids)
        if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= _DOUBLES:
            a, c = v.astype(float), centroids.astype(float)
            d = np.rint((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
        else:
            d = np.stack([squared(v, x) for x in centroids], 1)
        order = np.argsort(d, axis=1, kind="stable")
        ranked = np.take_along_axis(d, order, 1)
        listed = min(listed, k - 1)
        rest = np.sqrt(ranked[:, listed + 1]) if listed + 1 < k else np.full(n, np.inf)
        return cls(order[:, 0].astype(np.int32), ranked[:, 0], np.sqrt(ranked[:, 0]), order[:, 1 : listed + 1].astype(np.uint16), np.sqrt(ranked[:, 1 : listed + 1]), rest, np.full(n, listed, np.int32))

    def moved(self, v: np.ndarray, centroids: np.ndarray, drift: np.ndarray, listed: int, exact: bool) -> None:
        """After the centroids moved by ``drift``; with ``exact`` every vector's own distance is taken."""
        n = len(v)
        self.upper += drift[self.cluster]
        self.lower -= drift[self.near]
        self.rest -= drift.max(initial=0)
        self.distance[:] = -1
        self.depth[:] = 0
        if self.near.shape[1] > listed:
            self._sort(np.arange(n))
            self.rest = np.minimum(self.rest, self.lower[:, listed])
            self.near, self.lower = self.near[:, :listed].copy(), self.lower[:, :listed].copy()
        rows = np.arange(n) if exact else np.flatnonzero(~self._certain(np.arange(n)))
        own = squared(v[rows], centroids[self.cluster[rows]])
        self.distance[rows], self.upper[rows] = own, np.sqrt(own)
        rows = rows[~self._certain(rows)]
        everything = ~self._above(rows, self.rest[rows])
        self._rescan(v, centroids, rows[~everything])
        if len(rows := rows[everything]):
            new = Bounds.full(v[rows], centroids, self.near.shape[1])
            for name in ("cluster", "distance", "upper", "near", "lower", "rest", "depth"):
                getattr(self, name)[rows] = getattr(new, name)

    def _above(self, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a lower bound is above the upper one by more than rounding."""
        upper = self.upper[rows]
        return bound > (upper + 1e-9 * (1 + upper) if bound.ndim == 1 else (upper + 1e-9 * (1 + upper))[:, None])

    def _certain(self, rows: np.ndarray) -> np.ndarray:
        least = self.lower[rows].min(1, initial=np.inf)
        return self._above(rows, np.minimum(least, self.rest[rows]))

    def _sort(self, rows: np.ndarray) -> None:
        order = np.argsort(self.lower[rows], axis=1, kind="stable")
        self.near[rows], self.lower[rows] = np.take_along_axis(self.near[rows], order, 1), np.take_along_axis(self.lower[rows], order, 1)

    def _rescan(self, v: np.ndarray, centroids: np.ndarray, rows: np.ndarray) -> None:
        """Compare the listed centroids that are not certainly farther, in the order of their bounds."""
        self._sort(rows)
        doubtful = (~self._above(rows, self.lower[rows])).sum(1)
        self.depth[rows] = doubtful
        for m in np.unique(doubtful):
            at = rows[doubtful == m]
            near = self.near[at, :m].astype(np.int64)
            d = squared(v[at][:, None, :], centroids[near])
            names, all_d = np.concatenate([self.cluster[at][:, None], near], 1), np.concatenate([self.distance[at][:, None], d], 1)
            order = np.lexsort((names, all_d), axis=1)
            names, all_d = np.take_along_axis(names, order, 1), np.take_along_axis(all_d, order, 1)
            self.cluster[at], self.distance[at], self.upper[at] = names[:, 0], all_d[:, 0], np.sqrt(all_d[:, 0])
            self.near[at, :m], self.lower[at, :m] = names[:, 1:], np.sqrt(all_d[:, 1:])


def _advanced(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, listed: int, exact: bool) -> DataFrame:
    """The state of every vector: from whole vectors where ``drift`` is None, else from the state before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                if drift is None:
                    flat = batch.column("v").flatten().to_numpy()
                    v = flat.reshape(batch.num_rows, -1).astype(np.int64)
                    vec = _packed(v.astype("<i4"))
                    own = Bounds.full(v, centroids, listed)
                else:
                    vec = batch.column("vec")
                    v = _rows_of(vec, "<i4").astype(np.int64)
                    column = lambda name: batch.column(name).to_numpy().copy()  # noqa: B023, E731
                    width = len(batch.column("near")[0].as_py()) // 2
                    near, lower = (_rows_of(batch.column(c), t).copy() if width else np.zeros((batch.num_rows, 0), t) for c, t in (("near", "<u2"), ("lower", "<f8")))
                    own = Bounds(column("cluster"), column("distance"), column("upper"), near, lower, column("rest"), column("depth"))
                    own.moved(v, centroids, drift, listed, exact)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec, pa.array(own.cluster, pa.int32()), pa.array(own.distance, pa.int64()), pa.array(own.upper), _packed(own.near), _packed(own.lower), pa.array(own.rest), pa.array(own.depth, pa.int32())], _NAMES)

    return rows.mapInArrow(run, _STATE)


def cluster_sums(state: DataFrame, dims: int) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """Rows and componentwise sums of each cluster that has any, and the most listed centroids that a vector needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        depth = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, v = batch.column("cluster").to_numpy(), _rows_of(batch.column("vec"), "<i4").astype(np.int64)
            depth = max(depth, int(batch.column("depth").to_numpy().max()))
            order = np.argsort(cluster, kind="stable")
            names, first = np.unique(cluster[order], return_index=True)
            for c, n, s in zip(names.tolist(), np.diff([*first, len(order)]).tolist(), np.add.reduceat(v[order], first), strict=True):
                count[c], sums[c] = count.get(c, 0) + n, sums.get(c, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64())), pa.array([depth] * len(count), pa.int32())], ["cluster", "n", "sums", "depth"])

    own = state.select("cluster", "vec", "depth").mapInArrow(run, "cluster int, n long, sums array<long>, depth int")
    found = own.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums"), F.max("depth").alias("depth")).collect()  # k rows
    return {r["cluster"]: (r["n"], r["sums"]) for r in found}, max((r["depth"] for r in found), default=0)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that is kept, and the centroids."""
    rows = whole_vectors(vectors, dims, scale, vec_col, id_col)
    spark, centroids = rows.sparkSession, first_centroids(rows, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    least, listed = max(1, len(centroids) // 8), max(1, len(centroids) // 4)
    state, path = saved(_advanced(rows, centroids, None, listed, False), "vectors")
    for r in range(rounds):
        sums, depth = cluster_sums(state, dims)
        new = centroids.copy()
        for c, (n, s) in sums.items():
            new[c] = [x // n for x in s]
        drift = np.sqrt(squared(new, centroids).astype(float)) * (1 + 1e-9)
        listed, centroids = min(listed, max(least, depth)), new
        state, done = saved(_advanced(state, centroids, drift, listed, r + 1 == rounds), "vectors")
        forget(spark, path)
        path = done
    return state.select("vec_id", "cluster", "distance"), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors, with the inertia of each and of all."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings", dealt=False))
    told = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(r["cluster"], r["s"], sum(x["s"] for x in told), digests[r["cluster"]]) for r in told]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS (SELECT r, min({{'d': CAST(list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS best FROM kept k, c{i} GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    steps = [x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps]
    return "WITH " + ",\n".join(steps) + f"""
SELECT k.vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN kept k USING (r) JOIN c{ROUNDS} c ON c.c = best.c"""


OP12_SQL = _sql()

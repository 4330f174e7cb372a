import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from protloom.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, dims, scale=256, salt=2):
    """A full comparison in each round."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = np.array([v for _, v in sorted(kept, key=key)[:k]], np.int64)
    v = np.array([x for _, x in kept], np.int64)
    nearest = lambda: ((v[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        of = nearest().argmin(1)
        for j in set(of.tolist()):
            c[j] = v[of == j].sum(0) // (of == j).sum()
    d = nearest()
    return sorted(((i, int(a), int(x)) for (i, _), a, x in zip(kept, d.argmin(1), d.min(1), strict=True)), key=str), c


@pytest.mark.parametrize(("k", "spread"), [(40, 0.0), (40, 3.0), (3, 1.0), (1, 1.0), (200, 1.0)])
def test_equals_full_comparison(spark, k, spread):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(12, 6)) * spread
    rows = [(i, (middle[i % 12] + rng.normal(size=6)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[5][1]) for i in range(600, 900)]  # one very common vector
    got, c = ce.cluster(spark.createDataFrame(rows, SCHEMA), k=k, dims=6, rounds=4)
    want, centroids = plain(rows, k, 4, 6)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert c.tolist() == centroids.tolist()


def test_bounds_spare_comparisons_and_never_differ():
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(500, 8)) * 40).astype(np.int64)
    c = v[:16].copy()
    own, spared = ce.Bounds.full(v, c, 4), 0
    for step in range(8):
        new = c + rng.integers(-6, 7, c.shape)
        drift = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9)
        c = new
        own.moved(v, c, drift, 4 if step < 4 else 2, False)
        full = ce.Bounds.full(v, c, 4)
        assert (own.cluster == full.cluster).all()
        d = np.sqrt(((v[:, None] - c[None]) ** 2).sum(2))
        at = np.arange(len(v))
        assert (own.upper >= d[at, own.cluster] - 1e-6).all() and (own.lower <= d[at[:, None], own.near] + 1e-6).all()
        others = d.copy()
        others[at[:, None], own.near] = others[at, own.cluster] = np.inf
        assert (own.rest <= others.min(1) + 1e-6).all()
        spared += (own.distance == -1).sum()
    assert spared > 100


def test_large_components_stay_exact(spark):
    rows = [(i, [1e30 * (-1) ** i, i * 1e4, 3.0e38]) for i in range(9)]
    got, _ = ce.cluster(spark.createDataFrame(rows, SCHEMA), k=2, dims=3, rounds=2)
    assert {r["cluster"] for r in got.collect()} <= {0, 1} and all(r["distance"] >= 0 for r in got.collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, -0.5]), (7, [0.5, -0.5]), (7, [0.25, 0.0]), (None, [9.0, 9.0]), (8, [0.5, -0.5]), (9, [-0.001, 0.001])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("cluster"), F.lit("x").alias("v"), F.lit(2).alias("distance"))
    for k in (1, 2, 40):
        got, _ = ce.cluster(df, k=k, dims=2)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, 5, 2)[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ce.cluster(none)[0].collect() == []
    assert ce.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA))[0].collect() == []

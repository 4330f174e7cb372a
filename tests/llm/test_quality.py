import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from protloom.llm import quality as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in q.op7_quality(spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    own = [(scored[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(s["held_out"] for s, _ in own)
    assert np.mean([s["predicted"] == y for s, y in own]) > 0.95
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_equals_plain_numpy(spark, scored):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    x = {i: q.statistics([t])[0] for i, t in docs.items()}
    logs = []
    groups = [np.array([x[i] for i, y in labels if y == c]) for c in (0, 1)]
    n = sum(map(len, groups))
    pooled = sum(len(g) * np.cov(g.T, bias=True) for g in groups) / n
    floor = 1e-6 + 1e-3 * np.trace(pooled) / len(pooled)
    pooled = (1 - q.DIAGONAL) * pooled + q.DIAGONAL * np.diag(np.diag(pooled)) + floor * np.eye(len(pooled))
    rows = np.array([x[i] for i in sorted(x)])
    for g in groups:
        cov = (1 - q.POOL) * np.cov(g.T, bias=True) + q.POOL * pooled
        z = rows - g.mean(0)
        logs.append(np.log(len(g) / n) - (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)) / 2)
    want = 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / q.DAMPING, -700, 700)))
    assert np.allclose(want, [scored[i]["score"] for i in sorted(x)], atol=1e-6)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, "a"), (4, 1, "b"), (8, 0, "a"), (7, 0, "a"), (6, 1, "a"), (3, None, "a"), (None, 1, "a"), (5, 7, "a")], "doc_id long, quality int, text string")
    vectors = q.features(odd_docs)
    model = q.fit(vectors, labels)
    got = q.score(vectors, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert q.score(q.features(no_docs), model).collect() == []
    assert q.fit(vectors, labels.where("quality = 1")) == 1.0
    assert q.fit(vectors, labels.limit(0)) == 0.5
    assert {r["score"] for r in q.score(vectors, 0.5).collect()} == {0.5}


def test_statistics_do_not_depend_on_the_batch():
    rows = ["", "A b. C!! c\nc", "x" * 2_000_000, "é ñ\n\né ñ", "1 2 3"]
    assert np.allclose(q.statistics(rows), np.concatenate([q.statistics([r]) for r in rows]))


def test_held_out(spark):
    rows = spark.range(100).withColumnRenamed("id", "doc_id").withColumn("h", q.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert spark.createDataFrame([(None,)], "doc_id long").select(F.expr("1"), q.held_out().alias("h")).first()["h"] is False

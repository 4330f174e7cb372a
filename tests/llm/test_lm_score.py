import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from protloom.llm import lm_score as lm


def tokens(text):
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else " " for c in (text or "").lower()).split()


def plain_of_order(docs, order=3, alpha=0.4, min_count=2):
    """Stupid backoff by its definition, from the longest n-gram down."""
    grams, contexts, total = Counter(), Counter(), 0
    padded = [(i, [None] * (order - 1) + tokens(text)) for i, text in docs]
    for _, own in padded:
        total += len(own) - order + 1
        for at in range(order - 1, len(own)):
            for k in range(1, order + 1):
                grams[tuple(own[at - k + 1 : at + 1])] += 1
                contexts[tuple(own[at - k + 1 : at])] += 1
    out = []
    for i, own in padded:
        value = 0.0
        for at in range(order - 1, len(own)):
            k = next(k for k in range(order, 0, -1) if k == 1 or grams[tuple(own[at - k + 1 : at + 1])] >= min_count)
            value += math.log(alpha ** (order - k) * grams[tuple(own[at - k + 1 : at + 1])] / contexts[tuple(own[at - k + 1 : at])])
        out.append((i, len(own) - order + 1, value))
    return sorted(out, key=str)


def close(df, docs, **kw):
    got = sorted(((r["doc_id"], r["n_tokens"], r["log_sum"]) for r in df.collect()), key=str)
    want = plain_of_order(docs, **kw)
    assert sorted((str(g[0]), g[1]) for g in got) == sorted((str(w[0]), w[1]) for w in want)
    key = lambda x: (str(x[0]), x[1], round(x[2], 2))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[2] == pytest.approx(w[2], rel=1e-7, abs=1e-6)


@pytest.mark.parametrize(("order", "tokens_per_part"), [(3, 2_000_000), (3, 5_000), (2, 20_000), (4, 50_000), (1, 50_000)])
def test_equals_the_definition(spark, odd_docs, order, tokens_per_part):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3).unionByName(odd_docs.select("doc_id", "text"))
    close(lm.lm_scores(docs, order, tokens_per_part=tokens_per_part), [(r["doc_id"], r["text"]) for r in docs.collect()], order=order)


def test_other_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    close(lm.lm_scores(docs, alpha=0.1, min_count=4), rows, alpha=0.1, min_count=4)
    close(lm.lm_scores(docs, stored=True, tokens_per_part=9_000), rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    close(lm.lm_scores(odd_docs), rows)
    close(lm.lm_scores(odd_docs, tokens_per_part=1000), rows)
    assert {r["score"] for r in lm.lm_scores(odd_docs).where("n_tokens = 0").collect()} == {None}
    assert lm.lm_scores(no_docs).collect() == []


def test_many_short_rows_in_one_batch(spark):
    n = 100_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    try:
        docs = spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "concat('a', id % 7, ' b', id % 11, ' c', id % 13, ' d', id) AS text")
        close(lm.lm_scores(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_as_bytes():
    rng = np.random.default_rng(0)
    for top in (1, 2**40, 2**63):
        values = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (lm._unplanes(lm._planes(values), 1000) == values).all()
        values.sort()
        assert (lm._unascending(lm._ascending(values), 1000) == values).all()
    bounds = lm.part_bounds(7)
    assert bounds[0] == 0 and bounds[-1] == 2**32 and len(bounds) == 8


def test_a_changed_reading_fails(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    totals = lm.gram_totals(lm.step_grams(rows, 3, 1), 1)
    other = lm.step_texts(rows.withColumn("text", F.concat("text", F.lit(" another few words"))))
    with pytest.raises(Exception, match="changed between two readings"):
        lm.step_scores(totals.unionByName(other), 3, 0.4, 2, 100, 10).collect()

import sentencepiece
from pyspark.sql import functions as F

from protloom.llm import token_counts as tc
from protloom.llm._store import scratch


def plain(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=tc.tokenizer_path(tc.MODEL))
    return [len(model.encode(t or "")) for t in texts]


def test_counts_equal_the_library(spark, sf):
    got = {r["doc_id"]: r for r in tc.op2_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d, n in zip(docs, plain([d["text"] for d in docs]), strict=True):
        assert got[d["doc_id"]]["n_tokens"] == n
        assert got[d["doc_id"]]["n_bytes"] == len(d["text"].encode())
        assert got[d["doc_id"]]["over_limit"] == (n > 4096)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = tc.count_tokens(odd_docs, scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_tokens"] for r in got) == sorted(plain([r["text"] for r in rows]))
    assert tc.count_tokens(no_docs, scratch(spark, "t")).collect() == []


def test_only_distinct_misses_are_encoded(spark, odd_docs):
    path = scratch(spark, "t")
    tc.count_tokens(odd_docs.where("doc_id < 5"), path).collect()
    first = spark.read.parquet(path).count()
    assert first == 3  # null and empty share a digest, the copies too
    known = spark.read.parquet(path)
    marked = known.withColumn("n_tokens", F.col("n_tokens") + 1000).collect()
    path2 = scratch(spark, "t")
    spark.createDataFrame(marked, known.schema).write.partitionBy("tokenizer").parquet(path2)
    got = {(r["doc_id"], r["n_tokens"] >= 1000) for r in tc.count_tokens(odd_docs.where("doc_id < 5 or doc_id = 8"), path2).collect()}
    assert got == {(1, True), (2, True), (3, True), (4, True), (8, True)}
    assert spark.read.parquet(path2).count() == 3
    tc.count_tokens(odd_docs, path2).collect()
    assert spark.read.parquet(path2).count() == 7


def test_another_tokenizer_has_its_own_counts(spark, odd_docs):
    path = scratch(spark, "t")
    tc.count_tokens(odd_docs, path).collect()
    other = tc.count_tokens(odd_docs, path, model="byte_bpe_50k.json").collect()
    assert {r["n_tokens"] for r in other if r["doc_id"] == 4} == {2}


def test_where_texts_are_encoded_does_not_show(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(odd_docs.select("doc_id", "text"))
    want = sorted((str(d["doc_id"]), n) for d, n in zip(docs.collect(), plain([d["text"] for d in docs.collect()]), strict=True))
    for apart in (0, 10**6):
        path = scratch(spark, "t")
        tc.count_tokens(docs.where("doc_id % 2 = 0"), path, apart=apart).collect()
        got = tc.count_tokens(docs, path, apart=apart)
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == want
        cache = spark.read.parquet(path)
        assert cache.count() == cache.select("digest").distinct().count() == docs.selectExpr("coalesce(text, '') AS t").distinct().count()


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "y", 5, "z", 7)], "doc_id long, text string, digest string, content string, n_tokens int, keep string, key int")
    got = tc.count_tokens(rows, scratch(spark, "t"), keep=("doc_id", "digest", "content", "keep", "key")).drop("n_bytes", "n_tokens").first()
    assert tuple(got) == (1, "x", "y", "z", 7)


def test_the_stored_cache_is_not_moved(spark):
    """A batch's digests meet the cache where it is scanned; only what they have in common is dealt out."""
    stored = spark.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("n_tokens"))
    seen = stored.where("n_tokens % 100 = 0").unionByName(spark.createDataFrame([(b"x" * 32, 1)], "digest binary, n_tokens long")).select("digest", F.lit(1).alias("n"))
    want = {100 * k for k in range(20)}
    for apart in (1000, 3):
        assert {r["n_tokens"] for r in tc.cached(stored, seen, apart).collect()} == want
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = tc.cached(stored, seen, 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    above = plan[: plan.index("BroadcastHashJoin [xxhash64") if "BroadcastHashJoin [xxhash64" in plan else 0]
    assert above and "BroadcastExchange" in plan

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from protloom.llm import line_dedup as ld
from protloom.llm.mph import MinimalPerfectHash

STRIP = " \t\n\x0b\x0c\r"


def plain(docs, min_chars=40, min_docs=5):
    """By the definition; rows without an id are no documents and rank last."""
    rank = lambda i: -(2**63) if i is None else i
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.strip(STRIP).translate(lower)
    held, last = defaultdict(set), {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k] |= {i} - {None}
                last[k] = max(last.get(k, rank(i)), rank(i))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= min_docs and last[key(x)] != rank(i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(((r["doc"]["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in ld.dedup_lines(df, **kw).collect()), key=repr)


def test_equals_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(d["doc_id"], d["text"]) for d in docs.collect()])
    assert sum(x[3] for x in want) > 0
    assert run(docs) == want
    assert run(docs, keys_per_shard=3) == want
    assert run(docs, keys_per_shard=3, rows_per_copy=5, broadcast_bytes=0) == want
    assert run(docs, broadcast_bytes=0) == want


def test_query_is_the_digest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {x[0]: (x[2], x[3], hashlib.sha256(x[1].encode()).hexdigest()) for x in plain([(d["doc_id"], d["text"]) for d in docs.collect()])}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in ld.op9_line_dedup(spark, sf).collect()} == want


def test_edges(spark, odd_docs, no_docs):
    line = "É" + "Ab " * 12 + "Zé"
    rows = [(10 + k, f"\t{line}\x0b\r\nown {k}\n\n{line.lower().replace('é', 'É') if k == 0 else line}") for k in range(6)] + [(None, line), (15, line), (3, line + " ")]
    docs = odd_docs.select("doc_id", "text", "lang", F.col("size").alias("drops")).union(spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, lang string, drops int"))
    want = plain([(d["doc_id"], d["text"]) for d in docs.collect()])
    assert run(docs) == run(docs, broadcast_bytes=0) == want
    assert ld.dedup_lines(no_docs).collect() == ld.dedup_lines(no_docs, broadcast_bytes=0).collect() == []


def test_documents_are_counted_by_their_ids(spark):
    line = "the same line of more than forty characters, again"
    frame = lambda ids: spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string").repartition(3)
    assert {x[3] for x in run(frame([1, 1, 1, 1, 2]))} == {0}
    assert run(frame([1, 1, 2, 3, 4, 5, 5])) == sorted([(i, "", 1, 1) for i in (1, 1, 2, 3, 4)] + [(5, line, 1, 0)] * 2)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2, "y")], "doc_id long, text string, kept string, n_lines int, doc string")
    for limit in (0, 10**6):
        assert tuple(ld.dedup_lines(docs, broadcast_bytes=limit).select("doc.*").first()) == (1, "a", "x", 2, "y")


def test_only_rows_without_an_id(spark):
    line = "the same line of more than forty characters, again"
    docs = spark.createDataFrame([(None, line)] * 6, "doc_id long, text string")
    assert [r["kept"] for r in ld.dedup_lines(docs).collect()] == [line] * 6


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        a[: n // 2] = 7  # half of the keys differ in one word only
        own = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(a, b).to_bytes())
        assert sorted(own.lookup(a, b).tolist()) == list(range(n)) and own.n == n
        if n > 100:
            assert own.words.nbytes * 8 < 5 * n + 2000
            other = own.lookup(b, a)
            assert other.min() >= -1 and other.max() < n

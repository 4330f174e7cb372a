from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from protloom.llm import language_id as li

from .test_decontaminate import plain as plain_matches
from .test_jaccard_join import plain as plain_classes
from .test_line_dedup import plain as plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    frame = docs
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, SF)
        if name != "packing":
            assert frame.columns == docs.columns
            rows = frame.collect()
            frame = spark.createDataFrame(rows, docs.schema)
            out.append(rows)
        else:
            out.append(frame.collect())
    return out


def test_language_stage_drops_what_is_rejected(spark, stages):
    docs = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    rejected = {r["doc_id"] for r in li.language_table(docs, li.fit(docs)).where("rejected").collect()}
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0]} - rejected
    assert len(rejected) < 0.03 * len(stages[0])


def test_line_stage(stages):
    want = {i: t for i, t, _, _ in plain_lines([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copy_stage(stages):
    classes = {c for _, c, _ in plain_classes([(r["doc_id"], r["text"]) for r in stages[2]])}
    assert {r["doc_id"] for r in stages[3]} == classes and len(stages[3]) == len(classes) < len(stages[2])


def test_benchmark_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_matches([(r["doc_id"], r["text"]) for r in stages[3]], items)}
    assert leaks and {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]} - leaks


def test_packing_stage(stages):
    assert {r["doc_id"] for r in stages[5]} == {r["doc_id"] for r in stages[4]}
    full = Counter()
    for r in stages[5]:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 4096


def test_run(spark, stages):
    got = cp.run(spark, SF)
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert key(got.collect()) == key(stages[5])


def test_odd_rows(spark, odd_docs, no_docs):
    """Without a letter they go; of equal texts the least id stays, once; names clash with none of the operators' own."""
    told = {(r["doc"]["doc_id"], r["doc"]["text"]): r["language"]["rejected"] for r in li.predict(odd_docs, li.fit(odd_docs)).collect()}
    want = {k for k, rejected in told.items() if not rejected}
    assert not {1, 2, 3} & {i for i, _ in want} and want
    frame = odd_docs.withColumn("doc", F.lit("x")).withColumn("r1", F.lit(1)).withColumn("_doc", F.lit(2)).withColumn("kept", F.lit(3))
    columns = frame.columns
    for name, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns
        rows = frame.collect()
        frame = spark.createDataFrame(rows, frame.schema)
        if name == "language_id":
            assert {(r["doc_id"], r["text"]) for r in rows} == want
        if name == "jaccard_join":
            assert len(rows) == len({r["text"] for r in rows}) == len({t for _, t in want})
            assert 8 not in {r["doc_id"] for r in rows} and {(r["doc"], r["r1"], r["_doc"], r["kept"]) for r in rows} == {("x", 1, 2, 3)}
    assert {r["doc_id"] for r in cp.packed(spark, frame, SF).collect()} == {r["doc_id"] for r in rows}


def test_an_empty_table(spark, no_docs):
    frame = no_docs
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.collect() == [] and (name == "packing" or frame.columns == no_docs.columns)

"""The corpus pipeline: language, line copies, near copies, benchmark passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it
kept; all but the last return the columns of ``docs``. Each result is written as Parquet and read again.

Defined results: a document whose text is null, empty or without a letter has no language and goes in the first stage; ties and repeated
rows fall under the operators' rules (equal texts keep the one of least id; rows without an id come after those with one); texts of any length are
taken whole; an empty table gives empty tables; ``docs`` needs ``doc_id``, ``text`` and ``lang``, and further columns are
carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from protloom.llm._store import bounded_batches, saved, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that language identification rejects go."""
    bounded_batches(spark)
    found = language_id.predict(docs, language_id.fit(docs))
    return found.where(~F.col("language.rejected")).select("doc.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents."""
    bounded_batches(spark)
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bounded_batches(spark)
    return jaccard_join.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    bounded_batches(spark)
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_common_lines),
    ("jaccard_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: Packing is no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

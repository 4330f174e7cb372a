"""Intermediate tables, and the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import _own, bounded_batches, clear, forget, saved, scratch, shared_root

__all__ = ["_own", "bounded_batches", "clear", "forget", "saved", "scratch", "shared_root", "table"]


#: Bytes of a usual row group, which a scan cannot split.
_ROW_GROUP = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """One of the input tables; their rows are whole documents.

    A small table of fewer files than cores would be one task's; unless told not to, its rows are dealt out. Larger ones are read as they lie.
    """
    bounded_batches(spark)
    path = f"{sf_dir}/{name}.parquet"
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    return rows.repartition(cores) if dealt and size.getFileCount() < cores and size.getLength() < cores * _ROW_GROUP else rows

"""Folders for intermediate tables that every executor can read, and batches of bounded size.

Lineage is cut by writing Parquet into the folder that the cluster names in ``spark.checkpoint.dir``. Only on a local master,
where there are no other machines, an unset folder is replaced by a temporary one, which goes when Python ends.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows are whole documents. Rows of a batch, in a scan and to a Python worker, and bytes that Parquet's readers and writers hold at once: arrays
#: of half a region or more are set apart by the JVM's collector, which rather grows the heap than collects them.
BATCH_SIZES = {"spark.sql.parquet.columnarReaderBatchSize": 128, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "parquet.read.allocation.size": 256 << 10, "parquet.page.size": 256 << 10}
#: Rows of a file of an intermediate table without texts.
FILE_ROWS = 100_000
_fallback: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """``BATCH_SIZES`` for this session, where the application has no settings of its own."""
    told = spark.sparkContext.getConf()
    for key, size in BATCH_SIZES.items():
        if told.get(key, None) is None and told.get(f"spark.hadoop.{key}", None) is None:
            spark.conf.set(key, size)


def small_results(spark: SparkSession) -> None:
    """For results of many times their input: Parquet files of this session are compressed by zstd, where the application has no codec of its own.

    Snappy takes a few bytes of each run of 64 equal ones, so that rows of equal texts one after the other still cost as much as those that differ.
    """
    key = "spark.sql.parquet.compression.codec"
    if spark.sparkContext.getConf().get(key, None) is None and spark.conf.get(key) == "snappy":
        spark.conf.set(key, "zstd")


def shared_root(spark: SparkSession) -> str:
    """The shared folder, as a URI or path without a trailing slash."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="protloom-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/protloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them can no longer be used."""
    forget(spark, _own(spark))


def saved(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, with its path; in few files, if it is known to have ``rows`` at most."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if rows is None else df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

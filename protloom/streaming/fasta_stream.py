"""A folder that FASTA files arrive in, as a stream of sketches; an extension of the batch index.

Each micro-batch's sketch is appended to the ``sketch`` table under the batch's number, so that a repeated batch
overwrites itself and is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import alphabet
from ..operators.kmers import SKETCH, combined_sketch, sketches
from ..sources.fasta import _split


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """``name, sequence`` of the records of files that arrive."""
    rows = spark.readStream.format("text").option("lineSep", "\n>").load(folder)
    return rows.where(F.col("value") != "").select(*_split(F.col("value")))


def start_sketching(spark: SparkSession, folder: str, out: str, ksize: int, moltype: str = "protein", scaled: int = 1, available_now: bool = False) -> StreamingQuery:
    """Sketch what arrives in ``folder`` into ``out``."""
    prepared = stream_fasta(spark, folder).select("name", alphabet.validate_and_resolve(F.upper("sequence")).alias("sequence"))

    def keep(batch: DataFrame, number: int) -> None:
        sketches(batch, ksize, moltype, scaled).write.mode("overwrite").parquet(f"{out}/sketch/batch={number}")

    writer = prepared.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streamed_combined(spark: SparkSession, out: str) -> DataFrame:
    """The combined sketch of all batches so far."""
    return combined_sketch(spark.read.schema(f"{SKETCH}, batch long").parquet(f"{out}/sketch"))

"""FASTA as DataFrames, plain or compressed, from files or standard input; and k-mer and result tables as CSV."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FastaParsing, IoError
from ..scratch import scratch
from . import frames
from .frames import SCHEMA, sniff

KMER_CSV = "sequence_file string, sequence_name string, kmer string, hashval decimal(20,0)"
SEARCH_CSV = (
    "query_name string, query_md5 string, match_name string, containment double, intersect_hashes long, ksize int, scaled int, moltype string, match_md5 string, "
    "jaccard double, max_containment double, average_abund double, median_abund double, std_abund double, query_containment_ani double, match_containment_ani double, "
    "average_containment_ani double, max_containment_ani double, n_weighted_found long, total_weighted_hashes long, containment_target_in_query double, f_weighted_target_in_query double"
)
def open_decoded(stream: io.BufferedIOBase) -> io.BufferedIOBase:
    """A stream of decoded bytes."""
    head = stream.peek(6)[:6] if hasattr(stream, "peek") else b""
    codec = sniff(head)
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True))
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open, "plain": lambda s: s}[codec](stream)


def _split(value: F.Column) -> list[F.Column]:
    text = F.regexp_replace(F.regexp_replace(value, "^>", ""), "\r", "")
    return [F.substring_index(text, "\n", 1).alias("name"), F.regexp_replace(F.substr(text, F.length(F.substring_index(text, "\n", 1)) + 1), r"\s", "").alias("sequence")]


#: Files that the text reader decodes by their names, if their bytes agree.
_BY_NAME = {"gzip": ".gz", "bzip2": ".bz2"}


def _statuses(spark: SparkSession, path: str) -> list:
    """The files of a path, a folder or a pattern, without hidden ones."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(target) or []:
        out += list(fs.listStatus(found.getPath())) if found.isDirectory() else [found]
    return [s for s in out if s.isFile() and s.getPath().getName()[0] not in "._"]


def state_of(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of a path's files, to tell whether they have changed."""
    return ";".join(sorted(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in _statuses(spark, path)))


def _head(spark: SparkSession, status: object) -> bytes:
    path = status.getPath()
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(x & 0xFF for x in (stream.read() for _ in range(min(18, status.getLen()))))
    finally:
        stream.close()


def read_fasta(spark: SparkSession, path: str, split: int = frames.SPLIT) -> DataFrame:
    """``name, sequence`` of the records of a file, a folder or a pattern; the codec is told by each file's first bytes, not by its name.

    Plain files are read in splits, and gzip and bzip2 files with the usual endings, by Spark's text reader. Other compressed files, and blocked gzip, are read by
    ``protloom_fasta`` in ranges of about ``split`` bytes, where tasks can open them; in a store that only Spark's readers open, such a file
    is one task's, which holds its compressed bytes, 2 GB at most.
    """
    text, ranges, whole, statuses = [], [], [], _statuses(spark, path)
    if not statuses and not _found(spark, path):
        raise IoError(f"there is no {path}")
    for status in statuses:
        head, name = _head(spark, status), status.getPath().toString()
        codec, by_name = sniff(head), next((c for c, ending in _BY_NAME.items() if name.endswith(ending)), "plain")
        if codec == "plain" and head.strip() and not head.lstrip().startswith(b">"):
            raise FastaParsing(f"{name} does not begin with '>'")
        usual = codec == by_name and not name.endswith(".zst")
        if (frames.is_blocked(head) or not usual) and frames.can_open(name):
            ranges.append((name, codec))
        else:
            (text if usual else whole).append(name)
    parts = []
    if text or not (ranges or whole):
        lines = spark.read.option("lineSep", "\n>").text(text or str(path))
        parts.append(lines.where(F.col("value") != "").select(*_split(F.col("value"))).where((F.col("name") != "") | (F.col("sequence") != "")))
    if ranges:
        spark.dataSource.register(frames.CompressedFasta)
        parts.append(spark.read.format(frames.CompressedFasta.name()).options(files=json.dumps(ranges), split=split).load())
    if whole:
        parts.append(spark.read.format("binaryFile").load(whole).select("content").mapInArrow(_decoded_whole, SCHEMA))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def _found(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def _decoded_whole(batches):  # noqa: ANN001, ANN202
    import pyarrow as pa

    for batch in batches:
        for content in batch.column("content"):
            stream = open_decoded(io.BufferedReader(io.BytesIO(content.as_py())))
            for record in frames.records(iter(lambda: stream.read(1 << 20), b""), iter(()), True):  # noqa: B023
                name, sequence = frames.parsed(record)
                yield pa.RecordBatch.from_pydict({"name": [name], "sequence": [sequence]})


def read_stdin(spark: SparkSession, stream: io.BufferedIOBase | None = None) -> DataFrame:
    """The records on standard input, which is first written, as it comes, into the folder that all executors share."""
    path = scratch(spark, "stdin") + ".fasta"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        decoded = open_decoded(stream or sys.stdin.buffer)
        while chunk := decoded.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return read_fasta(spark, path)


def read_path_or_stdin(spark: SparkSession, path: str) -> DataFrame:
    """``-`` is standard input."""
    return read_stdin(spark) if path == "-" else read_fasta(spark, path)


def read_kmer_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KMER_CSV).csv(path, header=True)


def read_search_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_CSV).csv(path, header=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str | None) -> None:
    """A folder of CSV parts, or, without a path, rows on standard output as they come."""
    if path is not None:
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
        return
    import csv

    out = csv.writer(sys.stdout, lineterminator="\n")
    out.writerow(df.columns)
    for row in df.toLocalIterator():
        out.writerow(row)


def write_fasta(sequences: DataFrame, path: str) -> None:
    """One record a row."""
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence")).write.mode("overwrite").text(path)

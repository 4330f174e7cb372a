"""Analytics of positioned k-mers and sketches, all per sequence; sequences are told apart by id, and their names go along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unsigned_text
from .kmers import distinct_counts, hashes_by_count


def kmer_counts(kmers: DataFrame) -> DataFrame:
    """``id, name, hashval, n``."""
    return kmers.groupBy("id", "name", "hashval").agg(F.count("*").alias("n"))


def total_occurrences(kmers: DataFrame) -> DataFrame:
    """``id, name, n``."""
    return kmers.groupBy("id", "name").agg(F.count("*").alias("n"))


def kmers_by_count(kmers: DataFrame) -> DataFrame:
    """``id, name, n, n_hashes, hashes``: the hashes of each count, ascending as unsigned numbers' texts."""
    return kmer_counts(kmers).groupBy("id", "name", "n").agg(F.count("*").alias("n_hashes"), F.array_sort(F.collect_list(unsigned_text(F.col("hashval")))).alias("hashes"))


def hashes_of_counts(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1) -> DataFrame:
    """``kmers_by_count`` of sequences, each grouped where it is read."""
    texts = F.sort_array(F.transform("hashvals", unsigned_text))
    return hashes_by_count(sequences, ksize, moltype, scaled).select("id", "name", "n", F.size("hashvals").cast("long").alias("n_hashes"), texts.alias("hashes"))


def multi_position_kmers(kmers: DataFrame) -> DataFrame:
    """``id, name, hashval, n`` where a hash stands at several positions."""
    return kmer_counts(kmers).where(F.col("n") > 1)


def kmers_at(kmers: DataFrame, position: int) -> DataFrame:
    """``id, name, hashval`` at a position."""
    return kmers.where(F.col("start") == position).select("id", "name", "hashval").distinct()


def has_position(originals: Column, position: int) -> Column:
    """Whether any list in a map of positions by original holds the position."""
    return F.exists(F.map_values(originals), lambda x: F.array_contains(x, position))


def occurrences(originals: Column) -> Column:
    """Positions in a map of positions by original."""
    return F.aggregate(F.map_values(originals), F.lit(0), lambda n, x: n + F.size(x))


def density(n_occurrences: Column, length: Column) -> Column:
    """Occurrences a residue; 0 for an empty sequence."""
    return F.when(length == 0, F.lit(0.0)).otherwise(n_occurrences / length)


def overlapping_kmers(kmers: DataFrame) -> DataFrame:
    """``id, name, first, second, positions``: pairs of hashes of a sequence that share positions.

    An equi-join on the position; empty for k-mers of one size, where a position has one hash.
    """
    a = kmers.select("id", "name", "start", F.col("hashval").alias("first"))
    b = kmers.select("id", "start", F.col("hashval").alias("second"))
    return a.join(b, ["id", "start"]).where(F.col("first") < F.col("second")).groupBy("id", "name", "first", "second").agg(F.count("*").alias("positions"))


def estimated_size(sequences: DataFrame, ksize: int, moltype: str = "protein", scaled: int = 1, raw: bool = False) -> DataFrame:
    """``id, name, bytes`` of records that have a hash: name, 16 for each hash, 12 and the encoded k-mer for each hash, 16 for each original, and with ``raw`` the sequence.

    A record's hashes are added up where it is read; only its sums (one row, or one for each slice of a long record) are dealt out.
    """
    size = F.lit(16 + 12 + ksize) * F.col("n_hashes") + F.lit(16) * F.col("n_originals")
    if raw:
        size = size + F.col("length")
    size = distinct_counts(sequences, ksize, moltype, scaled).groupBy("id", "name").agg(F.sum(size).alias("n")).withColumn("n", F.col("n") + F.octet_length("name"))
    return size.select("id", "name", F.col("n").cast("long").alias("bytes"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats: ``side`` and the columns."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))

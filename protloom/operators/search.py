"""Similarity search of sketches: pairs of query and target that share a hash, with their measures.

Both sides are collections: a row for each record with the measures of its sketch, and its hashes. Those of the targets come from one reading
that keeps the queries' hashes only, or from a stored index. Records are told apart by their ids, whatever their names.

Pairs come from one equi-join on the hash, after sampling. A query side of ``BROADCAST_ROWS`` rows at most is broadcast; beyond it both sides are dealt out by
the hash. There, hashes that have more than ``HEAVY`` rows on a side, which an aggregate finds, are dealt apart: each side's rows of such a hash go to as many
groups as it fills, and meet every group of the other side. Names, sizes and digests are joined on after the pairs are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import saved
from . import kmers as km


#: Rows of a query side that is broadcast, some 100 bytes each.
BROADCAST_ROWS = 500_000
#: Rows of one hash on a side that go to one group.
HEAVY = 50_000


@dataclass
class Collection:
    """``records``: ``id, name, n_hashes, occurrences, md5``; ``hashes``: ``id, hashval, abund``."""

    records: DataFrame
    hashes: DataFrame

    def known(self) -> DataFrame:
        return self.hashes.select("hashval")


def read_collection(sequences: DataFrame, ksize: int, moltype: str, scaled: int, only: DataFrame | None = None) -> Collection:
    """The sketches of sequences, which are read once; with ``only``, a search's queries, other hashes are left out."""
    rows, _ = saved(km.profiles(sequences, ksize, moltype, scaled, only=only), "profiles")
    return Collection(rows.drop("hits", "pseudo_md5"), rows.select("id", F.explode("hits").alias("hit")).select("id", "hit.hashval", "hit.abund"))


def collection_of(sketch: DataFrame, ksize: int) -> Collection:
    """From a table of sketches alone, whose records all have hashes."""
    sizes = sketch.groupBy("id", "name").agg(F.count("*").alias("n_hashes"), F.sum("abund").alias("occurrences"))
    return Collection(sizes.join(km.sketch_digests(sketch, ksize).drop("name"), "id"), sketch.select("id", "hashval", "abund"))


def _records(own: Collection, side: str) -> DataFrame:
    return own.records.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("md5").alias(f"{side}_md5"), F.col("n_hashes").alias(f"{side}_n"), F.col("occurrences").alias(f"{side}_total"))


def met(targets: DataFrame, queries: DataFrame, keys: list[str], target_row: list[str], query_row: list[str], broadcast_rows: int = BROADCAST_ROWS, heavy: int = HEAVY) -> DataFrame:
    """Rows of both sides with equal ``keys``; the ``row`` columns deal out rows of one key. Both sides are read several times, unless the queries are few."""
    if queries.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return targets.join(F.broadcast(queries), keys)
    many = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / heavy).alias(name)).where(F.col(name) > 1)
    told = many(targets, "_t").join(many(queries, "_q"), keys, "full").select(*keys, F.coalesce("_t", F.lit(1)).alias("_t"), F.coalesce("_q", F.lit(1)).alias("_q"))
    told, _ = saved(told, "heavy")  # one row for each ``heavy`` rows at most; left to Spark's own check for a broadcast
    one = lambda name: F.coalesce(name, F.lit(1))
    group = lambda row, n: F.pmod(F.xxhash64(*row), one(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (one(n) - 1).cast("long")))

    def dealt(df: DataFrame, t: Column, q: Column) -> DataFrame:
        return df.join(told, keys, "left").withColumn("_tg", t).withColumn("_qg", q).drop("_t", "_q")

    return dealt(targets, group(target_row, "_t"), each("_q")).join(dealt(queries, each("_t"), group(query_row, "_q")), [*keys, "_tg", "_qg"]).drop("_tg", "_qg")


def shared_hashes(queries: Collection, targets: Collection, **limits: int) -> DataFrame:
    """``query_id, match_id, hashval, query_abund, match_abund``, and what else the queries' hashes carry."""
    q = queries.hashes.withColumnsRenamed({"id": "query_id", "abund": "query_abund"})
    t = targets.hashes.select(F.col("id").alias("match_id"), "hashval", F.col("abund").alias("match_abund"))
    return met(t, q, ["hashval"], ["match_id"], ["query_id"], **limits)


def abundances(shared: DataFrame) -> DataFrame:
    """``query_id, match_id, intersect_hashes, n_weighted_found, average_abund, median_abund, std_abund`` of each pair.

    Hashes of a pair are counted by their number of occurrences first, so that only these few counts are sorted, whatever the order that the hashes come in.
    """
    a, n, pair = F.col("match_abund"), F.col("n"), W.partitionBy("query_id", "match_id")
    counts = shared.groupBy("query_id", "match_id", "match_abund").agg(F.count("*").alias("n"))
    upto = F.sum(n).over(pair.orderBy("match_abund").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumns({"upto": upto, "all": F.sum(n).over(pair), "found": F.sum(n * a).over(pair)})
    mean, half = F.col("found") / F.col("all"), 2 * F.col("upto")
    median = (F.min(F.when(half >= F.col("all"), a)) + F.min(F.when(half > F.col("all"), a))) / 2
    return counts.groupBy("query_id", "match_id", F.col("all").alias("intersect_hashes"), F.col("found").alias("n_weighted_found")).agg(
        (F.sum(n * a) / F.sum(n)).alias("average_abund"), median.alias("median_abund"), F.sqrt(F.sum(n * (a - mean) * (a - mean)) / F.sum(n)).alias("std_abund")
    )


def manysearch(queries: Collection, targets: Collection, ksize: int, scaled: int, moltype: str, ids: bool = False, **limits: int) -> DataFrame:
    """22 measures of every pair of sketches that share a hash; with ``ids`` also ``query_id`` and ``match_id``."""
    k3 = 3 * ksize
    pairs = abundances(shared_hashes(queries, targets, **limits))
    rows = pairs.join(_records(queries, "query"), "query_id").join(_records(targets, "match"), "match_id")
    both, nq, nt = F.col("intersect_hashes"), F.col("query_n"), F.col("match_n")
    rows = rows.withColumns({"containment": both / nq, "containment_target_in_query": both / nt})
    rows = rows.withColumns({"query_containment_ani": F.pow("containment", F.lit(1 / k3)), "match_containment_ani": F.pow("containment_target_in_query", F.lit(1 / k3))})
    return rows.select(
        "query_name", "query_md5", "match_name", "containment", "intersect_hashes", F.lit(k3).alias("ksize"), F.lit(scaled).alias("scaled"), F.lit(moltype).alias("moltype"), "match_md5",
        (both / (nq + nt - both)).alias("jaccard"), (both / F.least(nq, nt)).alias("max_containment"), "average_abund", "median_abund", "std_abund", "query_containment_ani", "match_containment_ani",
        ((F.col("query_containment_ani") + F.col("match_containment_ani")) / 2).alias("average_containment_ani"), F.greatest("query_containment_ani", "match_containment_ani").alias("max_containment_ani"),
        "n_weighted_found", F.col("match_total").alias("total_weighted_hashes"), "containment_target_in_query", (F.col("n_weighted_found") / F.col("match_total")).alias("f_weighted_target_in_query"), *(["query_id", "match_id"] * ids),
    )


def multisearch(queries: Collection, targets: Collection, ksize: int, scaled: int, moltype: str, **limits: int) -> DataFrame:
    """16 measures of every pair, among them the probability of the overlap by chance and tf-idf.

    A hash's frequency is its share of all occurrences in the query and in the target collection;
    the adjustment multiplies by the number of targets; tf is the hash's share of the query's occurrences.
    """
    q_all = queries.hashes.groupBy("hashval").agg(F.sum("abund").alias("q_abund"))
    t_all = targets.hashes.groupBy("hashval").agg(F.sum("abund").alias("t_abund"), F.count("*").alias("df")).join(q_all, "hashval")
    total = lambda own, name: own.records.agg(F.sum("occurrences").alias(name), F.count("*").alias(f"{name}_n"))
    totals = F.broadcast(total(queries, "q_total").crossJoin(total(targets, "t_total")))  # one row
    weights = t_all.crossJoin(totals).select("hashval", (F.col("q_abund") / F.col("q_total") * F.col("t_abund") / F.col("t_total")).alias("p"), km.idf(F.col("t_total_n"), F.col("df")).alias("idf"), F.col("t_total_n").alias("n_targets"))
    # the weights go along with the queries' hashes, so that the targets' meet one table
    weighted, _ = saved(queries.hashes.join(weights, "hashval"), "weighted")
    shared = shared_hashes(Collection(queries.records, weighted), targets, **limits)
    pairs = shared.groupBy("query_id", "match_id").agg(F.count("*").alias("n"), F.sum("p").alias("prob_overlap"), F.sum(F.col("query_abund") * F.col("idf")).alias("weighted"), F.first("n_targets").alias("n_targets"))
    rows = pairs.join(_records(queries, "query"), "query_id").join(_records(targets, "match"), "match_id")
    both, nq, nt = F.col("n"), F.col("query_n"), F.col("match_n")
    rows = rows.withColumns({"containment": both / nq, "prob_overlap_adjusted": F.col("prob_overlap") * F.col("n_targets")})
    adjusted = F.col("containment") / F.col("prob_overlap_adjusted")
    return rows.select(
        "query_name", "query_md5", "match_name", "match_md5", "containment", (both / F.least(nq, nt)).alias("max_containment"), (both / (nq + nt - both)).alias("jaccard"), both.cast("double").alias("intersect_hashes"),
        F.lit(3 * ksize).alias("ksize"), F.lit(scaled).alias("scaled"), F.lit(moltype).alias("moltype"), "prob_overlap", "prob_overlap_adjusted", adjusted.alias("containment_adjusted"),
        F.log10(adjusted).alias("containment_adjusted_log10"), (F.col("weighted") / F.col("query_total")).alias("tf_idf_score"),
    )


def kmer_hits(query_kmers: DataFrame, target_kmers: DataFrame, **limits: int) -> DataFrame:
    """Equal encoded k-mers of queries and targets, with ids, names, starts and originals of both."""
    own = lambda df, side: df.select("hashval", "encoded", F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("kmer").alias(f"kmer_{side}"), F.col("start").alias(f"start_{side}"))
    return met(own(target_kmers, "match"), own(query_kmers, "query"), ["hashval", "encoded"], ["match_id", "start_match"], ["query_id", "start_query"], **limits)


def search_hits(results: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits of the pairs that a search found, with the search's columns; ``results`` has the pairs' ids."""
    return hits.join(results, ["query_id", "match_id"])

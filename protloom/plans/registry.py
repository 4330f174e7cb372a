"""Named queries over the driver's text tables, and the SQL that mirrors them.

``documents`` is the target collection and ``benchmark`` the queries: a text's letters are a residue
sequence. Hashes are shown as unsigned decimals, doubles rounded on both sides, so that the order of a sum does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet
from ..functions.hashing import unsigned_text
from ..operators import kmers as km
from ..operators import search as se
from ..operators import signature_ops as so
from ..operators import stitch as st
from ..index import ProteinIndex
from ..scratch import saved, scratch, small_results
from ..sources import fasta as fa
from . import sql

K = 8
SCALED = 5
#: Residues of a task whose equal k-mers come together where all k-mers are the result.
TOGETHER = 1 << 21
_TABLES = {"d": ("documents", "doc_id"), "b": ("benchmark", "item_id")}


def _raw(spark: SparkSession, sf: str, t: str) -> DataFrame:
    """Ids, names and texts."""
    table, key = _TABLES[t]
    return spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).cast("long").alias("id"), F.col(key).cast("string").alias("name"), "text")


def _dealt(spark: SparkSession, sf: str, t: str) -> DataFrame:
    """The same for work on the texts: a table of fewer files than cores, as the small test tables of one row group are, is dealt out first; any other is read as it lies."""
    rows = _raw(spark, sf, t)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _sequences(spark: SparkSession, sf: str, t: str) -> DataFrame:
    return _dealt(spark, sf, t).select("id", "name", alphabet.letters_only(F.col("text")).alias("sequence"))


def _kmers(spark: SparkSession, sf: str, t: str, moltype: str = "protein", scaled: int = 1, ksize: int = K, only: DataFrame | None = None) -> DataFrame:
    return km.kmer_positions(_sequences(spark, sf, t), ksize, moltype, scaled, only=only)


def _sketch(spark: SparkSession, sf: str, t: str, moltype: str = "protein", scaled: int = 1) -> DataFrame:
    return km.sketches(_sequences(spark, sf, t), K, moltype, scaled)


def _signatures(spark: SparkSession, sf: str, t: str, scaled: int = 1) -> DataFrame:
    return km.signatures(_sequences(spark, sf, t), K, "protein", scaled)


def _hash(name: str = "hashval") -> Column:
    return unsigned_text(F.col(name)).alias(name)


#: Digits of doubles that are no shares.
_DIGITS = {"containment_adjusted": 3, "prob_overlap": 14, "prob_overlap_adjusted": 12}


def _rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero, as DuckDB does it: in doubles. ``F.round`` goes through the text and a BigDecimal of each value."""
    wide = x * F.lit(10.0**digits)
    whole = F.rint(wide)  # halves to the even number
    rest = wide - whole
    away = (F.abs(rest) == 0.5) & (F.signum(rest) == F.signum(wide))
    return (whole + F.when(away, 2 * rest).otherwise(F.lit(0.0))) / F.lit(10.0**digits)  # a sum, so that there is no -0.0


def _digits(df: DataFrame) -> DataFrame:
    return df.select(*(_rounded(F.col(c), _DIGITS.get(c, 8)).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in df.dtypes))


# ---- residues ----


def validate_residues(spark: SparkSession, sf: str) -> DataFrame:
    bad = alphabet.first_invalid(F.col("text"))
    return _dealt(spark, sf, "d").select("name", bad.isNull().alias("valid"), bad["char"].alias("bad_char"), bad["position"].cast("long").alias("bad_position"))


def stop_truncate(spark: SparkSession, sf: str) -> DataFrame:
    cut = alphabet.truncate_at_stop(F.col("text"))
    return _dealt(spark, sf, "d").select("name", F.length(cut).cast("long").alias("kept"), F.md5(cut.cast("binary")).alias("digest"))


def resolve_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    text = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return _dealt(spark, sf, "d").select("name", F.length(text).cast("long").alias("length"), F.md5(alphabet.resolve_ambiguity(text).cast("binary")).alias("digest"))


def _encoded(moltype: str):  # noqa: ANN202
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _sequences(spark, sf, "d").select("name", F.md5(alphabet.encode(F.col("sequence"), moltype).cast("binary")).alias("digest"))

    return query


# ---- k-mers and sketches ----


def kmer_positions(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    """Equal k-mers come together, as this result is far larger than its input."""
    small_results(spark)
    return km.kmer_position_texts(_sequences(spark, sf, t), K, "dayhoff")


def kmer_info_map(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    small_results(spark)
    return km.kmer_info_texts(_sequences(spark, sf, t), K, "hp")


def murmur_hash(spark: SparkSession, sf: str) -> DataFrame:
    return km.distinct_kmers(_sequences(spark, sf, "d"), K, "dayhoff").select("encoded", _hash())


def scaled_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf, "d", SCALED).where("n_hashes > 0").select("name", "n_hashes", "occurrences")


def sketch_abundance(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    return _sketch(spark, sf, t, "hp").select("name", _hash(), "abund")


def pseudo_md5(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf, "d").where("n_hashes > 0").select("name", "pseudo_md5")


def true_md5(spark: SparkSession, sf: str) -> DataFrame:
    return _signatures(spark, sf, "d").where("n_hashes > 0").select("name", "md5")


def combined_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return km.combined_of(_sequences(spark, sf, "d"), K).groupBy("df", "abund").agg(F.count("*").alias("n_hashes"))


def kmer_idf_frequency(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    n = _raw(spark, sf, t).count()
    combined, _ = saved(km.combined_of(_sequences(spark, sf, t), K, "hp"), "combined")
    return _digits(km.frequencies(combined, n).select(_hash(), "df", "frequency", "idf"))


def hash_membership(spark: SparkSession, sf: str) -> DataFrame:
    known = _sketch(spark, sf, "b", "dayhoff").select("hashval").distinct()
    return _kmers(spark, sf, "d", "dayhoff", only=known).join(known, "hashval", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


# ---- search ----


def _collections(spark: SparkSession, sf: str) -> tuple[se.Collection, se.Collection]:
    """The benchmark as queries, and of the documents what the queries hold; each table is read once."""
    queries = se.read_collection(_sequences(spark, sf, "b"), K, "protein", 1)
    return queries, se.read_collection(_sequences(spark, sf, "d"), K, "protein", 1, only=queries.known())


def manysearch(spark: SparkSession, sf: str) -> DataFrame:
    return _digits(se.manysearch(*_collections(spark, sf), K, 1, "protein"))


def multisearch(spark: SparkSession, sf: str) -> DataFrame:
    return _digits(se.multisearch(*_collections(spark, sf), K, 1, "protein"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    queries, _ = saved(_kmers(spark, sf, "b"), "query-kmers")
    return se.kmer_hits(queries, _kmers(spark, sf, "d", only=queries))


def kmer_hit_join(spark: SparkSession, sf: str) -> DataFrame:
    return _digits(_hits(spark, sf).select("query_name", "match_name", "start_query", "start_match", "kmer_query", "kmer_match", "encoded", _hash()))


def search_kmer_join(spark: SparkSession, sf: str) -> DataFrame:
    found = se.manysearch(*_collections(spark, sf), K, 1, "protein", ids=True).select("query_id", "match_id", "containment", "intersect_hashes")
    return _digits(se.search_hits(found, _hits(spark, sf)).groupBy("query_name", "match_name", "containment", "intersect_hashes").agg(F.count("*").alias("n_hits"), F.min("start_query").alias("first_query"), F.max("start_match").alias("last_match")))


def stitch_compat(spark: SparkSession, sf: str) -> DataFrame:
    return _digits(st.stitch(_hits(spark, sf)))


def stitch_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return _digits(st.stitch(_hits(spark, sf), "diagonal", K))


# ---- analytics ----


def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _sketch(spark, sf, "d", "hp").select("name", _hash(), F.col("abund").alias("n"))


def group_kmers_by_count(spark: SparkSession, sf: str) -> DataFrame:
    return so.hashes_of_counts(_sequences(spark, sf, "d"), K, "hp").select("name", "n", F.col("n_hashes"), F.md5(F.array_join("hashes", ",").cast("binary")).alias("hashes"))


def multi_position_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return _sketch(spark, sf, "d", "dayhoff").where("abund > 1").select("name", _hash(), F.col("abund").alias("n"))


def kmers_at_position(spark: SparkSession, sf: str) -> DataFrame:
    return so.kmers_at(_kmers(spark, sf, "d"), 10).select("name", _hash())


def kmer_density(spark: SparkSession, sf: str) -> DataFrame:
    lengths = _sequences(spark, sf, "d").select("id", F.length("sequence").alias("length"))
    return _digits(lengths.join(_signatures(spark, sf, "d", SCALED), "id").select("name", so.density(F.col("occurrences"), F.col("length")).alias("density")))


def overlapping_kmers(spark: SparkSession, sf: str) -> DataFrame:
    """Of two sizes, as k-mers of one never share a start."""
    both = _kmers(spark, sf, "b", "hp").unionByName(_kmers(spark, sf, "b", "hp", ksize=K - 2))
    pairs = so.overlapping_kmers(both).groupBy("name").agg(F.count("*").alias("pairs"), F.sum("positions").alias("positions"))
    return pairs.select("name", "pairs", "positions")


def unique_kmer_count(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    return km.original_counts(_sequences(spark, sf, t), K, "hp").select("name", _hash(), "n_originals")


def estimated_size(spark: SparkSession, sf: str) -> DataFrame:
    return so.estimated_size(_sequences(spark, sf, "d"), K, "dayhoff", raw=True).drop("id")


def _index(spark: SparkSession, rows: DataFrame, moltype: str = "hp", store_raw_sequences: bool = False) -> ProteinIndex:
    own = ProteinIndex(spark, scratch(spark, "index"), K, 1, moltype, store_raw_sequences)
    own.store(rows.select("name", "sequence"))
    return own


def index_equivalence(spark: SparkSession, sf: str, t: str = "b") -> DataFrame:
    """A stored index against one that got its rows in two calls and was loaded again, and against one of another alphabet."""
    rows = _sequences(spark, sf, t)
    own, twice, other = _index(spark, rows), _index(spark, rows.where("id % 2 = 0")), _index(spark, rows, "dayhoff")
    twice.store(rows.where("id % 2 <> 0").select("name", "sequence"))
    again = ProteinIndex.load(spark, twice.path)
    return spark.createDataFrame([("hp", own.is_equivalent_to(again)), ("dayhoff", own.is_equivalent_to(other))], "other string, equal boolean")


def index_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures and raw sequences of an index that was stored and loaded again."""
    own = ProteinIndex.load(spark, _index(spark, _sequences(spark, sf, "d"), "protein", True).path)
    rows = own.signatures().join(own.sequences().drop("name"), "id")
    return _digits(rows.select("name", "n_hashes", "occurrences", "pseudo_md5", "md5", "length", F.md5(F.col("sequence").cast("binary")).alias("digest")))


def index_combined(spark: SparkSession, sf: str) -> DataFrame:
    """The combined sketch of a stored index, as sizes."""
    own = _index(spark, _sequences(spark, sf, "b"), "dayhoff")
    stats = own.stats()
    return spark.createDataFrame([(stats["signatures"], stats["combined_hashes"], own.combined().agg(F.sum("abund")).first()[0])], "signatures long, combined_hashes long, occurrences long")


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of a stored index: of the postings of its first call, and the sketches of its second."""
    rows = _sequences(spark, sf, "d")
    own = _index(spark, rows.where("id % 3 <> 0"), "protein")
    own.compact()
    own.store(rows.where("id % 3 = 0").select("name", "sequence"))
    return _digits(ProteinIndex.load(spark, own.path).search(_sequences(spark, sf, "b")))


def index_combined_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The combined sketch of a compaction and a later call, as sizes."""
    rows = _sequences(spark, sf, "d")
    own = _index(spark, rows.where("id % 3 <> 0"), "protein")
    own.compact()
    own.store(rows.where("id % 3 = 0").select("name", "sequence"))
    return ProteinIndex.load(spark, own.path).combined().groupBy("df", "abund").agg(F.count("*").alias("n_hashes"))


def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Compacted postings: for each document, the hashes and occurrences that the folders of the benchmark's hashes hold of it."""
    queries = _sketch(spark, sf, "b").select("hashval").distinct()
    own = _index(spark, _sequences(spark, sf, "d"), "protein")
    own.compact()
    found = own.postings(queries).join(queries, "hashval", "left_semi").groupBy("id").agg(F.count("*").alias("n_hashes"), F.sum("abund").alias("occurrences"))
    return found.join(own.signatures().select("id", "name"), "id").select("name", "n_hashes", "occurrences")


def index_unequal(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that an index of the documents and one of the benchmark do not hold equally often."""
    return _index(spark, _sequences(spark, sf, "d"), "protein").unequal(_index(spark, _sequences(spark, sf, "b"), "protein")).drop("content")


def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences written as FASTA and read again; empty ones too."""
    path = scratch(spark, "fasta")
    fa.write_fasta(_sequences(spark, sf, "d"), path)
    return fa.read_fasta(spark, path).select("name", F.length("sequence").cast("long").alias("length"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A search's measures written as CSV and read again."""
    path = scratch(spark, "measures")
    fa.write_csv(se.manysearch(*_collections(spark, sf), K, 1, "protein"), path)
    return _digits(fa.read_search_csv(spark, path))


def kmer_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """k-mers written as CSV and read again."""
    path = scratch(spark, "kmers")
    rows = _kmers(spark, sf, "b", "hp", SCALED).select(F.lit("benchmark").alias("sequence_file"), F.col("name").alias("sequence_name"), "kmer", _hash())
    fa.write_csv(rows, path)
    return fa.read_kmer_csv(spark, path).select("sequence_file", "sequence_name", "kmer", F.col("hashval").cast("string").alias("hashval"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    combined = km.combined_of(_sequences(spark, sf, "d"), K).agg(F.count("*").alias("combined_hashes"), F.sum("abund").alias("occurrences"))
    return _raw(spark, sf, "d").agg(F.count("*").alias("signatures")).crossJoin(combined)  # one row each


_QUERIES = {f.__name__: f for f in (
    validate_residues, stop_truncate, resolve_ambiguity, kmer_positions, kmer_info_map, murmur_hash, scaled_sample, sketch_abundance, pseudo_md5, true_md5, combined_sketch, kmer_idf_frequency,
    hash_membership, manysearch, multisearch, kmer_hit_join, search_kmer_join, stitch_compat, stitch_diagonal, kmer_counts, group_kmers_by_count, multi_position_kmers, kmers_at_position,
    kmer_density, overlapping_kmers, unique_kmer_count, estimated_size, index_equivalence, index_stats, index_reload, index_combined, index_combined_documents, index_postings, index_unequal, index_search, fasta_round_trip, csv_round_trip, kmer_csv_round_trip,
)} | {f"encode_{m}": _encoded(m) for m in ("protein", "hp", "dayhoff")}


def _over_documents(query):  # noqa: ANN001, ANN202
    def over(spark: SparkSession, sf: str) -> DataFrame:
        return query(spark, sf, "d")

    return over


#: Under their own names over the benchmark, under these over the targets.
_QUERIES |= {f"{f.__name__}_documents": _over_documents(f) for f in (kmer_positions, kmer_info_map, sketch_abundance, kmer_idf_frequency, unique_kmer_count, index_equivalence)}


def queries() -> dict:
    return dict(_QUERIES)


# ---- SQL ----

_ROUND = "round({}, 8)"


def _k(t: str, moltype: str, ksize: int = K) -> list:
    return sql.kmers(t, *_TABLES[t], ksize, moltype)


def _t(t: str, moltype: str) -> list:
    return sql.sketch(t, *_TABLES[t], K, moltype)


def _encode_sql(moltype: str) -> str:
    own = alphabet.table_of(moltype)
    encoded = "sequence" if own is None else f"translate(sequence, '{''.join(own)}', '{''.join(own.values())}')"
    return sql.statement(sql.sequences("d", *_TABLES["d"]), f"SELECT name, md5({encoded}) AS digest FROM d_s")


def _sizes(t: str) -> tuple[str, str]:
    return (f"{t}_z", f"SELECT name, count(*) AS n, CAST(sum(abund) AS BIGINT) AS total, md5('{3 * K}' || string_agg(CAST(hash AS VARCHAR), '' ORDER BY hash)) AS md5 FROM {t}_t GROUP BY name")


def _contents(t: str) -> list:
    """Sequences, those without a k-mer as one, with their numbers of records."""
    return [
        (f"{t}_p", f"SELECT name, lower(to_hex(CAST(sum(CAST(hash AS HUGEINT)) % CAST({2**64} AS HUGEINT) AS UBIGINT))) AS pseudo_md5 FROM {t}_t GROUP BY name"),
        (f"{t}_c", f"SELECT CASE WHEN length(sequence) < {K} THEN '' ELSE sequence END AS content, coalesce(any_value(pseudo_md5), '0') AS pseudo_md5, count(*) AS n FROM {t}_s LEFT JOIN {t}_p USING (name) GROUP BY 1"),
    ]


def _pairs() -> list:
    shared = "SELECT q.name AS query_name, t.name AS match_name, q.hash, q.abund AS query_abund, t.abund AS match_abund FROM b_t q JOIN d_t t USING (hash)"
    return [*_t("b", "protein"), *_t("d", "protein"), _sizes("b"), _sizes("d"), ("shared", shared)]


_HITS = [*_k("b", "protein"), *_k("d", "protein"), ("hits", "SELECT q.name AS query_name, t.name AS match_name, q.start AS start_query, t.start AS start_match, q.kmer AS kmer_query, t.kmer AS kmer_match, q.encoded, q.hash FROM b_k q JOIN d_k t ON q.hash = t.hash AND q.encoded = t.encoded")]
_LIMIT = f"CAST({int(float(2**64 - 1) / SCALED)} AS UBIGINT)"


def _stitch_sql(keys: str, islands: list) -> str:
    part = lambda kmer, step: f"CASE WHEN {step} IS NULL OR {step} = 0 THEN {kmer} WHEN {step} > 0 THEN right({kmer}, CAST({step} AS INTEGER)) ELSE substr({kmer}, 1 - {step}) END"
    return sql.statement([
        *_HITS, *islands,
        ("stepped", f"SELECT *, start_query - lag(start_query) OVER w AS sq, start_match - lag(start_match) OVER w AS sm FROM {'islands' if islands else 'hits'} WINDOW w AS (PARTITION BY {keys} ORDER BY start_query, start_match)"),
        ("glued", f"""SELECT {keys}, min(start_query) AS query_start, min(start_match) AS match_start, string_agg({part('kmer_query', 'sm')}, '' ORDER BY start_query, start_match) AS query,
            string_agg({part('kmer_match', 'sm')}, '' ORDER BY start_query, start_match) AS match, string_agg({part('encoded', 'sq')}, '' ORDER BY start_query, start_match) AS encoded FROM stepped GROUP BY {keys}"""),
    ], """SELECT match_name, query_name, CAST(query_start AS BIGINT) AS query_start, CAST(query_start + length(query) AS BIGINT) AS query_end, query, CAST(match_start AS BIGINT) AS match_start,
        CAST(match_start + length(query) AS BIGINT) AS match_end, match, encoded, CAST(length(query) AS BIGINT) AS length FROM glued""")  # fmt: skip


def oracle_sql() -> dict:
    ani = lambda x: f"pow({x}, 1.0 / {3 * K})"
    both, nq, nt = "CAST(p.n AS DOUBLE)", "q.n", "t.n"
    many = sql.statement([*_pairs(), ("p", """SELECT query_name, match_name, count(*) AS n, avg(match_abund) AS average_abund, median(match_abund) AS median_abund, stddev_pop(match_abund) AS std_abund,
        CAST(sum(match_abund) AS BIGINT) AS found FROM shared GROUP BY ALL"""), ("m", f"""SELECT p.*, q.md5 AS query_md5, t.md5 AS match_md5, q.n AS nq, t.n AS nt, t.total, {both} / {nq} AS cq, {both} / {nt} AS ct,
        {ani(f'{both} / {nq}')} AS aq, {ani(f'{both} / {nt}')} AS at_ FROM p JOIN b_z q ON q.name = p.query_name JOIN d_z t ON t.name = p.match_name""")],
        f"""SELECT query_name, query_md5, match_name, {_ROUND.format('cq')} AS containment, n AS intersect_hashes, CAST({3 * K} AS BIGINT) AS ksize, CAST(1 AS BIGINT) AS scaled, 'protein' AS moltype, match_md5,
        {_ROUND.format('n::DOUBLE / (nq + nt - n)')} AS jaccard, {_ROUND.format('n::DOUBLE / least(nq, nt)')} AS max_containment, {_ROUND.format('average_abund')} AS average_abund, {_ROUND.format('median_abund')} AS median_abund,
        {_ROUND.format('std_abund')} AS std_abund, {_ROUND.format('aq')} AS query_containment_ani, {_ROUND.format('at_')} AS match_containment_ani, {_ROUND.format('(aq + at_) / 2')} AS average_containment_ani,
        {_ROUND.format('greatest(aq, at_)')} AS max_containment_ani, found AS n_weighted_found, total AS total_weighted_hashes, {_ROUND.format('ct')} AS containment_target_in_query,
        {_ROUND.format('found::DOUBLE / total')} AS f_weighted_target_in_query FROM m""")  # fmt: skip
    counted = "SELECT name, hash, count(*) AS n FROM d_k GROUP BY ALL"
    combined = sql.statement([*_t("d", "protein"), ("c", "SELECT hash, CAST(sum(abund) AS BIGINT) AS abund, count(*) AS df FROM d_t GROUP BY hash")], "SELECT df, abund, count(*) AS n_hashes FROM c GROUP BY ALL")
    return {
        "validate_residues": r"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS name, text, length(regexp_extract(text, '^[A-Z]*')) AS good FROM documents),
            c AS (SELECT name, good, substr(text, good + 1, 1) AS c FROM p)
            SELECT name, c IN ('', '*') AS valid, CASE WHEN c NOT IN ('', '*') THEN c END AS bad_char, CASE WHEN c NOT IN ('', '*') THEN CAST(good + 1 AS BIGINT) END AS bad_position FROM c""",
        "stop_truncate": r"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN position('*' IN text) > 0 THEN substr(text, 1, position('*' IN text)) ELSE text END AS cut FROM documents)
            SELECT name, CAST(length(cut) AS BIGINT) AS kept, md5(cut) AS digest FROM c""",
        "resolve_ambiguity": sql.statement(sql.sequences("d", *_TABLES["d"]), "SELECT name, CAST(length(sequence) AS BIGINT) AS length, md5(sequence) AS digest FROM d_s"),
        **{f"encode_{m}": _encode_sql(m) for m in ("protein", "hp", "dayhoff")},
        "kmer_positions": sql.statement(_k("b", "dayhoff"), "SELECT name, CAST(start AS BIGINT) AS start, kmer, encoded, CAST(hash AS VARCHAR) AS hashval FROM b_k"),
        "kmer_info_map": sql.statement(_k("b", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, encoded, kmer, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS positions FROM b_k GROUP BY ALL"),
        "murmur_hash": sql.statement(_k("d", "dayhoff"), "SELECT DISTINCT encoded, CAST(hash AS VARCHAR) AS hashval FROM d_k"),
        "scaled_sample": sql.statement(_t("d", "protein"), f"SELECT name, count(*) AS n_hashes, CAST(sum(abund) AS BIGINT) AS occurrences FROM d_t WHERE hash <= {_LIMIT} GROUP BY name"),
        "sketch_abundance": sql.statement(_t("b", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, abund FROM b_t"),
        "pseudo_md5": sql.statement(_t("d", "protein"), f"SELECT name, lower(to_hex(CAST(sum(CAST(hash AS HUGEINT)) % CAST({2**64} AS HUGEINT) AS UBIGINT))) AS pseudo_md5 FROM d_t GROUP BY name"),
        "true_md5": sql.statement([*_t("d", "protein"), _sizes("d")], "SELECT name, md5 FROM d_z"),
        "combined_sketch": combined,
        "kmer_idf_frequency": sql.statement(_t("b", "hp"), f"""SELECT CAST(hash AS VARCHAR) AS hashval, count(*) AS df, {_ROUND.format('sum(abund)::DOUBLE / (SELECT sum(abund) FROM b_t)')} AS frequency,
            {_ROUND.format('ln(((SELECT count(*) FROM benchmark) + 1)::DOUBLE / (count(*) + 1)) + 1')} AS idf FROM b_t GROUP BY hash"""),
        "hash_membership": sql.statement([*_k("b", "dayhoff"), *_k("d", "dayhoff")], "SELECT name, count(*) AS n FROM d_k WHERE hash IN (SELECT hash FROM b_k) GROUP BY name"),
        "manysearch": many,
        "index_search": many,
        "csv_round_trip": many,
        "multisearch": sql.statement([*_pairs(), ("qa", "SELECT hash, sum(abund) AS a FROM b_t GROUP BY hash"), ("ta", "SELECT hash, sum(abund) AS a, count(*) AS df FROM d_t GROUP BY hash"),
            ("w", "SELECT hash, qa.a::DOUBLE / (SELECT sum(abund) FROM b_t) * ta.a / (SELECT sum(abund) FROM d_t) AS p, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM qa JOIN ta USING (hash)"),
            ("p", "SELECT query_name, match_name, count(*) AS n, sum(p) AS prob, sum(query_abund * idf) AS weighted FROM shared JOIN w USING (hash) GROUP BY ALL"),
            ("m", f"SELECT p.*, q.md5 AS query_md5, t.md5 AS match_md5, q.n AS nq, t.n AS nt, q.total, {both} / q.n AS cq, prob * (SELECT count(*) FROM documents) AS adjusted FROM p JOIN b_z q ON q.name = p.query_name JOIN d_z t ON t.name = p.match_name")],
            f"""SELECT query_name, query_md5, match_name, match_md5, {_ROUND.format('cq')} AS containment, {_ROUND.format('n::DOUBLE / least(nq, nt)')} AS max_containment, {_ROUND.format('n::DOUBLE / (nq + nt - n)')} AS jaccard,
            CAST(n AS DOUBLE) AS intersect_hashes, CAST({3 * K} AS BIGINT) AS ksize, CAST(1 AS BIGINT) AS scaled, 'protein' AS moltype, round(prob, 14) AS prob_overlap, round(adjusted, 12) AS prob_overlap_adjusted,
            round(cq / adjusted, 3) AS containment_adjusted, {_ROUND.format('log10(cq / adjusted)')} AS containment_adjusted_log10, {_ROUND.format('weighted / total')} AS tf_idf_score FROM m"""),
        "kmer_hit_join": sql.statement(_HITS, "SELECT query_name, match_name, CAST(start_query AS BIGINT) AS start_query, CAST(start_match AS BIGINT) AS start_match, kmer_query, kmer_match, encoded, CAST(hash AS VARCHAR) AS hashval FROM hits"),
        "search_kmer_join": sql.statement(_HITS, f"""SELECT query_name, match_name, {_ROUND.format('count(DISTINCT hash)::DOUBLE / any_value(nq)')} AS containment, count(DISTINCT hash) AS intersect_hashes, count(*) AS n_hits,
            CAST(min(start_query) AS BIGINT) AS first_query, CAST(max(start_match) AS BIGINT) AS last_match FROM hits JOIN (SELECT name AS query_name, count(DISTINCT hash) AS nq FROM b_k GROUP BY name) USING (query_name) GROUP BY query_name, match_name"""),
        "stitch_compat": _stitch_sql("match_name, query_name", []),
        "stitch_diagonal": _stitch_sql("match_name, query_name, diagonal, island", [
            ("offsets", f"SELECT *, start_match - start_query AS diagonal, CASE WHEN start_query - lag(start_query) OVER w <= {K} THEN 0 ELSE 1 END AS opens FROM hits WINDOW w AS (PARTITION BY match_name, query_name, start_match - start_query ORDER BY start_query)"),
            ("islands", "SELECT *, sum(opens) OVER (PARTITION BY match_name, query_name, diagonal ORDER BY start_query) AS island FROM offsets")]),
        "kmer_counts": sql.statement(_k("d", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, count(*) AS n FROM d_k GROUP BY ALL"),
        "group_kmers_by_count": sql.statement([*_k("d", "hp"), ("c", counted)], "SELECT name, n, count(*) AS n_hashes, md5(string_agg(CAST(hash AS VARCHAR), ',' ORDER BY CAST(hash AS VARCHAR))) AS hashes FROM c GROUP BY name, n"),
        "multi_position_kmers": sql.statement([*_k("d", "dayhoff"), ("c", counted)], "SELECT name, CAST(hash AS VARCHAR) AS hashval, n FROM c WHERE n > 1"),
        "kmers_at_position": sql.statement(_k("d", "protein"), "SELECT DISTINCT name, CAST(hash AS VARCHAR) AS hashval FROM d_k WHERE start = 10"),
        "kmer_density": sql.statement([*_k("d", "protein"), ("c", f"SELECT name, count(*) AS n FROM d_k WHERE hash <= {_LIMIT} GROUP BY name")],
            f"SELECT s.name, CASE WHEN length(s.sequence) = 0 THEN 0.0::DOUBLE ELSE {_ROUND.format('coalesce(c.n, 0)::DOUBLE / length(s.sequence)')} END AS density FROM d_s s LEFT JOIN c USING (name)"),
        "overlapping_kmers": sql.statement([*_k("b", "hp"), *[(n.replace("b_", "x_"), q.replace("b_", "x_")) for n, q in _k("b", "hp", K - 2)]],
            "SELECT a.name, count(DISTINCT (a.hash, b.hash)) AS pairs, count(*) AS positions FROM b_k a JOIN x_k b ON a.name = b.name AND a.start = b.start GROUP BY a.name"),
        "unique_kmer_count": sql.statement(_k("b", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, count(DISTINCT kmer) AS n_originals FROM b_k GROUP BY ALL"),
        "estimated_size": sql.statement([*_k("d", "dayhoff"), ("c", "SELECT name, hash, length(encoded) AS e, count(DISTINCT kmer) AS o FROM d_k GROUP BY ALL")],
            "SELECT c.name, CAST(sum(28 + e + 16 * o) + length(c.name) + any_value(length(s.sequence)) AS BIGINT) AS bytes FROM c JOIN d_s s USING (name) GROUP BY c.name"),
        "index_equivalence": sql.statement([*_k("b", "hp"), *[(n.replace("b_", "x_"), s.replace("b_", "x_")) for n, s in _k("b", "dayhoff")]],
            "SELECT 'hp' AS other, count(*) = 0 AS equal FROM (SELECT * FROM b_k EXCEPT ALL SELECT * FROM b_k) UNION ALL SELECT 'dayhoff', count(*) = 0 FROM (SELECT * FROM b_k EXCEPT ALL SELECT * FROM x_k)"),
        "index_reload": sql.statement([*_t("d", "protein"), _sizes("d")], f"""SELECT s.name, CAST(coalesce(z.n, 0) AS BIGINT) AS n_hashes, CAST(coalesce(z.total, 0) AS BIGINT) AS occurrences, coalesce(x.pseudo_md5, '0') AS pseudo_md5, coalesce(z.md5, md5('{3 * K}')) AS md5,
            CAST(length(s.sequence) AS BIGINT) AS length, md5(s.sequence) AS digest FROM d_s s LEFT JOIN d_z z USING (name)
            LEFT JOIN (SELECT name, lower(to_hex(CAST(sum(CAST(hash AS HUGEINT)) % CAST({2**64} AS HUGEINT) AS UBIGINT))) AS pseudo_md5 FROM d_t GROUP BY name) x USING (name)"""),
        "index_combined": sql.statement(_t("b", "dayhoff"), "SELECT (SELECT count(*) FROM benchmark) AS signatures, count(DISTINCT hash) AS combined_hashes, CAST(sum(abund) AS BIGINT) AS occurrences FROM b_t"),
        "index_combined_documents": combined,
        "index_postings": sql.statement([*_t("b", "protein"), *_t("d", "protein")], "SELECT name, count(*) AS n_hashes, CAST(sum(abund) AS BIGINT) AS occurrences FROM d_t WHERE hash IN (SELECT hash FROM b_t) GROUP BY name"),
        "index_unequal": sql.statement([*_t("d", "protein"), *_t("b", "protein"), *(x for t in "db" for x in _contents(t))], """SELECT coalesce(d_c.pseudo_md5, b_c.pseudo_md5) AS pseudo_md5, coalesce(d_c.n, 0) AS n_left, coalesce(b_c.n, 0) AS n_right
            FROM d_c FULL JOIN b_c USING (content) WHERE coalesce(d_c.n, 0) <> coalesce(b_c.n, 0)"""),
        "fasta_round_trip": sql.statement(sql.sequences("d", *_TABLES["d"]), "SELECT name, CAST(length(sequence) AS BIGINT) AS length, md5(sequence) AS digest FROM d_s"),
        "kmer_csv_round_trip": sql.statement(_k("b", "hp"), f"SELECT 'benchmark' AS sequence_file, name AS sequence_name, kmer, CAST(hash AS VARCHAR) AS hashval FROM b_k WHERE hash <= {_LIMIT}"),
        "index_stats": sql.statement(_t("d", "protein"), "SELECT (SELECT count(*) FROM documents) AS signatures, count(DISTINCT hash) AS combined_hashes, CAST(sum(abund) AS BIGINT) AS occurrences FROM d_t"),
        "kmer_positions_documents": sql.statement(_k("d", "dayhoff"), "SELECT name, CAST(start AS BIGINT) AS start, kmer, encoded, CAST(hash AS VARCHAR) AS hashval FROM d_k"),
        "kmer_info_map_documents": sql.statement(_k("d", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, encoded, kmer, string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) AS positions FROM d_k GROUP BY ALL"),
        "sketch_abundance_documents": sql.statement(_t("d", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, abund FROM d_t"),
        "kmer_idf_frequency_documents": sql.statement(_t("d", "hp"), f"""SELECT CAST(hash AS VARCHAR) AS hashval, count(*) AS df, {_ROUND.format('sum(abund)::DOUBLE / (SELECT sum(abund) FROM d_t)')} AS frequency,
            {_ROUND.format('ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1')} AS idf FROM d_t GROUP BY hash"""),
        "unique_kmer_count_documents": sql.statement(_k("d", "hp"), "SELECT name, CAST(hash AS VARCHAR) AS hashval, count(DISTINCT kmer) AS n_originals FROM d_k GROUP BY ALL"),
        "index_equivalence_documents": sql.statement([*_k("d", "hp"), *[(n.replace("d_", "x_"), s.replace("d_", "x_")) for n, s in _k("d", "dayhoff")]],
            "SELECT 'hp' AS other, count(*) = 0 AS equal FROM (SELECT * FROM d_k EXCEPT ALL SELECT * FROM d_k) UNION ALL SELECT 'dayhoff', count(*) = 0 FROM (SELECT * FROM d_k EXCEPT ALL SELECT * FROM x_k)"),
    }

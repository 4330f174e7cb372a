"""Token counts with a digest cache.

The normalised content of every text (null becomes the empty string; nothing else
is changed, so a stored count is exactly the library's count) is digested with
SHA-256. The cache is a Parquet table ``(tokenizer, digest, n_tokens)``, laid out by
the digest of the tokenizer file. Digests of the rows meet the cache; each digest that it lacks is encoded once, counts are
appended, and all rows get their counts. The stored cache is not moved for a batch of ``APART`` digests at most: their hashes are broadcast, and only what
has one of them goes on from the scan.

Texts are not moved to find distinct misses: a digest that one row alone has is encoded where that row is read. Rows whose digest the cache
has or several rows share are told by a broadcast set of hashes, ``APART`` at most; only their texts are dealt out. With more of
them all misses are.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are
kept, each with its count; texts of any length are encoded whole; an empty table gives an empty result; further columns
of the input are ignored (``keep`` names those to carry along, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import steps, texts
from ._store import saved, scratch, table

MODEL = "piece_bpe_32k.model"
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
TOKEN_LIMIT = 4096
#: Hashes in the broadcast set, of 16 bytes each.
APART = 1_000_000


def tokenizer_path(name: str) -> str:
    """Where a named tokenizer file lies on this machine; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """Digest of the tokenizer file's bytes."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


_loaded: dict[str, object] = {}


def counter(name: str):
    """A function from texts to token counts, loaded once in each worker."""
    if name not in _loaded:
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda xs: [len(x) for x in model.encode(xs, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_padding()
            own.no_truncation()
            _loaded[name] = lambda xs: [len(x) for x in own.encode_batch_fast(xs, add_special_tokens=False)]
    return _loaded[name]


def digested(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` (a struct), ``content`` (null: empty) and ``digest``."""
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*keep, F.lit(0)).alias("keep"), content.alias("content"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"))


def encode(rows: DataFrame, model: str) -> DataFrame:
    """``digest, content`` to ``digest, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for part in steps(batch, "content", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("digest").cast(pa.binary()), pa.array(count(texts(part, "content")), pa.int64())], ["digest", "n_tokens"])

    return rows.select("digest", "content").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer version; None where there is no table yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")


def cached(stored: DataFrame | None, seen: DataFrame, apart: int = APART) -> DataFrame:
    """``digest, n_tokens`` of the stored digests that are in ``seen``."""
    if stored is None:
        return seen.sparkSession.createDataFrame([], "digest binary, n_tokens long")
    key = F.xxhash64("digest").alias("key")
    if seen.limit(apart + 1).count() <= apart:
        stored = stored.join(F.broadcast(seen.select(key)), F.xxhash64(stored["digest"]) == F.col("key"), "left_semi")
    return stored.join(seen.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def update_cache(rows: DataFrame, seen: DataFrame, cache_path: str, model: str, apart: int = APART) -> DataFrame:
    """Encode what the cache lacks, append it, and return ``digest, n_tokens`` of the digests in ``seen`` (``digest, n``)."""
    spark, version = rows.sparkSession, tokenizer_version(model)
    key = F.xxhash64("digest").alias("key")
    hits, _ = saved(cached(read_cache(spark, cache_path, version), seen, apart), "cache-hits")
    # what cannot be encoded where it is read
    told = hits.select(key).unionByName(seen.where("n > 1").select(key))
    n_told = told.count()
    if n_told <= apart:
        told = F.broadcast(told.distinct())
        keyed = rows.select("digest", "content", key)
        misses = keyed.join(told, "key", "left_anti").select("digest", "content")
        if n_told:
            shared = keyed.join(told, "key", "left_semi").select("digest", "content").dropDuplicates(["digest"])
            misses = misses.unionByName(shared.join(hits, "digest", "left_anti"))
    else:
        lacking = seen.join(hits, "digest", "left_anti").select("digest")
        misses = rows.select("digest", "content").join(lacking, "digest", "left_semi").dropDuplicates(["digest"])
    new, _ = saved(encode(misses, model), "new-counts")
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    return hits.unionByName(new)


def count_tokens(docs: DataFrame, cache_path: str, model: str = MODEL, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), apart: int = APART) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` for every row of ``docs``."""
    rows = digested(docs, text_col, keep)
    own, _ = saved(rows.select("keep", F.octet_length("content").cast("long").alias("n_bytes"), "digest"), "digests")
    counts = update_cache(rows, own.groupBy("digest").agg(F.count("*").alias("n")), cache_path, model, apart)
    return own.join(counts, "digest", "left").select(*(F.col("keep")[c].alias(c) for c in keep), "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents; each call starts from an empty cache of its own."""
    out = count_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)

"""Steps whose cost must follow the input: the same results as the plain form, with less moved or stored."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protloom.index import ProteinIndex
from protloom.operators import kmers as km
from protloom.operators import search as se
from protloom.operators import signature_ops as so
from protloom.operators import stitch as st
from protloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    """Sequences of a few syllables: long, short and empty ones."""
    own = random.Random(7)
    syllables = ["AN", "ER", "THE", "ION", "RE", "ST", "BLE", "OU"]
    rows = [(str(i), "".join(own.choice(syllables) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 40, 400, 4000, *[200] * 60])]
    return spark.createDataFrame([*rows, ("none", None)], "name string, sequence string").coalesce(1).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hashes_are_grouped_by_count_where_they_are_read(texts):
    got = so.hashes_of_counts(texts, 5, "hp", 2)
    assert rows(got) == rows(so.kmers_by_count(km.kmer_positions(texts, 5, "hp", 2)))
    assert "Exchange" not in plan(got)


@pytest.mark.parametrize(("ksize", "scaled", "held"), [(8, 1, 1 << 21), (5, 3, 50), (11, 2, 50)])
def test_distinct_kmers(texts, ksize, scaled, held):
    every = km.kmer_positions(texts, ksize, "dayhoff", scaled).select("encoded", "hashval")
    assert rows(km.distinct_kmers(texts, ksize, "dayhoff", scaled, held)) == rows(every.distinct())


def test_a_task_hands_on_each_kmer_once(texts):
    many = texts.unionByName(texts).unionByName(texts).coalesce(1)
    assert km.kmers_of_tasks(many, 5, "hp").count() == km.kmer_positions(many, 5, "hp").select("encoded").distinct().count()


@pytest.mark.parametrize(("ksize", "step"), [(5, 1 << 18), (5, 300), (11, 300)])
def test_distinct_counts_are_sums_of_the_records(texts, ksize, step):
    want = km.original_counts(texts, ksize, "dayhoff", 2).groupBy("name").agg(F.count("*"), F.sum("n_originals"))
    got = km.distinct_counts(texts, ksize, "dayhoff", 2, step=step)
    sizes = got.groupBy("name").agg(F.sum("n_hashes"), F.sum("n_originals"), F.sum("length"))
    lengths = {r["name"]: len(r["sequence"] or "") for r in texts.collect()}
    assert rows(sizes) == sorted(((*r, lengths[r[0]]) for r in rows(want)), key=str)
    if step == 1 << 18:
        assert got.count() == want.count()


def test_kmers_that_come_together_are_the_same(texts):
    want = rows(km.kmer_positions(texts, 5, "dayhoff", 2))
    assert want == rows(km.kmer_positions(texts, 5, "dayhoff", 2, together=1000)) == rows(km.kmer_positions(texts, 5, "dayhoff", 2, together=1 << 21))


def test_files_of_positions_are_smaller(spark, tmp_path):
    """The query's result against the same rows by record and start."""
    docs = registry._sequences(spark, SF.replace("0.001", "0.01"), "d").where("id < 400").coalesce(1)
    size = {}
    for name, own in (("apart", {}), ("together", {"together": registry.TOGETHER})):
        made = km.kmer_positions(docs, 8, "dayhoff", **own).withColumn("hashval", so.unsigned_text(F.col("hashval")))
        made.write.parquet(str(tmp_path / name), compression="snappy")
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size["together"] < 0.75 * size["apart"]


def test_measures_of_pairs_come_from_counts(spark):
    own = random.Random(3)
    shared = spark.createDataFrame([(q, m, own.choice([1, 1, 1, 2, 3, 50, 10**6])) for q in range(3) for m in range(40) for _ in range(m % 7 + 1)], "query_id long, match_id long, match_abund long")
    a = F.col("match_abund")
    plain = shared.groupBy("query_id", "match_id").agg(F.count("*"), F.sum(a), F.avg(a), F.median(a), F.stddev_pop(a))
    got = se.abundances(shared).select("query_id", "match_id", "intersect_hashes", "n_weighted_found", "average_abund", "median_abund", "std_abund")
    for x, y in zip(rows(got), rows(plain), strict=True):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
    assert "ObjectHashAggregate" not in plan(got)


def test_a_compaction_is_sorted_without_the_folders(spark, texts, tmp_path):
    own = ProteinIndex(spark, str(tmp_path / "index"), 5)
    own.store(texts.where("sequence is not null"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    own.compact(bucket_rows=500)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    last, _ = own._merged()
    files = sorted((tmp_path / "index/postings" / f"call={last['name']}").glob("bucket=*/*.parquet"))
    assert len(files) > 8
    for f in files:
        stored = [(r["hashval"] % 2**64, r["id"]) for r in spark.read.parquet(str(f)).collect()]
        assert stored == sorted(stored)
        assert {h >> 64 - last["bits"] for h, _ in stored} == {int(f.parent.name.removeprefix("bucket="))}
    assert rows(own.postings()) == rows(own.sketch().select("id", "hashval", "abund"))


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_combined_sketches(texts, held):
    assert rows(km.combined_of(texts, 5, "dayhoff", held=held).select("hashval", "abund", "df")) == rows(km.combined_sketch(km.sketches(texts, 5, "dayhoff")))


@pytest.mark.parametrize("kmers", [["ABCD", "BCDE", "XYZW"] * 4, ["ABCD", "ABC", "XYZWV"] * 4, ["ABCD", "ÄBCD", "XYZW"] * 4])
def test_pieces_of_runs(kmers):
    steps = [0, 1, 2, 0, 4, 9, 0, -1, -4, 0, -7, 3]
    first, want = [0, 3, 6, 9], []
    for a, z in zip(first, [*first[1:], 12], strict=True):
        want.append("".join(k[-d:] if d else k for k, d in zip(kmers[a:z], steps[a:z], strict=True)))
    column = pa.array(["pad", *kmers]).slice(1)
    got = st._pieces(column, np.array(steps), np.array(first))
    assert got.to_pylist() == want and got.type == pa.string()


def test_runs_of_a_batch_are_made_without_lists_of_their_kmers(spark, monkeypatch):
    """Only the runs at a batch's ends are glued k-mer by k-mer."""
    column = pa.array(["ABCDEFGH"] * 10)
    monkeypatch.setattr(st, "_glued", None)
    batch = pa.RecordBatch.from_pydict({"match_id": list(range(10)), "query_id": [1] * 10, "match_name": ["m"] * 10, "query_name": ["q"] * 10, "offset": pa.array([0] * 10, pa.int32()), **{c: column for c in st._TEXTS}})
    names = [x.split()[0] for x in st._FRAGMENTS.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in st._FRAGMENTS.split(", ")]
    made = st._inner(batch, np.array([2, 3, 5, 9]), np.arange(10), np.arange(10), 7, 3, names, types)
    assert made.column("q").to_pylist() == ["ABCDEFGH", "ABCDEFGHH", "ABCDEFGHHHH"] and made.column("n").to_pylist() == [3, 4, 5]


@pytest.mark.parametrize(("ksize", "moltype", "scaled", "step"), [(8, "hp", 1, 1 << 18), (5, "dayhoff", 2, 300), (11, "hp", 1, 300), (8, "protein", 1, 50)])
def test_infos_as_texts(texts, ksize, moltype, scaled, step):
    joined = F.array_join(F.transform("positions", lambda x: x.cast("string")), ",")
    want = km.kmer_infos(texts, ksize, moltype, scaled).select("name", so.unsigned_text(F.col("hashval")), "encoded", "kmer", joined)
    assert rows(km.kmer_info_texts(texts, ksize, moltype, scaled, step=step)) == rows(want)


def test_texts_of_infos_are_made_in_the_tasks(spark):
    """No expression touches the rows, of which there is one for each k-mer of a record."""
    made = plan(registry.queries()["kmer_info_map_documents"](spark, SF))
    assert "Project" not in made.partition("MapInArrow")[0]


@pytest.mark.parametrize("ksize", [1, 4, 8, 11])
@pytest.mark.parametrize("letters", [b"AZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"aA*\xff"])
def test_keys_are_ordered(ksize, letters):
    own = np.random.default_rng(ksize)
    for n in (0, 1, 3000):
        keys = km._sortable(np.frombuffer(letters, np.uint8)[own.integers(0, len(letters), (n, ksize))])
        order, told = km._ascending(keys, ksize)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist()
        assert km._changes(told).tolist() == km._changes(keys[order]).tolist()


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    """Also where the text of a double is a tie and the double is not."""
    own = random.Random(4)
    values = [0.0, -0.0, 8.0125, 0.9973404255319149, -6.315184585345834, 1 / 512, -1 / 512, 2.5, 1e18, float("inf"), None, *(own.uniform(-10, 10) for _ in range(3000)), *(own.random() * 10**-9 for _ in range(300)), *(a / 701 for a in range(3000))]
    values_ = pa.table({"i": range(len(values)), "x": pa.array(values, pa.float64())})
    for digits in (3, 8, 12, 14):
        want = duckdb.sql(f"SELECT round(x, {digits}) FROM values_ ORDER BY i").fetchall()
        got = spark.createDataFrame(list(enumerate(values)), "i long, x double").orderBy("i").select(registry._rounded(F.col("x"), digits))
        assert [tuple(r) for r in got.collect()] == want
    assert "round(" not in registry._digits(spark.range(1).select(F.rand().alias("x")))._jdf.queryExecution().optimizedPlan().toString()

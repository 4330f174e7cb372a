"""Results of many times their input: equal k-mers of a task come one after the other, over the batches that it reads."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protloom.functions.hashing import unsigned_text
from protloom.operators import kmers as km
from protloom.plans import registry

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    own = random.Random(5)
    names = ["AN", "ER", "THE", "ION", "RE", "ST", "BLE", "OU", "X*", "A" * 12]
    made = [(str(i), "".join(own.choice(names) for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 40, 400, 4000, *[60] * 50])]
    return spark.createDataFrame([*made, (None, "NONAMEATALLNONAMEATALL"), ("none", None)], "name string, sequence string").coalesce(1).cache()


@pytest.mark.parametrize(("ksize", "moltype", "scaled", "step"), [(8, "dayhoff", 1, 1 << 23), (5, "protein", 3, 700), (1, "hp", 1, 50), (11, "hp", 2, 3000), (8, "raw", 1, 9)])
def test_positions_as_texts(texts, ksize, moltype, scaled, step):
    want = km.kmer_positions(texts, ksize, moltype, scaled).select("name", F.col("start").cast("long"), "kmer", "encoded", unsigned_text(F.col("hashval")).alias("hashval"))
    got = km.kmer_position_texts(texts, ksize, moltype, scaled, step=step)
    assert got.dtypes == want.dtypes and rows(got) == rows(want)


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
@pytest.mark.parametrize("whole", [False, True])
def test_pieces_of_runs(monkeypatch, piece, whole):
    monkeypatch.setattr(km, "_STEP", piece)
    own = random.Random(2)
    sequences = ["A" * 40, "".join(own.choices("ACD", k=300)), "CA", *("".join(own.choices("AC", k=9)) for _ in range(9)), "A" * 30]
    batches = [pa.RecordBatch.from_pydict({"name": [str(i) for i in range(a, min(a + 4, len(sequences)))], "sequence": sequences[a : a + 4]}) for a in range(0, len(sequences), 4)]
    found, order = [], []
    for runs in km._runs(iter(batches), 3, km._lookup("dayhoff"), np.uint64(2**64 - 1), 500):
        for kind, record, start, part in runs.pieces(whole):
            kmers = [bytes(x).decode() for x in runs.raw[part][kind]]
            names = runs.names.take(pa.array(record)).to_pylist()
            found += zip(names, start.tolist(), kmers, strict=True)
            pairs = {(n, x) for n, x in zip(names, kmers, strict=True)}
            assert not (whole and pairs & set(order)), "a k-mer of a record is in two pieces"
            order += pairs
    assert sorted(found) == sorted((str(i), a, s[a : a + 3]) for i, s in enumerate(sequences) for a in range(len(s) - 2))


def test_keys_of_windows():
    data = np.frombuffer(b"ACDEFGHIKLMNPQRSTVWYAXZ", np.uint8)
    for k in (1, 5, 8, 9):
        at = np.arange(len(data) - k + 1)[::2]
        assert (km._keys(data, at, k) == km._sortable(np.lib.stride_tricks.sliding_window_view(data, k)[at])).all()


def test_bytes_of_a_row(spark, tmp_path):
    """The queries' results against rows in the order of steps within a batch, by snappy."""
    docs = registry._sequences(spark, SF, "d")
    before = {
        "kmer_positions": km.kmer_positions(docs, 8, "dayhoff", together=registry.TOGETHER).select("name", F.col("start").cast("long"), "kmer", "encoded", unsigned_text(F.col("hashval")).alias("hashval")),
        "kmer_info_map": km.kmer_info_texts(docs, 8, "hp", step=1 << 18),
    }
    for query, old in before.items():
        old.write.parquet(str(tmp_path / query / "before"), compression="snappy")
        registry.queries()[f"{query}_documents"](spark, SF).write.parquet(str(tmp_path / query / "after"))
        size = {x: sum(f.stat().st_size for f in (tmp_path / query / x).glob("*.parquet")) for x in ("before", "after")}
        assert size["after"] < 0.75 * size["before"], (query, size)


def test_a_codec_of_the_application_stays(spark):
    from protloom.scratch import small_results

    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    try:
        for told, want in (("snappy", "zstd"), ("gzip", "gzip")):
            spark.conf.set(key, told)
            small_results(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)

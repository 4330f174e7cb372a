import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from protloom.llm import packing as pk
from protloom.llm.token_counts import tokenizer_path
from protloom.llm.word_ids import word_ids

PATH = tokenizer_path(pk.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(word_ids(PATH).encode([text])[0], "<u4").tolist()


def test_every_simple_character_splits_like_the_library():
    for c in range(0x250):
        for text in (chr(c), f"a{chr(c)}b", f"1{chr(c)}'s {chr(c)}{chr(c)}", f"{chr(c).upper()}Ab{chr(c)}"):
            assert ids(text) == library_ids(text), (c, text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("aZéß'st.,!  \n09<|>|_İ́", max_size=40)))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == library_ids(text)


def check(rows, docs, capacity=pk.CAPACITY):
    """Pieces cover their documents, and sequences have no holes and no overflow."""
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["piece"], r["ids_crc32"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    for d in docs:
        own = library_ids(d["text"] or "") + [1]
        got = sorted(set(pieces[d["doc_id"]]))
        assert [x[2] for x in got] == list(range(len(got)))
        assert sum(x[1] for x in got) == len(own)
        for start, length, k, crc in got:
            assert start == k * capacity and (length == capacity or k == len(got) - 1)
            assert crc == zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())
    return len(places)


@pytest.mark.parametrize("rows_per_task", [200_000, 30])
def test_packs_like_sequential_best_fit(spark, sf, rows_per_task):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pk.pack_documents(docs, rows_per_task=rows_per_task).collect()
    n = check(rows, docs.collect())
    lengths = np.sort([r["length"] for r in rows])[::-1]
    placed, _, _ = pk.best_fit(lengths, np.arange(len(lengths)), [], pk.CAPACITY)
    best = len({s for _, s, _ in placed})
    assert n == best if rows_per_task > 1000 else n <= best * 1.1
    assert best <= np.ceil(lengths.sum() / pk.CAPACITY) * 1.05


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pk.pack_documents(odd_docs, capacity=512, rows_per_task=3).collect()
    known = [d for d in odd_docs.collect() if d["doc_id"] is not None]
    check([r for r in rows], known[:0], 512)
    assert sum(r["length"] for r in rows) == sum(len(library_ids(d["text"] or "")) + 1 for d in odd_docs.collect())
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    assert pk.pack_documents(no_docs).collect() == []


def test_equal_lengths_over_many_ranges(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 60).otherwise(20).alias("length"), F.lit(1).alias("size"))
    got = pk.pack(rows, capacity=100, rows_per_task=100).collect()
    assert len(got) == 3000 == len({r["id"] for r in got})
    total = sum(60 if r["id"] % 3 == 0 else 20 for r in got)
    assert len({r["sequence_id"] for r in got}) <= total / 100 * 1.05 + 1


def test_rank_intervals():
    assert pk.rank_intervals([(0, 0, 3), (1, 2, 1), (2, 5, 0)]) == [(1, 0, 0, 1, 2), (2, 0, 1, 0, 1), (2, 1, 0, 0, 1)]


def test_sequences_hold_the_ids(spark, odd_docs):
    docs = odd_docs.where("doc_id in (2, 4, 5)")
    placed = pk.pack_documents(docs, with_ids=True)
    (row,) = pk.sequences(placed).collect()
    got = np.frombuffer(row["ids"], "<u4").tolist()
    want = {d["doc_id"]: library_ids(d["text"]) + [1] for d in docs.collect()}
    for doc, at in zip(row["doc_ids"], row["offsets"], strict=True):
        assert got[at : at + len(want[doc])] == want[doc]
    assert len(got) == row["n_tokens"]


def test_many_ranges_need_hardly_more_sequences(spark):
    lengths = [r["length"] for r in pk.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()]
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    n = {k: pk.pack(rows, rows_per_task=k).select("sequence_id").distinct().count() for k in (200_000, 300)}
    assert n[200_000] <= np.ceil(sum(lengths) / pk.CAPACITY) * 1.002 + 1 and n[300] <= n[200_000] * 1.01 + 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_file(spark, odd_docs, name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(pk.tokenizer_path(name))
    want = sorted((str(d["doc_id"]), len(own.encode(d["text"] or "", add_special_tokens=False).ids) + 1) for d in odd_docs.collect())
    got = pk.token_pieces(odd_docs, vocabulary=name, capacity=10**6).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == want
    text = "Hello it's  2024 ﬁ <|endoftext|> naïve"
    (row,) = pk.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary=name, with_ids=True).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [*own.encode(text, add_special_tokens=False).ids, 1]

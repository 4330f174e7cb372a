import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from protloom.llm import slack_packing as sp
from protloom.llm.token_counts import tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path(sp.VOCABULARY))


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 90))
def test_least_slack_is_the_best_of_all_choices(lengths, room):
    taken = sp.least_slack(dict(Counter(lengths)), room)
    assert all(taken[n] <= lengths.count(n) for n in taken)
    best = max(s for r in range(len(lengths) + 1) for s in (sum(x) for x in itertools.combinations(lengths, r)) if s <= room)
    assert sum(n * c for n, c in taken.items()) == best


def check(rows, docs, capacity=sp.CAPACITY):
    """Each id lies in one piece, sequences have no holes, and none needs padding."""
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and not at & (at - 1)
    for d in docs:
        own, at = library_ids(d["text"]), 0
        for start, length, crc, tokens in sorted(pieces[d["doc_id"]]):
            assert start == at and tokens == len(own)
            assert crc == zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(own)
    return places, pieces


def test_packs_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sp.pack_documents(docs, high=1 << 16).collect()
    places, pieces = check(rows, docs.collect())
    # besides cuts of long documents, few are cut
    extra = sum(len(x) - 1 - (x[0][3] - 1) // sp.CAPACITY for x in pieces.values())
    assert extra <= len(places) * 0.1 + 13


def test_many_copies_of_one_length():
    waiting = sp.Waiting()
    for i in range(5000):
        waiting.put((i, 0, memoryview(bytes(4 * 1000)), 1000))
    out = [*waiting.sequences(4096, 0), *waiting.rest()]
    assert sum(len(x[2]) // 4 for s in out for x in s) == 5_000_000
    sizes = [sum(len(x[2]) // 4 for x in s) for s in out]
    assert sizes.count(4096) == 5_000_000 // 4096 and all(not n & (n - 1) for n in sizes)


@pytest.mark.parametrize(("longest", "cuts"), [(4095, 1.0), (1000, 0.02)])
def test_pieces_of_every_length(longest, cuts):
    rng, waiting = random.Random(5), sp.Waiting()
    for i in range(3000):
        waiting.put((i, 0, memoryview(bytes(4 * rng.randrange(1, longest + 1))), 1))
    before = waiting.tokens
    out = list(waiting.sequences(4096, before // 2))
    assert all(sum(len(x[2]) // 4 for x in s) == 4096 for s in out) and before // 2 >= waiting.tokens >= before // 2 - 4096
    assert sum(x[1] > 0 for s in out for x in s) <= len(out) * cuts


def test_odd_rows(spark, odd_docs, no_docs):
    for capacity in (4096, 64, 1):
        rows = sp.pack_documents(odd_docs.where("doc_id is null or doc_id <> 4"), capacity=capacity, high=200).collect()
        check(rows, [d for d in odd_docs.collect() if d["doc_id"] not in (4,)], capacity)
    twice = sp.pack_documents(odd_docs.where("doc_id = 4").withColumn("start", F.lit(1))).collect()
    assert sum(r["length"] for r in twice) == 2 * len(library_ids("one word"))
    assert sp.pack_documents(no_docs).collect() == []


def test_ids_go_along(spark):
    docs = spark.createDataFrame([(1, "some words " * 3000), (2, "a few more")], "doc_id long, text string")
    rows = sp.pack_documents(docs, capacity=256, with_ids=True).collect()
    for doc, text in ((1, "some words " * 3000), (2, "a few more")):
        got = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]))
        assert np.frombuffer(got, "<u4").tolist() == library_ids(text)

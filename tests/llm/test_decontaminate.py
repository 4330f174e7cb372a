import math
import random
from collections import Counter

import numpy as np
import pytest

from protloom.llm import _words
from protloom.llm import decontaminate as dc

SF = "/root/testdata/sf0.01"


def grams(text):
    words = "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else " " for c in text.lower()).split()
    if not words:
        return []
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) > 4 else [tuple(words)]


def plain(docs, items, threshold=0.8):
    """Every window of every document against every item, exactly."""
    held = Counter(g for _, t in items for g in set(grams(t or "")))
    n_items = sum(bool(grams(t or "")) for _, t in items)
    weight = lambda g: math.log(1 + n_items / max(1, held[g]))
    out = set()
    for d, text in docs:
        own = grams(text or "")
        for i, t in items:
            want = Counter(grams(t or ""))
            n = sum(want.values())
            if not n or not set(own) & set(want):
                continue
            for p in range(max(1, len(own) - n + 1)):
                have = Counter(own[p : p + n])
                both = sum(min(have[g], want[g]) * weight(g) for g in want)
                if both / (sum(v * weight(g) for g, v in (have | want).items())) >= threshold:
                    out.add((d, i))
                    break
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_equals_every_window(spark, benchmark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    got = dc.matches(docs, benchmark).collect()
    assert len(want) > 10 and {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["similarity"] >= 0.8 for r in got)
    blocks = dc.matches(docs, benchmark, item_block=7).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    marked = [{(r["doc"]["doc_id"], m["item_id"]) for r in dc.with_matches(docs, benchmark, item_block=n).collect() for m in r["matches"]} for n in (7, 4096)]
    assert marked == [want, want]


def test_passages_at_every_offset_and_small_changes():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 9, 17, 33, 60, 61, 300])]
    docs, exact = [], set()
    for k, text in items:
        for before in (0, 1, 2, 3, 7, 20):
            for after in (0, 1, 40):
                docs.append((len(docs), " ".join([word() for _ in range(before)] + [text.upper()] + [word() for _ in range(after)])))
                exact.add((len(docs) - 1, k))
        words = text.split()
        docs.append((len(docs), " ".join([*words[:-1], word(), "tail " * 9])))
    index = dc.Index(items)
    found = index.matches([t for _, t in docs])
    got = {(d, m[0]) for d, own in enumerate(found) for m in own}
    assert exact <= got <= plain(docs, items)
    near = plain(docs, items) - exact
    assert len(got - exact) >= 0.99 * len(near)


def test_odd_rows(spark, odd_docs, no_docs, benchmark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "One  WORD!"), (4, "long word " * 20), (None, "x" * 50_000)], "item_id long, text string")
    got = sorted({(r["doc_id"], r["item_id"]) for r in dc.matches(odd_docs, items).collect()}, key=str)
    assert got == [(4, 3), (6, 4), (7, None), (8, 3)]
    assert dc.matches(odd_docs, items).where("doc_id = 4").count() == 2
    assert dc.matches(no_docs, items).collect() == []
    assert dc.matches(odd_docs, items.limit(0)).collect() == []
    marked = dc.with_matches(odd_docs, items).collect()
    assert len(marked) == odd_docs.count() and {r["doc"]["doc_id"] for r in marked if r["matches"]} == {4, 6, 7, 8}


def test_tables_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    index = dc.Index([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(40)])
    (n,) = index.classes
    prints = index.prints[n]
    for _ in range(300):
        k, bits = rng.integers(len(prints)), rng.choice(64, rng.integers(0, dc.RADIUS + 1), replace=False)
        other = prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else prints[k]
        assert k in index.near(n, np.array([other], "<u8"))[1]


def test_simhash_by_definition():
    rng = np.random.default_rng(2)
    for n in (1, 3, 200, 300, 1000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > n)
        assert dc.simhash(h) == want
    h = rng.integers(0, 2**64, 50, dtype=np.uint64)
    sums, lane = dc.window_counts(h, 20)
    assert dc.fingerprints(sums, lane, 20).tolist() == [dc.simhash(h[i : i + 20]) for i in range(31)]


def test_words_and_shingles_by_definition():
    texts = ["", "a b c d e f", "É é ß", "one", "a b c d e f", "x " * 3000, "y" * 3_000_000 + " z", "a\tb_c-d"]
    words = _words.split(texts)
    own = _words.shingles(words)
    for k, t in enumerate(texts):
        assert (own.doc == k).sum() == len(grams(t))
    names: dict = {}
    for g, h in zip([g for t in texts for g in grams(t)], own.hash.tolist(), strict=True):
        assert names.setdefault(h, g) == g
    assert len(set(names.values())) == len(names)
    again = _words.shingles(_words.split([t * 1 for t in reversed(texts)]))
    assert sorted(again.hash.tolist()) == sorted(own.hash.tolist())


def changed_passages(n_docs, seed):
    """Items, and documents that each hold one of them with one or two changed words, behind some other words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(25, 90)))) for k in range(20)]
    docs = []
    for d in range(n_docs):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = word()
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 40))] + words + [word() for _ in range(rng.randint(0, 40))])))
    return items, docs


def test_no_window_within_the_radius_is_missed():
    items, docs = changed_passages(600, 8)
    index = dc.Index(items)
    got = {(d, m[0]) for (d, _), own in zip(docs, index.matches([t for _, t in docs]), strict=True) for m in own}
    want = plain(docs, items, 0.8 - 1e-9)  # 0.8 but for rounding counts
    near = set()
    for d, i in want:
        h = _words.shingles(_words.split([docs[d][1]])).hash
        (item,) = [x for members in index.classes.values() for x in members if x.item_id == i]
        if any((dc.simhash(h[p : p + item.n]) ^ item.fingerprint).bit_count() <= dc.RADIUS for p in range(len(h) - item.n + 1)):
            near.add((d, i))
    assert len(want) > 150 and near <= got <= want
    assert len(got) >= 0.99 * len(want)


def test_moved_parts_and_weighted_short_texts():
    words = [f"w{j}" for j in range(60)]
    moved = words[-9:] + words[:-9]
    index = dc.Index([(1, " ".join(words))])
    (found,) = index.matches([" ".join(["before"] * 7 + moved + ["after"] * 7)])
    assert plain([(0, " ".join(moved))], [(1, " ".join(words))]) == {(0, 1)} == {(0, m[0]) for m in found}
    # a template that all items share weighs little, so a text without half of it still matches
    template = [f"t{j}" for j in range(20)]
    items = [(k, " ".join([f"i{k}x{j}" for j in range(30)] + template)) for k in range(60)]
    docs = [(0, " ".join(items[7][1].split()[:37]))]
    assert {(0, m[0]) for m in dc.Index(items).matches([docs[0][1]])[0]} == plain(docs, items) == {(0, 7)}


def test_weights_are_of_the_whole_benchmark(spark):
    template = [f"t{j}" for j in range(20)]
    items = [(k, " ".join([f"i{k}x{j}" for j in range(30)] + template)) for k in range(60)] + [(60, " ".join(f"z{j}" for j in range(100)))]
    own = items[7][1].split()
    # without half of the template; with a changed template; with a template of other items in the middle
    docs = [(0, " ".join(own[:37])), (1, " ".join([*own[:34], *"abcdefghijklmnop"])), (2, " ".join([*(f"z{j}" for j in range(86)), *template[:14]])), (3, "other words only, nothing of an item")]
    want = plain(docs, items)
    assert {(0, 7), (2, 60)} <= want
    rows, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(tuple(r) for r in dc.matches(rows, benchmark.orderBy(by), item_block=n).collect()) for n in (4096, 20) for by in ("item_id", "text")]
    assert {(r[0], r[1]) for r in found[0]} == want and all(f == found[0] for f in found)
    marked = dc.with_matches(rows, benchmark, item_block=20).collect()
    assert {(r["doc"]["doc_id"], m["item_id"]) for r in marked for m in r["matches"]} == want


def test_candidates_are_few_among_many_items_of_a_length():
    rng = np.random.default_rng(5)
    index = dc.Index([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(400)])
    (n,) = index.classes
    found = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    compared = sum((np.searchsorted(v, found.view("<u2").reshape(-1, 4)[:, b], "right") - np.searchsorted(v, found.view("<u2").reshape(-1, 4)[:, b])).sum() for b, (v, _) in enumerate(index.postings[n]))
    assert compared < 0.06 * len(found) * 400
    exact = {(r, m) for r, m in zip(*np.nonzero(np.bitwise_count(found[:, None] ^ index.prints[n][None, :]) <= index.radius), strict=True)}
    assert set(zip(*(x.tolist() for x in index.near(n, found)), strict=True)) == exact


def test_the_sieve_keeps_all_that_hold_a_shingle():
    items = [(k, " ".join(f"i{k}x{j}" for j in range(30))) for k in range(300)]
    sieve = dc.Sieve(300 * 26)
    for h in dc._shingles_of(items):
        sieve.add(h)
    holding = ["some words " + " ".join(t.split()[3:8]) for _, t in items]
    assert sieve.may_hold(holding).all()
    assert sieve.may_hold([" ".join(f"o{k}x{j}" for j in range(50)) for k in range(1000)]).mean() < 0.05
    assert not sieve.may_hold(["", "one"]).any()

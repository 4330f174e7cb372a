import random
from collections import Counter

import numpy as np
import pytest

from protloom.llm import _words
from protloom.llm import jaccard_join as jj
from protloom.llm.graphs import components


def sets_of(docs):
    out = []
    for _, text in docs:
        own = _words.shingles(_words.split([text or ""]))
        out.append(frozenset(own.hash.tolist()))
    return out


def plain(docs, threshold=0.8):
    """Links by comparing all pairs that share a shingle; classes by union."""
    sets = sets_of(docs)
    by = {}
    for k, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(k)
    shared = Counter()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] += 1
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(docs)
    for (a, b), both in shared.items():
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            n[a] += 1
            n[b] += 1
            root[find(a)] = find(b)
    name = {}
    for k, (i, _) in enumerate(docs):
        name.setdefault(find(k), []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in name.items()}
    return sorted(((i, least[find(k)], n[k]) for k, (i, _) in enumerate(docs)), key=str)


def run(df, **kw):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jj.near_classes(df, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def near_group(spark):
    """A group of near copies larger than a leaf, copies of one of them, and texts that share a passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    docs = []
    for k in range(220):
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(120)] = word()
        docs.append((k, " ".join(own)))
    docs += [(300 + k, docs[7][1].upper()) for k in range(5)]
    docs += [(400 + k, " ".join(passage + [word() for _ in range(50)])) for k in range(200)]
    return docs


def test_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()])
    assert sum(x[2] for x in want) > 100
    assert run(docs) == want


@pytest.mark.parametrize(("leaf", "depth", "block"), [(128, 6, 256), (16, 2, 20)])
def test_large_groups(spark, near_group, monkeypatch, leaf, depth, block):
    monkeypatch.setattr(jj, "BLOCK_SETS", block)
    own = jj.chosen_path_links
    monkeypatch.setattr(jj, "chosen_path_links", lambda nodes, threshold, target: own(nodes, threshold, target, leaf, depth))
    docs = spark.createDataFrame(near_group, "doc_id long, text string")
    assert run(docs) == plain(near_group)


def test_recall_of_single_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for k in range(400):
        own = [word() for _ in range(100)]
        docs.append((2 * k, " ".join(own)))
        own[rng.randrange(20, 80)] = word()
        own[rng.randrange(20, 80)] = word()
        docs.append((2 * k + 1, " ".join(own)))
    want = plain(docs)
    got = run(spark.createDataFrame(docs, "doc_id long, text string"))
    linked = sum(x[2] for x in want)
    assert linked > 200 and sum(x[2] for x in got) >= 0.99 * linked


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(odd_docs) == plain(rows)
    assert run(no_docs) == []
    kept = jj.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, None, 5, 6, 7], key=str)
    assert jj.drop_near_copies(no_docs).collect() == []


def test_one_document_of_each_class_stays(spark, near_group):
    docs = spark.createDataFrame([*near_group, *near_group[:3], (900, ""), (900, "")], "doc_id long, text string")
    classes = {x[1] for x in plain(near_group)}
    assert sorted(r["doc_id"] for r in jj.drop_near_copies(docs).collect()) == sorted([*classes, 900, 900])


def test_runs_follow_the_target():
    assert jj.runs_for(0.5, 0.8) < jj.runs_for(0.99, 0.8) <= jj.runs_for(0.99, 0.5)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for e in links if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**64, 100, dtype=np.uint64)])
    m = jj.minhashes(np.concatenate([a, b]), np.array([0, 1000]))
    assert abs((m[0] == m[1]).mean() - 900 / 1100) < 0.2


def test_exact_links():
    sets = [np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [1, 2, 3, 5])]
    assert {i: f.tolist() for i, f in jj.exact_links(sets, 0.8)} == {0: [1], 1: [3], 2: []}
    assert {i: f.tolist() for i, f in jj.exact_links(sets, 0.8, split=1)} == {0: [1]}


def test_a_tight_group_is_settled_by_its_pivot(spark, monkeypatch):
    """Blocks near the pivot link as wholes; a few sets further out, and repeated rows, are compared."""
    monkeypatch.setattr(jj, "BLOCK_SETS", 30)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for k in range(400):
        own = list(base)
        for _ in range(rng.choice((0, 1, 1, 1, 2) if k % 20 else (3, 5, 8))):
            own[rng.randrange(150)] = word()
        docs.append((k, " ".join(own)))
    docs += docs[:7]
    pairs = []
    own = jj.verify
    monkeypatch.setattr(jj, "verify", lambda members, threshold: pairs.append(members.select("root", "i", "j").distinct().count()) or own(members, threshold))
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == plain(docs)
    assert pairs[0] < 0.7 * (14 * 15 / 2)


def test_hubs_of_components(spark):
    links = [(0, k) for k in range(1, 200)] + [(k, 500 + k) for k in range(50)] + [(900, 901)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), hub=20).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 252

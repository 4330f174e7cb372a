import numpy as np
import pytest
from pyspark.sql import functions as F

from protloom.functions.hashing import unsigned_text
from protloom.operators import kmers as km
from protloom.operators import search as se
from protloom.operators import signature_ops as so
from protloom.operators import stitch as stc

PLANT, LIVING = "PLANTANDANIMALGENQMES", "LIVINGALIVE"


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("plant", PLANT), ("living", LIVING), ("short", "AC"), ("none", None), ("empty", "")], "name string, sequence string")


@pytest.mark.parametrize(("moltype", "n_plant", "combined", "digests"), [
    ("protein", 17, 24, {"plant": "7641839ad508ab8", "living": "f7661cd829e75c0d"}),
    ("dayhoff", 17, 24, {"plant": "84d7545d531dcf51", "living": "a963d06839b6d6a9"}),
    ("hp", 14, 16, {"plant": "668d7173d661287b", "living": "24ca8d939672666b"}),
])
def test_sketch_goldens(spark, two, moltype, n_plant, combined, digests):
    sketch = km.sketches(two, 5, moltype)
    rows = {r["name"]: r for r in km.signature_names(sketch).collect()}
    assert {k: r["pseudo_md5"] for k, r in rows.items()} == digests
    assert rows["plant"]["n_hashes"] == n_plant and rows["plant"]["occurrences"] == 17
    assert km.combined_sketch(sketch).count() == combined


def test_positions(spark, two):
    rows = km.kmer_positions(two, 5, "hp").collect()
    assert sorted((r["start"], r["kmer"]) for r in rows if r["name"] == "plant") == [(i, PLANT[i : i + 5]) for i in range(17)]
    assert {r["name"] for r in rows} == {"plant", "living"}
    assert km.kmer_positions(two, 0, "hp").count() == 0
    nested = km.nested_infos(two, 5, "hp").where("name = 'plant'").collect()
    assert len(nested) == 14 and sum(len(r["originals"]) == 2 for r in nested) == 3


def test_standard_residues(spark):
    one = spark.createDataFrame([("all", "ACDEFGHIKLMNPQRSTVWY")], "name string, sequence string")
    row = km.signature_names(km.sketches(one, 5)).first()
    assert (row["n_hashes"], row["pseudo_md5"]) == (16, "b95f0777d5439d56")


def test_sampling_keeps_small_hashes(spark, two):
    full = {(r["name"], r["h"]) for r in km.sketches(two, 5).select("name", unsigned_text(F.col("hashval")).alias("h")).collect()}
    kept = {(r["name"], r["h"]) for r in km.sketches(two, 5, scaled=3).select("name", unsigned_text(F.col("hashval")).alias("h")).collect()}
    assert kept == {x for x in full if int(x[1]) <= int(float(2**64 - 1) / 3)}


def test_many_batches_keep_sequences_apart(spark, monkeypatch):
    rows = [(str(k), PLANT[k % 7 :]) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, sequence string")
    got = {(r["name"], r["start"], r["kmer"]) for r in km.kmer_positions(df, 6).collect()}
    assert got == {(n, i, s[i : i + 6]) for n, s in rows for i in range(len(s) - 5)}


def test_analytics(spark):
    df = spark.createDataFrame([("a", "AAAAAACAAAAA"), ("b", "")], "name string, sequence string")
    kmers = km.kmer_positions(df, 5, "hp")
    counts = {r["n"] for r in so.multi_position_kmers(kmers).collect()}
    assert counts == {3}
    assert km.original_counts(df, 5, "hp").agg(F.max("n_originals"), F.sum("occurrences")).first() == (1, 8)
    assert [r["n"] for r in so.total_occurrences(kmers).collect()] == [8]
    assert so.kmers_at(kmers, 0).count() == 1 and so.kmers_at(kmers, 99).count() == 0
    assert so.overlapping_kmers(kmers).count() == 0
    assert {(r["n"], r["n_hashes"]) for r in so.kmers_by_count(kmers).collect()} == {(3, 1), (1, 5)}
    nested = km.nested_infos(df, 5, "hp")
    assert nested.where(so.has_position(F.col("originals"), 7)).count() == 1
    assert nested.agg(F.sum(so.occurrences(F.col("originals")))).first()[0] == 8
    assert [r[0] for r in spark.createDataFrame([(0, 0), (8, 16)], "n int, l int").select(so.density(F.col("n"), F.col("l"))).collect()] == [0.0, 0.5]
    assert so.estimated_size(df, 5, "hp").first()["bytes"] == 1 + 6 * (16 + 12 + 5 + 16)
    two_sizes = kmers.unionByName(km.kmer_positions(df, 4, "hp"))
    assert so.overlapping_kmers(two_sizes).agg(F.sum("positions")).first()[0] == 8


def test_differing(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("aab", "abc"))
    assert sorted((r["x"], r["side"]) for r in so.differing(a, b).collect()) == [("a", "left"), ("c", "right")]


def test_signatures_equal_the_sketches(spark, two):
    sketch = km.sketches(two, 5, "hp", 2)
    want = {r["name"]: (r["n_hashes"], r["occurrences"], r["pseudo_md5"]) for r in km.signature_names(sketch).collect()}
    digests = {r["name"]: r["md5"] for r in km.sketch_digests(sketch, 5).collect()}
    rows = km.signatures(two, 5, "hp", 2).collect()
    assert {r["name"]: (r["n_hashes"], r["occurrences"], r["pseudo_md5"]) for r in rows if r["n_hashes"]} == want
    assert {r["name"]: r["md5"] for r in rows if r["n_hashes"]} == digests
    assert {r["pseudo_md5"] for r in rows if not r["n_hashes"]} == {"0"} and len(rows) == 5
    own = se.read_collection(two, 5, "hp", 2)
    assert sorted(map(str, se.manysearch(own, own, 5, 2, "hp").collect())) == sorted(map(str, se.manysearch(se.collection_of(sketch, 5), se.collection_of(sketch, 5), 5, 2, "hp").collect()))


def test_search_measures(spark, two):
    own = se.read_collection(two.where("length(sequence) > 2"), 5, "protein", 1)
    rows = {(r["query_name"], r["match_name"]): r for r in se.manysearch(own, own, 5, 1, "protein").collect()}
    assert set(rows) == {("plant", "plant"), ("living", "living")}
    r = rows["plant", "plant"]
    assert (r["containment"], r["jaccard"], r["intersect_hashes"], r["ksize"], r["std_abund"]) == (1.0, 1.0, 17, 15, 0.0)
    assert r["query_md5"] == r["match_md5"]
    many = se.multisearch(own, own, 5, 1, "protein").where("query_name = 'plant'").first()
    assert many["prob_overlap"] == pytest.approx(17 / 24**2) and many["prob_overlap_adjusted"] == pytest.approx(2 * 17 / 24**2)


def hits(spark, rows):
    return spark.createDataFrame([(1, 2, "q", "m", a, b, x, y, e) for a, b, x, y, e in rows], "query_id long, match_id long, query_name string, match_name string, start_query int, start_match int, kmer_query string, kmer_match string, encoded string")


def glue(kmers, places):
    out = ""
    for i, (kmer, at) in enumerate(zip(kmers, places, strict=True)):
        d = at - places[i - 1] if i else 0
        out += kmer if d == 0 else kmer[-d:] if d > 0 else kmer[-d:]
    return out


def test_stitch(spark):
    rows = [(0, 10, "ABCD", "abcd", "wxyz"), (1, 11, "BCDE", "bcde", "xyzw"), (9, 19, "MNOP", "mnop", "1234"), (9, 15, "MNOP", "qrst", "1234"), (12, 12, "UVWX", "uvwx", "5678")]
    row = stc.stitch(hits(spark, rows)).first()
    order = sorted(rows)
    assert row["query"] == glue([r[2] for r in order], [r[1] for r in order])
    assert row["match"] == glue([r[3] for r in order], [r[1] for r in order])
    assert row["encoded"] == glue([r[4] for r in order], [r[0] for r in order])
    assert (row["query_start"], row["match_start"], row["length"]) == (0, 10, len(row["query"]))
    text = stc.shown(stc.stitch(hits(spark, rows[:2]))).first()["to_print"]
    assert text == "\n---\nQuery Name: q\nMatch Name: m\nquery: ABCDE (0-5)\nalpha: wxyzw\nmatch: abcde (10-15)"
    apart = stc.stitch(hits(spark, rows[:4]), "diagonal", 4).orderBy("query_start", "match_start").collect()
    assert [(r["query_start"], r["match_start"], r["query"]) for r in apart] == [(0, 10, "ABCDE"), (9, 15, "MNOP"), (9, 19, "MNOP")]
    with pytest.raises(ValueError, match="mode"):
        stc.stitch(hits(spark, rows), "diagonal")


def test_records_of_one_name_stay_apart(spark):
    rows = spark.createDataFrame([(1, "same", PLANT), (2, "same", PLANT + LIVING), (3, "other", LIVING)], "id long, name string, sequence string")
    own = se.read_collection(rows, 5, "protein", 1)
    found = {(r["query_id"], r["match_id"]): (r["intersect_hashes"], r["containment"]) for r in se.manysearch(own, own, 5, 1, "protein", ids=True).collect()}
    assert found == {(1, 1): (17, 1.0), (1, 2): (17, 1.0), (2, 1): (17, 17 / 28), (2, 2): (28, 1.0), (2, 3): (7, 7 / 28), (3, 2): (7, 1.0), (3, 3): (7, 1.0)}
    kmers = km.kmer_positions(rows, 5)
    stitched = stc.stitch(se.search_hits(spark.createDataFrame([(1, 2), (1, 1)], "query_id long, match_id long"), se.kmer_hits(kmers, kmers))).collect()
    assert [r["query"] for r in stitched] == [PLANT, PLANT]


def test_a_filter_keeps_the_measures(spark, two):
    queries = se.read_collection(two.where("name = 'living'"), 5, "protein", 1)
    kept, all_ = se.read_collection(two, 5, "protein", 1, only=queries.known()), se.read_collection(two, 5, "protein", 1)
    assert kept.hashes.count() == 7 < all_.hashes.count() and sorted(kept.records.collect(), key=str) == sorted(all_.records.collect(), key=str)
    for search in (se.manysearch, se.multisearch):
        assert search(queries, kept, 5, 1, "protein").collect() == search(queries, all_, 5, 1, "protein").collect() != []
    only = km.kmer_positions(two, 5, only=queries.known())
    assert {r["name"] for r in only.collect()} == {"living"} and only.count() == 7


def test_targets_are_read_once(spark, two, monkeypatch):
    queries = se.read_collection(two, 5, "protein", 1)
    targets = se.read_collection(two, 5, "protein", 1, only=queries.known())
    plan = se.multisearch(queries, targets, 5, 1, "protein")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_long_sequences_are_worked_off_in_parts(spark, monkeypatch):
    long_ = "".join("ACDEFGHIKLMNPQRSTVWY"[(k * k + k // 7) % 20] for k in range(3000))
    rows = spark.createDataFrame([("a", long_), ("b", LIVING), ("c", long_[:100]), ("d", long_[1:])], "name string, sequence string")
    want = [sorted(map(tuple, f(rows, 7, "hp").collect())) for f in (km.kmer_positions, km.sketches, km.signatures)]
    real = km._steps

    def small(batch, ksize):  # as if a step were 64 residues
        old, km._STEP = km._STEP, 64
        try:
            yield from real(batch, ksize)
        finally:
            km._STEP = old

    monkeypatch.setattr(km, "_steps", small)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "name": list("abcd"), "sequence": [long_, LIVING, long_[:100], long_[1:]]})
    limit = 2**64 - 1
    sizes = {}
    for part, owner, hashed, abund, _ in km._counted(batch, 7, km._lookup("hp"), limit):
        for k, row in enumerate(part):
            sizes[row] = (int((owner == k).sum()), int(abund[owner == k].sum()))
    assert [sizes[k] for k in range(4)] == [(r[2], r[3]) for r in sorted(want[2], key=lambda r: r[1])]
    starts = []
    for part, own, offset, _ in km._steps(batch, 7):
        w = km._windows(own, 7, None, km._kept(limit, None))
        starts += [(part[o], int(s) + offset) for o, s in zip(w.owner.tolist(), w.start.tolist(), strict=True)]
    assert sorted(starts) == sorted((k, i) for k, n in enumerate((3000, 11, 100, 2999)) for i in range(n - 6))


@pytest.mark.parametrize("ksize", [5, 8, 12])
@pytest.mark.parametrize("step", [1 << 18, 40])
def test_grouping_inside_records(spark, ksize, step):
    """Originals, positions and counts equal those of single k-mers, also in slices of long records; nothing is dealt out."""
    long_ = "".join("ACDEFGHIKLMNPQRSTVWY"[(k * k + k // 7) % 20] for k in range(700)) + "AVAVAVAVAVAVAVAV" * 5
    rows = spark.createDataFrame([(1, "a", long_), (2, "a", LIVING * 2), (3, "c", long_[3:60]), (4, "d", ""), (5, "e", None), (6, "f", "ACD")], "id long, name string, sequence string")
    for scaled in (1, 3):
        kmers = km.kmer_positions(rows, ksize, "hp", scaled)
        infos = kmers.groupBy("id", "name", "hashval", "encoded", "kmer").agg(F.array_sort(F.collect_list("start")).alias("positions"))
        counts = kmers.groupBy("id", "name", "hashval", "encoded").agg(F.countDistinct("kmer").alias("n"), F.count("*").alias("k"))
        got = {f: f(rows, ksize, "hp", scaled, step=step) for f in (km.kmer_infos, km.original_counts, km.nested_infos)}
        assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in got.values())
        want = sorted(map(str, infos.collect()))
        assert sorted(map(str, got[km.kmer_infos].collect())) == want and len(want) > 50
        assert sorted(map(tuple, got[km.original_counts].collect())) == sorted(map(tuple, counts.collect()))
        nested = got[km.nested_infos].select("id", "name", "hashval", "encoded", F.explode("originals").alias("kmer", "positions"))
        assert sorted(map(str, nested.collect())) == want


def test_windows_of_one_hash_stand_together():
    rng = np.random.default_rng(2)
    rows, raw = np.sort(rng.integers(0, 5, 400)), rng.integers(65, 67, (400, 8), dtype=np.uint8)
    plain = rng.integers(0, 9, 400).astype(np.uint64)
    for hashed in (plain, plain << np.uint64(40)):  # equal upper halves, and others
        hashed = hashed[raw[:, 0].astype(int) * 2 + raw[:, 1] - 195]
        order = km._together(rows, hashed, raw)
        told = [(r, h, bytes(x), i) for r, h, x, i in zip(rows[order].tolist(), hashed[order].tolist(), raw[order], order.tolist(), strict=True)]
        for n in (1, 2, 3):
            assert sum(a[:n] != b[:n] for a, b in zip(told, told[1:], strict=False)) + 1 == len({x[:n] for x in told})
        assert all(a[3] < b[3] for a, b in zip(told, told[1:], strict=False) if a[:3] == b[:3])


def test_hashes_added_up_in_tasks(spark, two):
    rows = two.unionByName(two).unionByName(two.where("name = 'living'")).selectExpr("monotonically_increasing_id() AS id", "name", "sequence")
    want = sorted(map(tuple, km.combined_sketch(km.sketches(rows, 5, "hp", 2)).collect()))
    for held in (1 << 21, 4):
        assert sorted(map(tuple, km.combined_of(rows, 5, "hp", 2, held=held).collect())) == want != []


def test_heavy_hashes_are_dealt_apart(spark):
    """A k-mer in all targets, on both sides: equal rows, and no task has over three times the median."""
    rows = spark.range(6000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("ACDEF").alias("kmer"), F.lit("ACDEF").alias("encoded"), (F.col("id") % 7).cast("int").alias("start"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("hashval"))
    rows = se.saved(rows, "test-heavy")[0]
    queries = rows.where("id % 50 = 1 or id % 9 = 0")
    want = se.kmer_hits(queries, rows)
    got = se.kmer_hits(queries, rows, broadcast_rows=0, heavy=20)
    total = F.sum(F.xxhash64("query_id", "match_id", "start_query", "start_match", "hashval").cast("decimal(38,0)"))
    assert got.agg(F.count("*"), total).first() == want.agg(F.count("*"), total).first() != (0, None)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        sizes = sorted(r["count"] for r in se.kmer_hits(queries, rows, broadcast_rows=0, heavy=20).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]


def test_few_and_many_queries_find_the_same(spark, two):
    own = se.read_collection(two, 5, "hp", 1)
    for search in (se.manysearch, se.multisearch):
        a, b = (sorted(map(str, search(own, own, 5, 1, "hp", **limits).collect())) for limits in ({}, {"broadcast_rows": 0, "heavy": 2}))
        assert a == b != []


@pytest.mark.parametrize("limit", [200_000, 40])
def test_stitching_across_ranges(spark, limit):
    """One pair with most hits, over several ranges and fragments, beside small ones."""
    import random

    rng = random.Random(4)
    rows = [(1, 1, "q1", "m1", a := rng.randrange(3000), a + rng.choice([0, 0, 7, -3])) for _ in range(4000)] + [(q, m, f"q{q}", f"m{m}", a, a + 2) for q in (2, 3) for m in (5, 6) for a in range(0, 60, 3)]
    rows = [(q, m, qn, mn, a, b, f"Q{a:04}Q", f"M{b:04}M", f"E{a:04}E") for q, m, qn, mn, a, b in rows if b >= 0]
    df = spark.createDataFrame(rows, "query_id long, match_id long, query_name string, match_name string, start_query int, start_match int, kmer_query string, kmer_match string, encoded string").repartition(6)
    want, islands = [], []
    for q, m in {r[:2] for r in rows}:
        own = sorted((r[4:] for r in rows if r[:2] == (q, m)), key=lambda r: r[:2])
        a, b = [r[0] for r in own], [r[1] for r in own]
        want.append((f"m{m}", f"q{q}", min(a), min(b), glue([r[2] for r in own], b), glue([r[3] for r in own], b), glue([r[4] for r in own], a)))
        for off in {r[1] - r[0] for r in own}:
            line = [r for r in own if r[1] - r[0] == off]
            cuts = [0, *(i for i in range(1, len(line)) if line[i][0] - line[i - 1][0] > 6), len(line)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = line[s:e]
                x, y = [r[0] for r in part], [r[1] for r in part]
                islands.append((f"m{m}", f"q{q}", x[0], y[0], glue([r[2] for r in part], y), glue([r[3] for r in part], y), glue([r[4] for r in part], x)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for mode, known in (("compat", want), ("diagonal", islands)):
            got = stc.stitch(df, mode, 6, limit=limit).collect()
            assert sorted((r["match_name"], r["query_name"], r["query_start"], r["match_start"], r["query"], r["match"], r["encoded"]) for r in got) == sorted(known), mode
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_alphabet_of_ones_own(spark):
    from protloom.functions import alphabet

    alphabet.register("charge", {"+": "KRH", "-": "DE", "0": "ACFGILMNPQSTVWY"})
    one = spark.createDataFrame([("x", "ACDKRE")], "name string, sequence string")
    assert [r["encoded"] for r in km.kmer_positions(one, 6, "charge").collect()] == ["00-++-"]
    assert one.select(alphabet.encode(F.col("sequence"), "charge")).first()[0] == "00-++-"
    for groups in ({"+": "KK"}, {"ab": "C"}, {}):
        with pytest.raises(ValueError, match="symbols|built in"):
            alphabet.register("bad", groups)
    with pytest.raises(ValueError, match="built in"):
        alphabet.register("hp", {"h": "A"})


def test_windows_after_an_empty_record(spark):
    """An empty record, first or between others, takes no window of the record behind it."""
    made = spark.createDataFrame([("a", ""), ("b", "ACDEFG"), ("c", None), ("d", ""), ("e", "ACD"), ("f", "AC"), ("g", "")], "name string, sequence string").coalesce(1)
    found = sorted((r["name"], r["start"], r["kmer"]) for r in km.kmer_positions(made, 3).collect())
    assert found == [("b", i, "ACDEFG"[i : i + 3]) for i in range(4)] + [("e", 0, "ACD")]
    assert {r["name"]: r["n_hashes"] for r in km.signatures(made, 3).collect()} == {"a": 0, "b": 4, "c": 0, "d": 0, "e": 1, "f": 0, "g": 0}

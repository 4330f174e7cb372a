import bz2
import gzip
import io
import lzma
import os
import random
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from protloom import cli
from protloom.config import IndexConfig, MemoryConfig, PerformanceConfig
from protloom.errors import BuilderError, ConfigurationError, FastaParsing, InvalidKsize, IoError, InvalidMoltype, NoSavedState, ValidationError, with_context, with_field_context
from protloom.index import ProteinIndex, SequenceSet, sketch_list, sketch_manifest
from protloom.operators import kmers as km
from protloom.operators import search as se
from protloom.metrics import IndexMetrics, MetricsCollector, timed
from protloom.record import StoredSignature
from protloom.sources import fasta as fa
from protloom.sources import frames
from protloom.streaming.fasta_stream import start_sketching, streamed_combined

FASTA = ">plant one, two\nPLANTANDAN\nIMALGENQMES\n>living\r\nlivingalive\n"
WANT = [("living", "LIVINGALIVE"), ("plant one, two", "PLANTANDANIMALGENQMES")]
PACK = {"fasta": lambda b: b, "fasta.gz": gzip.compress, "fasta.bz2": bz2.compress, "fasta.xz": lzma.compress, "fasta.zst": zstandard.ZstdCompressor().compress}


def time_of(folder):
    return max(os.stat(f"{folder}/{x}").st_mtime_ns for x in os.listdir(folder) if x.startswith("part"))


def upper(df):
    return sorted((r["name"], r["sequence"].upper()) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    out = tmp_path / "a.fasta"
    out.write_text(FASTA)
    return str(out)


@pytest.mark.parametrize("suffix", PACK)
def test_codecs(spark, tmp_path, suffix):
    out = tmp_path / f"a.{suffix}"
    data = PACK[suffix](FASTA.encode())
    out.write_bytes(data)
    assert upper(fa.read_fasta(spark, str(out))) == WANT
    assert upper(fa.read_stdin(spark, io.BufferedReader(io.BytesIO(data)))) == WANT
    assert fa.sniff(data) == {"fasta": "plain", "fasta.gz": "gzip", "fasta.bz2": "bzip2", "fasta.xz": "xz", "fasta.zst": "zstd"}[suffix]


@pytest.mark.parametrize("codec", ["gzip", "bz2", "xz", "zst"])
def test_bytes_tell_the_codec(spark, tmp_path, codec):
    """Compressed files without their ending, and plain ones with a wrong one, beside each other."""
    data = {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.ZstdCompressor().compress}[codec](FASTA.encode())
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.fasta").write_bytes(data)
    assert upper(fa.read_fasta(spark, str(tmp_path / "d" / "a.fasta"))) == WANT
    (tmp_path / "d" / "b.fasta").write_text(">more\nACDEFG\n")
    (tmp_path / "d" / "c.fasta.gz").write_text(">last\nACDEFG\n")
    want = sorted([*WANT, ("more", "ACDEFG"), ("last", "ACDEFG")])
    assert upper(fa.read_fasta(spark, str(tmp_path / "d"))) == upper(fa.read_fasta(spark, str(tmp_path / "d" / "*.fa*"))) == want


def blocked(data, n):
    """Blocked gzip, of ``n`` bytes a block."""
    out = b""
    for at in range(0, len(data), n):
        c, own = zlib.compressobj(6, zlib.DEFLATED, -15), data[at : at + n]
        body = c.compress(own) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(own), len(own))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_of_compressed_files(tmp_path, end):
    """Whatever the frames and ranges, each record is read once."""
    rng, path = random.Random(2), str(tmp_path / "x")
    for trial in range(12):
        want = [(f"r{i} x", "".join(rng.choices("ACDEFGH", k=rng.randrange(60)))) for i in range(rng.randrange(30))]
        data = "".join(f">{n}{end}" + "".join(s[i : i + 13] + end for i in range(0, len(s), 13)) for n, s in want).encode()
        data, step = data.rstrip() if trial % 3 else data, (1, 3, 50, 400)[trial % 4]
        zstd = b"".join(zstandard.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i % 3 == 0).compress(data[i : i + step]) for i in range(0, len(data), step))
        skipped = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"hello"
        for codec, packed in (("zstd", zstd + skipped), ("gzip", blocked(data, step)), ("gzip", gzip.compress(data)), ("bzip2", bz2.compress(data)), ("xz", lzma.compress(data))):
            with open(path, "wb") as f:
                f.write(packed)
            for split in (1, 40, 1 << 30):
                ranges = frames.splits(path, codec, split)
                assert [r for a, z in ranges for r in frames.range_records(path, codec, a, z)] == want
                assert len(ranges) == 1 or split < len(packed)


def test_a_file_of_many_frames_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    want = [(f"r{i}", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randrange(10, 3000)))) for i in range(400)]
    data = "".join(f">{n}\n{s}\n" for n, s in want).encode()
    (tmp_path / "a.fasta.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(data[i : i + 10_000]) for i in range(0, len(data), 10_000)))
    (tmp_path / "b.fasta.gz").write_bytes(blocked(data, 10_000))
    for name in ("a.fasta.zst", "b.fasta.gz"):
        rows = fa.read_fasta(spark, str(tmp_path / name), split=50_000)
        parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 5 and max(parts) < 200
        assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert fa.read_fasta(spark, str(tmp_path)).count() == 800


def test_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "can_open", lambda path: False)
    for name, data in (("a.fasta.zst", zstandard.ZstdCompressor().compress(FASTA.encode())), ("b.fasta.gz", blocked(FASTA.encode(), 9)), ("c.fasta.xz", lzma.compress(FASTA.encode()))):
        (tmp_path / name).write_bytes(data)
        assert upper(fa.read_fasta(spark, str(tmp_path / name))) == WANT


def test_what_is_no_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("no header\nACDE\n")
    with pytest.raises(FastaParsing, match="does not begin with '>'"):
        fa.read_fasta(spark, str(tmp_path / "x.fasta"))
    with pytest.raises(IoError, match="IO error: there is no"):
        fa.read_fasta(spark, str(tmp_path / "missing.fasta"))


def test_empty_file_and_write(spark, tmp_path, path):
    (tmp_path / "e.fasta").write_text("")
    assert fa.read_fasta(spark, str(tmp_path / "e.fasta")).collect() == []
    fa.write_fasta(fa.read_fasta(spark, path), str(tmp_path / "out"))
    assert upper(fa.read_fasta(spark, str(tmp_path / "out"))) == WANT


def test_round_trip(spark, tmp_path, path):
    own = ProteinIndex.with_auto_filename(spark, path, 5, 1, "hp", True)
    assert own.path.endswith("a.fasta.hp.k5.scaled1.protloom")
    own.process_fasta(path)
    again = ProteinIndex.load(spark, own.path)
    assert again.stats() == {"signatures": 2, "combined_hashes": 16, "moltype": "hp", "ksize": 5, "scaled": 1, "store_raw_sequences": True}
    assert {r["name"]: r["pseudo_md5"] for r in again.signatures().collect()} == {"plant one, two": "668d7173d661287b", "living": "24ca8d939672666b"}
    assert upper(again.sequences()) == WANT
    again.compact(8)
    assert spark.read.parquet(f"{own.path}/postings").count() == own.sketch().count() == own.postings().count()
    other = ProteinIndex.builder().path(str(tmp_path / "b")).ksize(5).scaled(1).moltype("hp").build(spark)
    other.process_fasta(path)
    assert own.is_equivalent_to(other)
    assert [r["sequence"] for r in other.sequences().collect()] == [None, None]
    other.store(spark.createDataFrame([("living", "LIVINGALIVE"), ("x", "AC")], "name string, sequence string"))
    assert other.signature_count() == 4 and not own.is_equivalent_to(other)
    assert other.combined().agg(F.sum("abund")).first()[0] == 17 + 7 + 7
    assert {r["pseudo_md5"] for r in other.signatures().where("name = 'x'").collect()} == {"0"}


def test_an_invalid_record_stores_nothing(spark, tmp_path):
    own = ProteinIndex(spark, str(tmp_path / "i"), 5)
    with pytest.raises(Exception, match="Invalid amino acid '1' found at position 4"):
        own.store(spark.createDataFrame([("ok", "ACDEFGH"), ("bad", "ACD1")], "name string, sequence string"))
    with pytest.raises(NoSavedState):
        own.sketch()
    with pytest.raises(NoSavedState, match="No saved state found in database"):
        ProteinIndex.load(spark, str(tmp_path / "i"))


def test_an_interrupted_call_is_never_read(spark, tmp_path, path, monkeypatch):
    own = ProteinIndex(spark, str(tmp_path / "i"), 5, 1, "hp")
    own.process_fasta(path)
    publish = ProteinIndex._publish
    monkeypatch.setattr(ProteinIndex, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut short")))
    with pytest.raises(RuntimeError, match="cut short"):
        own.process_fasta(path)
    monkeypatch.setattr(ProteinIndex, "_publish", publish)
    again = ProteinIndex.load(spark, own.path)
    assert again.signature_count() == 2 and again.kmers().count() == 24 and again.sketch().count() == own.sketch().count()
    again.process_fasta(path)
    assert own.signature_count() == 4 and own.sequences().select("id").distinct().count() == 4
    assert own.metrics.get_metrics().signatures_processed == 2 and again.metrics.get_metrics().kmers_processed == 24


def test_search_of_a_stored_index(spark, tmp_path, path):
    own = ProteinIndex(spark, str(tmp_path / "i"), 5, 1, "protein")
    own.process_fasta(path)
    want = sorted(map(tuple, own.search(fa.read_fasta(spark, path).selectExpr("name", "upper(sequence) AS sequence")).collect()))
    assert len(want) == 2
    own.compact(5)
    queries = fa.read_fasta(spark, path).selectExpr("name", "upper(sequence) AS sequence")
    assert sorted(map(tuple, own.search(queries).collect())) == want
    own.store(spark.createDataFrame([("plant one, two", "PLANTANDANIMALGENQMES")], "name string, sequence string"))
    assert own.search(queries).count() == 3  # a later call of a name that was there
    own.compact()
    assert own.search(queries).count() == 3 and own.postings().count() == 41
    with pytest.raises(ConfigurationError, match="Scaled value must be greater than 0"):
        ProteinIndex(spark, "x", 5, 0)


def many(spark, n, first=0):
    return spark.createDataFrame([(f"r{i}", "".join(random.Random(i).choices("ACDEFGHIKLMNPQRSTVWY", k=40))) for i in range(first, first + n)], "name string, sequence string")


@pytest.mark.parametrize("scaled", [1, 5])
def test_a_search_reads_the_folders_of_its_hashes(spark, tmp_path, scaled):
    own = ProteinIndex(spark, str(tmp_path / "i"), 6, scaled, "protein")
    own.store(many(spark, 150))
    own.compact(bucket_rows=40)
    all_ = own.postings().inputFiles()
    assert len(all_) > 60 // scaled
    query = many(spark, 150).where("name = 'r17'")
    hashes = km.sketches(own.prepared(query), 6, "protein", scaled).select("hashval").limit(3)
    few = own.postings(hashes)
    assert 0 < len(few.inputFiles()) <= 3 + len(all_) // 20
    bytes_of = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    assert bytes_of(few.inputFiles()) < bytes_of(all_) / 4
    rows = lambda df: sorted(map(tuple, df.join(hashes, "hashval", "left_semi").collect()))
    assert rows(few) == rows(own.postings()) != []
    assert own.postings(hashes.where("false")).count() == 0
    # what is stored later comes along, and a further compaction merges both
    own.store(many(spark, 20, 150))
    everything = sorted(map(tuple, own.sketch().select("hashval", "id", "abund").collect()))
    for _ in range(2):
        assert sorted(map(tuple, own.postings().select("hashval", "id", "abund").collect())) == everything
        assert sorted(map(tuple, own.combined().collect())) == sorted(map(tuple, km.combined_sketch(own.sketch()).collect()))
        assert own.combined_size() == own.sketch().select("hashval").distinct().count()
        assert len(own._merged()[1]) == (0 if _ else 1)
        own.compact(bucket_rows=40)
    assert own.search(many(spark, 170)).count() >= 170
    told = own.frequencies().agg(F.sum("frequency"), F.max("df"), F.count("*")).first()
    assert told[0] == pytest.approx(1) and told[1] >= 1 and told[2] == own.combined_size()


def test_vacuum_and_pins(spark, tmp_path, monkeypatch):
    own = ProteinIndex(spark, str(tmp_path / "i"), 6)
    own.store(many(spark, 10))
    own.compact()
    monkeypatch.setattr(ProteinIndex, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut short")))
    with pytest.raises(RuntimeError, match="cut short"):
        own.store(many(spark, 5, 10))
    monkeypatch.undo()
    assert own.vacuum() == []  # the interrupted call might still be under way
    with own.pinned() as view:
        before = sorted(map(tuple, view.postings().collect()))
        own.store(many(spark, 5, 20))
        own.compact()
        gone = own.vacuum(older_than=-1)
        assert {x.split("/")[0] for x in gone} == {"sequences", "signatures", "combined"} and sum(x.startswith("sequences") for x in gone) == 1
        assert sorted(map(tuple, view.postings().collect())) == before and view.signature_count() == 10 and own.signature_count() == 15
        assert view.combined_size() < own.combined_size()
    gone = own.vacuum(older_than=-1)
    assert sorted(x.split("/")[0] for x in gone) == ["combined", "combined", "postings"]  # of the first compaction and its call; those of the second went before
    assert own.vacuum(older_than=-1) == [] and os.listdir(tmp_path / "i" / "pins") == [] and own.postings().count() == own.sketch().count()
    assert own.combined_size() == own.sketch().select("hashval").distinct().count()
    with own.pinned():
        own.compact()
        assert own.vacuum(older_than=-1) == [] and len(own.vacuum(older_than=-1, pins_for=-1)) == 2  # a pin that was left behind


def test_ids_are_of_their_own(spark, tmp_path):
    own = ProteinIndex(spark, str(tmp_path / "i"), 6)
    for _ in range(2):
        own.store(many(spark, 30).unionByName(many(spark, 30)).repartition(3))
    ids = [r["id"] for r in own.sequences().collect()]
    assert len(set(ids)) == 120 and {i >> 46 for i in ids} == {0, 1}
    assert (own.metrics.get_metrics().signatures_processed, own.metrics.get_metrics().kmers_processed) == (120, 120 * 35)


def test_equivalence_by_digests(spark, tmp_path):
    one, two, three = (ProteinIndex(spark, str(tmp_path / x), 6, 1, "hp") for x in "abc")
    one.store(many(spark, 30))
    two.store(many(spark, 15, 15).selectExpr("'x' AS name", "sequence"))
    two.store(many(spark, 15).repartition(4))
    assert one.is_equivalent_to(two) and one.differences(two).count() == 0
    assert "MapInArrow" not in one.unequal(two)._jdf.queryExecution().toString()  # no k-mer is made
    swapped = many(spark, 30).selectExpr("name", "CASE WHEN name = 'r3' THEN concat('V', substr(sequence, 2)) ELSE sequence END AS sequence")
    three.store(swapped)
    apart = one.unequal(three).collect()
    assert not one.is_equivalent_to(three) and sorted((r["n_left"], r["n_right"]) for r in apart) == [(0, 1), (1, 0)]
    assert {r["start"] for r in one.differences(three).collect()} == {0} and one.differences(three).count() == 2


def test_a_record_given_twice(spark, tmp_path):
    (tmp_path / "q.fasta").write_text(">q\nPLANTANDANIMALGENQMES\n")
    (tmp_path / "t.fasta").write_text(">t\nPLANTANDANIMAL\n>t\nPLANTANDANIMAL\n>u\nLIVINGALIVE\n")
    query, target = (SequenceSet(spark, str(tmp_path / f"{x}.fasta"), 5, 1, "protein", extract_kmers=True) for x in "qt")
    rows = se.manysearch(query.collection(), target.collection(), 5, 1, "protein", ids=True).collect()
    assert [(r["match_name"], r["intersect_hashes"], r["containment_target_in_query"]) for r in rows] == [("t", 10, 1.0)] * 2 and len({r["match_id"] for r in rows}) == 2
    assert {r["id"] for r in target.kmers().where("name = 't'").collect()} == {r["match_id"] for r in rows}
    hits = se.search_hits(se.manysearch(query.collection(), target.collection(), 5, 1, "protein", ids=True).select("query_id", "match_id"), se.kmer_hits(query.kmers(), target.kmers()))
    assert hits.count() == 20
    assert target.metrics.get_metrics().cache_misses == 3 and target.metrics.get_metrics().cache_hits > 5
    again = SequenceSet(spark, str(tmp_path / "t.fasta"), 5, 1, "protein")
    assert again.sketch().count() == 27 and again.metrics.get_metrics().cache_hit_ratio() == 1.0


@pytest.mark.parametrize("raw", [True, False])
def test_records_as_objects(spark, tmp_path, raw):
    own = ProteinIndex(spark, str(tmp_path / "i"), 5, 1, "hp", raw)
    own.store(spark.createDataFrame([("plant", "PLANTANDANIMALGENQMES"), ("short", "AC"), ("twice", "AVAVAVAVAV")], "name string, sequence string"))
    rows = {r["name"]: StoredSignature.from_row(r, 5, "hp") for r in own.records(own.sequences().where("name <> 'none'")).collect()}
    assert {n: r.kmer_count() for n, r in rows.items()} == {r["name"]: r["n_hashes"] for r in own.signatures().collect()}
    one = rows["twice"]
    sketch = sorted((r["hashval"] % 2**64, r["abund"]) for r in own.sketch().where("name = 'twice'").collect())
    assert list(zip(one.mins, one.abunds, strict=True)) == sketch and one.mins == sorted(one.mins)
    (info,) = one.kmer_infos.values()
    assert info == {"encoded_kmer": "hhhhh", "original_kmer_to_position": {"AVAVA": [0, 2, 4], "VAVAV": [1, 3, 5]}}
    assert one.estimated_size() == 5 + 8 + 8 + 12 + 5 + 32 + 10 * raw
    assert (one.protein_ksize, one.minhash_ksize, one.has_raw_sequence_storage(), one.get_raw_sequence()) == (5, 15, raw, "AVAVAVAVAV" if raw else None)
    assert rows["short"].mins == [] and not rows["short"].has_efficient_data() and one.has_efficient_data()
    one.set_raw_sequence("OTHER")
    assert one.get_raw_sequence() == ("OTHER" if raw else None)
    made = StoredSignature.from_existing_data("x", 5, "protein", [1, 2])
    made.set_raw_sequence("ACD")
    assert made.get_raw_sequence() is None and made.estimated_size() == 1 + 16


def test_builder_and_names(spark, tmp_path):
    b = ProteinIndex.builder()
    with pytest.raises(BuilderError, match="Builder error: Database path is required"):
        b.build(spark)
    with pytest.raises(BuilderError, match="Base path is required"):
        b.build_with_auto_filename(spark)
    with pytest.raises(BuilderError, match="K-mer size is required"):
        b.path("x").build(spark)
    with pytest.raises(BuilderError, match="Scaled value is required"):
        b.ksize(5).build(spark)
    with pytest.raises(BuilderError, match="Molecular type is required"):
        b.scaled(100).build(spark)
    assert b.moltype("raw").store_raw_sequences(True).build_with_auto_filename(spark).path == "x.raw.k5.scaled100.protloom"
    for k in (0, 101, 1000):
        with pytest.raises(InvalidKsize):
            ProteinIndex.builder().path("x").ksize(k).scaled(1).moltype("hp").build(spark)
    with pytest.raises(InvalidMoltype):
        ProteinIndex(spark, "x", 5, 1, "dna")
    with pytest.raises(ConfigurationError, match="does not exist"):
        ProteinIndex.from_config(spark, IndexConfig.checked(5, 2, "hp", tmp_path / "no" / "x"))
    own = ProteinIndex.from_config(spark, IndexConfig.checked(5, 2, "hp", tmp_path / "x", store_raw_sequences=True))
    assert (own.ksize, own.scaled, own.moltype, own.store_raw_sequences) == (5, 2, "hp", True)
    assert sketch_list("a.sketch") == "a.sketch"
    assert sketch_manifest(["a"], "a.fa") == "name,genome_filename,protein_filename\na,,a.fa\n"


def test_sequence_set_reuses_its_tables(spark, path):
    own = SequenceSet(spark, path, 5, 1, "protein", extract_kmers=True)
    assert own.kmers().count() == 24
    assert own.kmer_export().columns == ["sequence_file", "sequence_name", "kmer", "hashval", "encoded", "start"]
    with open(path, "a") as f:
        f.write(">more\nACDEFG\n")
    assert own.sketch().count() == own.kmers().count() == 26  # the file has changed
    made = time_of(f"{own.sketch_path}.kmers.pq")
    assert own.kmers().count() == 26 and time_of(f"{own.sketch_path}.kmers.pq") == made
    assert SequenceSet(spark, path, 5, 1, "protein", extract_kmers=True, force=True).kmers().count() == 26
    assert time_of(f"{own.sketch_path}.kmers.pq") > made
    os.remove(f"{own.sketch_path}.kmers.pq/_SUCCESS")  # as if the writing had been cut short
    made = time_of(f"{own.sketch_path}.kmers.pq")
    assert own.kmers().count() == 26 and time_of(f"{own.sketch_path}.kmers.pq") > made
    assert SequenceSet(spark, path, 5).kmers() is None
    assert upper(own.matched_sequences()) == sorted([*WANT, ("more", "ACDEFG")])


def test_commands(spark, path, tmp_path, capsys, monkeypatch):
    assert cli.main(["index", "-i", path, "-k", "5", "-e", "hp"]) == 0
    assert ProteinIndex.load(spark, f"{path}.hp.k5.scaled1.protloom").combined_size() == 16
    assert cli.main(["search", path, path, "--ksize", "5", "--scaled", "1", "--moltype", "protein"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("query_name,query_md5,match_name,containment") and len(out) == 3 and out[2].startswith('"plant one, two"')
    assert cli.main(["search", path, path, "--ksize", "5", "--scaled", "1", "--moltype", "protein", "--extract-kmers", "--output", str(tmp_path / "s"), "--search-csv", str(tmp_path / "m")]) == 0
    assert "query: LIVINGALIVE (0-11)" in capsys.readouterr().err
    assert fa.read_search_csv(spark, str(tmp_path / "m")).where("containment = 1").count() == 2
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    assert cli.main(["sketch", path, "--ksize", "5"]) == 0
    # a stored index as target; its settings hold
    index = str(tmp_path / "stored")
    assert cli.main(["index", "-i", path, "-o", index, "-k", "5", "-e", "protein"]) == 0
    capsys.readouterr()
    assert cli.main(["search", path, index]) == 0
    assert capsys.readouterr().out.splitlines() == out
    assert cli.main(["search", path, index, "--extract-kmers", "--output", str(tmp_path / "s2"), "--search-csv", str(tmp_path / "m2")]) == 0
    assert "query: LIVINGALIVE (0-11)" in capsys.readouterr().err
    # k-mers as CSV, and the records that have any
    assert cli.main(["kmers", path, "--ksize", "12", "--scaled", "1", "--moltype", "protein"]) == 0
    base = f"{path}.protein.k12.scaled1.sketch"
    assert fa.read_kmer_csv(spark, f"{base}.kmers.csv").count() == 10
    assert upper(fa.read_fasta(spark, f"{base}.fasta")) == WANT[1:]
    with pytest.raises(ValueError, match="max 100"):
        cli.main(["index", "-i", path, "-k", "1000"])


def test_config_and_errors(tmp_path):
    IndexConfig.checked(5, 5, "protein", tmp_path / "x").validate()
    for args, text in (((0, 1, "hp"), "greater than 0"), ((101, 1, "hp"), "max 100"), ((5, 11, "hp"), "at most 10"), ((5, 0, "hp"), "greater than 0"), ((5, 1, "dna"), "Must be one of")):
        with pytest.raises(ConfigurationError, match=text):
            IndexConfig.checked(*args, tmp_path / "x")
    with pytest.raises(ConfigurationError, match="Batch size must be greater than 0"):
        IndexConfig.checked(5, 1, "hp", tmp_path / "x", performance=PerformanceConfig(batch_size=0)).validate()
    with pytest.raises(ConfigurationError, match="Maximum memory"):
        IndexConfig.checked(5, 1, "hp", tmp_path / "x", memory=MemoryConfig(max_memory_mb=0)).validate()
    with pytest.raises(ConfigurationError, match="does not exist"):
        IndexConfig.checked(5, 1, "hp", tmp_path / "no" / "x").validate()
    own = IndexConfig.checked(5, 1, "hp", "x", performance=PerformanceConfig(num_threads=3), memory=MemoryConfig(max_memory_mb=9))
    assert own.effective_thread_count() == 3 and own.should_monitor_memory()
    assert str(with_context(ValidationError("a"), "b")) == "Validation error: b: a"
    assert str(with_field_context(NoSavedState(), "f", "m")) == "Configuration error: f - m: No saved state found in database"


def test_metrics():
    c = MetricsCollector()
    for name, n in (("signatures_processed", 1), ("kmers_processed", 100), ("cache_hits", 1), ("cache_misses", 1)):
        c.record(name, n)
    m = c.get_metrics()
    assert (m.kmers_processed, m.cache_hit_ratio()) == (100, 0.5) and m.kmers_per_second() > 0 and m.avg_time_per_signature >= 0
    assert IndexMetrics().kmers_per_second() == IndexMetrics().signatures_per_second() == IndexMetrics().cache_hit_ratio() == 0.0
    with timed("x", log=True) as took:
        pass
    assert took[0] >= 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(FASTA)
    out = str(tmp_path / "out")
    start_sketching(spark, str(tmp_path / "in"), out, 5, "hp", available_now=True).awaitTermination(60)
    (tmp_path / "in" / "b.fasta").write_text(FASTA)
    start_sketching(spark, str(tmp_path / "in"), out, 5, "hp", available_now=True).awaitTermination(60)
    rows = streamed_combined(spark, out)
    assert rows.count() == 16 and rows.agg(F.sum("abund")).first()[0] == 48

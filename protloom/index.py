"""An index of protein sequences: a folder of Parquet tables.

``sequences`` (ids, names, lengths and residues), ``signatures`` (measures and digests of each record) and ``combined`` (hashes with occurrences and number of
records). Sketches and positioned k-mers are views, made from the residues where they are read: stored, they would take ten to forty times the residues. (So residues are
kept in any case; ``store_raw_sequences`` says whether ``sequences`` shows them.) Every record has an id of its own and keeps its place, also when two have the same name or the
same hashes; the pseudo-digest is a column, not a key. A sequence with an invalid residue fails the call, and nothing of the call is stored.

Each call claims a number, writes into folders of its own, and is published last, by one row of ``metadata``: what an interrupted call
left is never read, and writers do not meet. A call adds up its own hashes only, so its cost follows what it adds.

``compact`` merges what it merged before with the calls since: the combined sketch, and ``postings``, the records of each hash, in folders by range of the hash (``bucket``), sorted by
hash and record. Ids of records count up inside a call, so a hash's records are stored as small steps. A search reads the folders that its hashes fall in, and sketches
the calls that came later. Nothing is collected but counts, folder numbers and the metadata rows.

``pinned`` gives a view of the index as it is now, whose tables ``vacuum`` leaves alone; ``vacuum`` deletes what no state needs any more.
"""

from __future__ import annotations

import copy
import json
import math
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .config import MAX_KSIZE, IndexConfig, kmer_size, molecule_type
from .errors import BuilderError, ConfigurationError, InvalidKsize, NoSavedState, SketchError
from .functions import alphabet, hashing
from .metrics import MetricsCollector, timed
from .operators import kmers as km
from .operators import postings as po
from .operators import search as se
from .operators.signature_ops import differing
from .scratch import forget, saved, scratch
from .sources.fasta import read_path_or_stdin, state_of

SUFFIX = "protloom"
#: ``kind`` is ``call`` or ``postings``, ``covers`` the calls in a table of postings, ``bits`` those of a hash that name its folder there.
METADATA = "kind string, name string, covers array<string>, bits int, moltype string, ksize int, scaled int, store_raw_sequences boolean, at timestamp"
POSTINGS = "id long, hashval long, abund long"
COMBINED = "hashval long, abund long, df long"
SEQUENCES = "id long, name string, length int, residues string"
#: Tables with a folder for each call, and those that a compaction writes too.
TABLES, MERGED = ("sequences", "signatures", "combined", "postings"), ("combined", "postings")
#: Postings in a folder, about; folders at most (two to the power).
BUCKET_ROWS, MAX_BITS = 4_000_000, 16
#: Postings that a compaction moves at once, about: some 5 bytes each.
STEP_ROWS = 1 << 31
#: Bits of an id: the call, the partition it was read in, and the row there.
_CALL, _ROW = 46, 28
#: How tables are stored, and postings: as steps from row to row.
_SMALL = {"compression": "zstd"}
_STEPS = {**_SMALL, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#hashval": "false", "parquet.enable.dictionary#id": "false"}
#: While tables are written, what a write shuffled goes when it ends; else it stays until the JVM of the driver collects.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A task writes a few folders as its rows come, without a sort by folder, as rows by hash are in that of their folders; and reads few blocks of postings at once.
_MERGING = {**_WRITING, "spark.sql.maxConcurrentOutputFileWriters": 4, "spark.sql.execution.arrow.maxBytesPerBatch": 32 << 20}


def index_filename(base: str, moltype: str, ksize: int, scaled: int) -> str:
    return f"{base}.{moltype}.k{ksize}.scaled{scaled}.{SUFFIX}"


def sketch_filename(base: str, moltype: str, ksize: int, scaled: int) -> str:
    return f"{base}.{moltype}.k{ksize}.scaled{scaled}.sketch"


def kmers_filename(sketch: str) -> str:
    return f"{sketch}.kmers.pq"


def sketch_manifest(names: list[str], path: str) -> str:
    """The manifest of protein files, as CSV text."""
    return "name,genome_filename,protein_filename\n" + "".join(f"{n},,{path}\n" for n in names)


def sketch_list(path: str) -> str:
    """The list of sketch files, one of them, as text without a line end."""
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return fs.exists(target)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path, and the file system that it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, prefix: str) -> dict[str, float]:
    """What follows the prefix in the names inside a folder, with the times of last change in seconds."""
    target, fs = hadoop_path(spark, path)
    if not fs.exists(target):
        return {}
    return {n.removeprefix(prefix): s.getModificationTime() / 1000 for s in fs.listStatus(target) if (n := s.getPath().getName()).startswith(prefix)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of the session, until the block ends."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bucket_of(hashval: Column, bits: int) -> Column:
    """The highest bits of a hash."""
    return F.shiftrightunsigned(hashval, 64 - bits).cast("int") if bits else F.lit(0)


class ProteinIndex:
    """Sequences are added in calls; tables grow by appending."""

    def __init__(self, spark: SparkSession, path: str, ksize: int, scaled: int = 1, moltype: str = "protein", store_raw_sequences: bool = False, seed: int | None = None):
        alphabet.table_of(moltype)
        if not 1 <= ksize <= MAX_KSIZE:
            raise InvalidKsize(ksize)
        if scaled < 1:
            raise ConfigurationError("scaled", "Scaled value must be greater than 0")
        self.spark, self.path, self.metrics, self._pin = spark, str(path), MetricsCollector(), None
        self.ksize, self.scaled, self.moltype, self.store_raw_sequences, self.seed = ksize, scaled, moltype, store_raw_sequences, seed

    # ---- making ----

    @classmethod
    def builder(cls) -> IndexBuilder:
        return IndexBuilder()

    @classmethod
    def from_config(cls, spark: SparkSession, config: IndexConfig) -> ProteinIndex:
        """From checked settings; the folder that the index goes to must be there."""
        config.validate()
        return cls(spark, config.path, config.ksize, config.scaled, config.moltype, config.store_raw_sequences)

    @classmethod
    def with_auto_filename(cls, spark: SparkSession, base: str, ksize: int, scaled: int = 1, moltype: str = "protein", store_raw_sequences: bool = False) -> ProteinIndex:
        p = PurePosixPath(base)
        return cls(spark, str(p.parent / index_filename(p.name, moltype, ksize, scaled)), ksize, scaled, moltype, store_raw_sequences)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProteinIndex:
        """The stored index; its settings come from its metadata."""
        row = cls._published(spark, path)[0]
        return cls(spark, path, row["ksize"], row["scaled"], row["moltype"], row["store_raw_sequences"])

    @staticmethod
    def _published(spark: SparkSession, path: str) -> list:
        """The metadata rows, first calls first."""
        rows = sorted(spark.read.schema(METADATA).parquet(f"{path}/metadata").collect(), key=lambda r: (r["at"], r["name"])) if exists(spark, f"{path}/metadata") else []
        if not rows:
            raise NoSavedState()
        return rows

    def generate_filename(self, base: str) -> str:
        return index_filename(base, self.moltype, self.ksize, self.scaled)

    # ---- adding ----

    def prepared(self, sequences: DataFrame) -> DataFrame:
        """Checked, cut at the stop codon, resolved."""
        own = ["id"] if "id" in sequences.columns else []
        return sequences.select(*own, "name", alphabet.validate_and_resolve(F.col("sequence"), self.seed).alias("sequence"))

    def signatures_of(self, sequences: DataFrame) -> DataFrame:
        """``name, hashval, abund`` of sequences, not stored."""
        return km.sketches(self.prepared(sequences), self.ksize, self.moltype, self.scaled)

    def _claimed(self) -> int:
        """A number that no other call has: that of a file which only one writer can make."""
        n = len(folders(self.spark, f"{self.path}/claims", ""))
        while True:
            target, fs = hadoop_path(self.spark, f"{self.path}/claims/{n}")
            if fs.createNewFile(target):
                break
            n += 1
        if n >= 1 << 63 - _CALL:
            raise SketchError(f"more than {1 << 63 - _CALL} calls")
        return n

    @staticmethod
    def _id(call: int) -> Column:
        """Ids that count up inside a partition."""
        own, most = F.monotonically_increasing_id(), F.lit((1 << 33) - 1)
        part, row = F.shiftright(own, 33), own.bitwiseAND(most)
        small = (part < 1 << _CALL - _ROW) & (row < 1 << _ROW)
        return F.when(small, F.lit(call << _CALL) + F.shiftleft(part, _ROW) + row).otherwise(F.raise_error(F.lit(f"more than {1 << _ROW} records in a partition, or {1 << _CALL - _ROW} partitions: deal them out first")).cast("long"))

    def store(self, sequences: DataFrame) -> None:
        """Append ``name, sequence`` rows. They are checked as a whole before anything of them can be read.

        Records and occurrences are counted by the tasks that write the sketches.
        """
        call, number, seen = uuid.uuid4().hex, self._claimed(), Observation("stored")
        at = lambda table: f"{self.path}/{table}/call={call}"
        with timed("store") as took, settings(self.spark, _WRITING):
            rows = self.prepared(sequences).select(self._id(number).alias("id"), "name", F.length("sequence").alias("length"), F.col("sequence").alias("residues"))
            rows.write.options(**_SMALL).parquet(at("sequences"))
            own = self._residues([call])
            told = km.profiles(own, self.ksize, self.moltype, self.scaled, schema=km.CONTENTS).observe(seen, F.count("*").alias("records"), F.sum("occurrences").alias("kmers"))
            told.write.options(**_SMALL).parquet(at("signatures"))
            km.combined_of(own, self.ksize, self.moltype, self.scaled).write.options(**_SMALL).parquet(at("combined"))
            self._publish("call", call, [], 0)
        told = seen.get
        for name, n in (("signatures_processed", told["records"]), ("kmers_processed", told["kmers"] or 0), ("database_operations", 4)):
            self.metrics.record(name, n)
        log(f"stored {told['records']} sequences in {took[0]:.1f} s")

    def _residues(self, calls: list[str]) -> DataFrame:
        return self._read("sequences", SEQUENCES, calls).select("id", "name", F.col("residues").alias("sequence"))

    def _sketch(self, calls: list[str], only: DataFrame | None = None) -> DataFrame:
        return km.sketches(self._residues(calls), self.ksize, self.moltype, self.scaled, only=only)

    def process_fasta(self, path: str) -> None:
        """Append the records of a FASTA file, in upper case."""
        self.store(read_path_or_stdin(self.spark, path).select("name", F.upper("sequence").alias("sequence")))

    def _publish(self, kind: str, name: str, covers: list[str], bits: int) -> None:
        """One row, in a file of its own, that appears as a whole."""
        row = self.spark.createDataFrame([(kind, name, covers, bits, self.moltype, self.ksize, self.scaled, self.store_raw_sequences)], METADATA.removesuffix(", at timestamp"))
        row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/metadata")

    def compact(self, bucket_rows: int = BUCKET_ROWS) -> None:
        """Merge the last compaction and the calls since: postings in folders of about ``bucket_rows``, and the combined sketch."""
        calls, name = self._calls(), uuid.uuid4().hex
        last, since = self._merged()
        told = self.signatures().agg(F.sum("n_hashes").alias("n"), F.count("*").alias("records")).first()
        n = told["n"] or 0
        # sampled hashes lie in the lowest part of the range
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n * self.scaled / bucket_rows)))))
        # hashes are even over the ranges, of two folders each; that of a very common hash has a block of it for each few millions of postings
        ranges, split = max(0, bits - 1), max(1, -(-told["records"] // po.RECORDS))
        with settings(self.spark, _MERGING):
            # each step reads the residues again, which take less time and disk than the blocks of all hashes at once would take of disk
            for own in po.steps(n, self.scaled, ranges, STEP_ROWS):
                blocks = po.blocks_of(self._residues(since), self.ksize, self.moltype, self.scaled, ranges, split, part=_ROW, within=own)
                if last is not None:
                    blocks = blocks.unionByName(po.blocks_again(self._stored(last), ranges, split, within=own))
                po.merged(blocks, self.scaled, ranges, bits, split).write.mode("append").options(**_STEPS).partitionBy("bucket").parquet(f"{self.path}/postings/call={name}")
            self.combined().write.options(**_SMALL).parquet(f"{self.path}/combined/call={name}")
        self._publish("postings", name, calls, bits)

    # ---- states ----

    def _rows(self) -> list:
        """The metadata rows: of the view, or as they are now."""
        return self._pin if self._pin is not None else self._published(self.spark, self.path)

    @contextmanager
    def pinned(self) -> Iterator[ProteinIndex]:
        """A view of the index as it is now. Until the block ends, ``vacuum`` keeps its tables, whatever is added or compacted."""
        view, rows = copy.copy(self), self._published(self.spark, self.path)
        view._pin = rows
        pin = f"{self.path}/pins/{uuid.uuid4().hex}"
        target, fs = hadoop_path(self.spark, pin)
        out = fs.create(target)
        try:
            out.write(bytearray(json.dumps([r["name"] for r in rows]).encode()))
        finally:
            out.close()
        try:
            yield view
        finally:
            forget(self.spark, pin)

    def vacuum(self, older_than: float = 24 * 3600, pins_for: float = 7 * 24 * 3600) -> list[str]:
        """Delete folders of calls that were never published, and tables that a compaction has replaced, if they are ``older_than`` seconds old.

        What pins of the last ``pins_for`` seconds name stays; older pins are taken to be left by readers that died, and go. Returns the folders' names.
        """
        now = time.time()
        rows = self._published(self.spark, self.path)
        names, last = {r["name"] for r in rows}, next((r for r in reversed(rows) if r["kind"] == "postings"), None)
        replaced = {r["name"] for r in rows if r["kind"] == "postings"} - {last["name"]} | set(last["covers"]) if last and now - last["at"].timestamp() > older_than else set()
        held: set[str] = set()
        for pin, changed in folders(self.spark, f"{self.path}/pins", "").items():
            if now - changed > pins_for:
                forget(self.spark, f"{self.path}/pins/{pin}")
            else:
                held |= set(json.loads(self.spark.read.text(f"{self.path}/pins/{pin}").first()[0]))
        gone = []
        for table in TABLES:
            for name, changed in folders(self.spark, f"{self.path}/{table}", "call=").items():
                old = name in replaced and table in MERGED if name in names else now - changed > older_than
                if name not in held and old:
                    gone.append(f"{table}/call={name}")
        forget(self.spark, *(f"{self.path}/{x}" for x in gone))
        return gone

    # ---- reading ----

    def _calls(self) -> list[str]:
        return [r["name"] for r in self._rows() if r["kind"] == "call"]

    def _merged(self) -> tuple[object | None, list[str]]:
        """The last compaction, and the calls since."""
        last = next((r for r in reversed(self._rows()) if r["kind"] == "postings"), None)
        covered = set(last["covers"]) if last else set()
        return last, [c for c in self._calls() if c not in covered]

    def _read(self, name: str, schema: str, calls: list[str]) -> DataFrame:
        if not calls:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/call={c}" for c in calls))

    def postings(self, only: DataFrame | None = None) -> DataFrame:
        """``id, hashval, abund`` of all calls: the last compaction, and the sketches of calls since.

        With ``only``, a table of hashes, only the folders are read that these fall in, and of later calls only these hashes are kept.
        """
        last, since = self._merged()
        rest = self._sketch(since, only).select("id", "hashval", "abund")
        return rest if last is None else self._stored(last, only).unionByName(rest)

    def _stored(self, last: object, only: DataFrame | None = None) -> DataFrame:
        """``id, hashval, abund`` of a compaction."""
        path = f"{self.path}/postings/call={last['name']}"
        buckets = sorted(folders(self.spark, path, "bucket="))
        if only is not None:
            asked = {str(r[0]) for r in only.select(bucket_of(F.col("hashval"), last["bits"])).distinct().collect()}  # 2 ** MAX_BITS at most
            buckets = [b for b in buckets if b in asked]
        if not buckets:
            return self.spark.createDataFrame([], POSTINGS)
        return self.spark.read.schema(POSTINGS).parquet(*(f"{path}/bucket={b}" for b in buckets))

    def search(self, queries: DataFrame, ids: bool = False) -> DataFrame:
        """The measures of ``manysearch`` for ``name, sequence`` queries against what is stored, whose sequences are not read again; an ``id`` tells queries of one name apart."""
        own = se.read_collection(self.prepared(queries), self.ksize, self.moltype, self.scaled)
        return se.manysearch(own, se.Collection(self.signatures(), self.postings(own.known())), self.ksize, self.scaled, self.moltype, ids)

    def kmers(self) -> DataFrame:
        """``id, name, start, kmer, encoded, hashval``."""
        return km.kmer_positions(self._residues(self._calls()), self.ksize, self.moltype, self.scaled)

    def sketch(self) -> DataFrame:
        """``id, name, hashval, abund``."""
        return self._sketch(self._calls())

    def sequences(self) -> DataFrame:
        """``id, name, length, sequence``, the last only if raw sequences are stored."""
        raw = F.col("residues") if self.store_raw_sequences else F.lit(None).cast("string")
        return self._read("sequences", SEQUENCES, self._calls()).select("id", "name", "length", raw.alias("sequence"))

    def records(self, ids: DataFrame) -> DataFrame:
        """``id, name, mins, abunds, kmer_infos, raw_sequence`` of the records of some ids, each with its sketch as a whole; ``StoredSignature.from_row`` takes the rows."""
        chosen = self._read("sequences", SEQUENCES, self._calls()).join(ids.select("id"), "id", "left_semi").select("id", "name", F.col("residues").alias("sequence"))
        info = F.struct(F.lit(self.ksize).alias("ksize"), "hashval", F.col("encoded").alias("encoded_kmer"), F.col("originals").alias("original_kmer_to_position"))
        count = F.aggregate(F.map_values("originals"), F.lit(0).cast("long"), lambda n, x: n + F.size(x))
        rows = km.nested_infos(chosen, self.ksize, self.moltype, self.scaled).select("id", F.struct("hashval", count.alias("abund"), info.alias("info")).alias("x"))
        grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("x.hashval")).alias("mins"), F.map_from_entries(F.collect_list(F.struct("x.hashval", "x.abund"))).alias("abund"), F.map_from_entries(F.collect_list(F.struct("x.hashval", "x.info"))).alias("kmer_infos"))
        out = chosen.join(grouped, "id", "left")
        none = {"mins": "array<bigint>", "abunds": "array<bigint>"}
        told = {"mins": F.col("mins"), "abunds": F.transform("mins", lambda h: F.element_at("abund", h))}
        empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<struct<ksize:int,hashval:bigint,encoded_kmer:string,original_kmer_to_position:map<string,array<int>>>>"))
        raw = F.col("sequence") if self.store_raw_sequences else F.lit(None).cast("string")
        return out.select("id", "name", *(F.coalesce(told[c], F.array().cast(t)).alias(c) for c, t in none.items()), F.coalesce("kmer_infos", empty).alias("kmer_infos"), raw.alias("raw_sequence"))

    def signatures(self) -> DataFrame:
        """``id, name, n_hashes, occurrences, pseudo_md5, md5``; sequences without hashes have 0, 0 and ``0``."""
        return self._measures().drop("content")

    def _measures(self) -> DataFrame:
        return self._read("signatures", km.CONTENTS, self._calls())

    def combined(self) -> DataFrame:
        """``hashval, abund, df``: of the last compaction and the calls since, each of which is added up already."""
        last, since = self._merged()
        names = ([last["name"]] if last else []) + since
        rows = self._read("combined", COMBINED, names)
        return rows if len(names) < 2 else rows.groupBy("hashval").agg(F.sum("abund").alias("abund"), F.sum("df").alias("df"))

    def frequencies(self) -> DataFrame:
        """``hashval, df, frequency, idf`` over all records."""
        return km.frequencies(self.combined(), self.signature_count())

    def combined_size(self) -> int:
        return self.combined().count()

    def signature_count(self) -> int:
        return self.sequences().count()

    def stats(self) -> dict:
        return {"signatures": self.signature_count(), "combined_hashes": self.combined_size(), "moltype": self.moltype, "ksize": self.ksize, "scaled": self.scaled, "store_raw_sequences": self.store_raw_sequences}

    def is_equivalent_to(self, other: ProteinIndex) -> bool:
        """Equal settings, and equal k-mers, hashes and positions record by record, whatever the names and raw sequences.

        Told by the records' digests of 128 bits; no k-mer is read.
        """
        return self._settings() == other._settings() and not self.unequal(other).limit(1).count()

    def _settings(self) -> tuple:
        return self.ksize, self.scaled, self.moltype

    def unequal(self, other: ProteinIndex) -> DataFrame:
        """``content, pseudo_md5, n_left, n_right``: contents that one index has more often than the other, in numbers of records."""
        count = lambda own, name: own._measures().groupBy("content", "pseudo_md5").agg(F.count("*").alias(name))
        both = count(self, "n_left").join(count(other, "n_right"), ["content", "pseudo_md5"], "full")
        return both.na.fill(0, ["n_left", "n_right"]).where("n_left <> n_right")

    def differences(self, other: ProteinIndex) -> DataFrame:
        """k-mers that one index has more often than the other, of the records whose contents are unequal: ``side`` and ``pseudo_md5, start, kmer, encoded, hashval``."""
        apart, _ = saved(self.unequal(other).select("content", "pseudo_md5"), "unequal")

        def kmers(own: ProteinIndex) -> DataFrame:
            ids = own._measures().join(apart, ["content", "pseudo_md5"]).select("id", "pseudo_md5")
            rows = own._residues(own._calls()).join(ids.select("id"), "id", "left_semi")
            return km.kmer_positions(rows, own.ksize, own.moltype, own.scaled).join(ids, "id").select("pseudo_md5", "start", "kmer", "encoded", hashing.unsigned_text(F.col("hashval")).alias("hashval"))

        return differing(kmers(self), kmers(other))


@dataclass
class IndexBuilder:
    """Settings one by one; ``build`` tells which one is missing."""

    values: dict = None

    def _with(self, **kw: object) -> IndexBuilder:
        self.values = {**(self.values or {}), **kw}
        return self

    def path(self, value: str) -> IndexBuilder:
        return self._with(path=value)

    def ksize(self, value: int) -> IndexBuilder:
        return self._with(ksize=value)

    def scaled(self, value: int) -> IndexBuilder:
        return self._with(scaled=value)

    def moltype(self, value: str) -> IndexBuilder:
        return self._with(moltype=value)

    def store_raw_sequences(self, value: bool) -> IndexBuilder:
        return self._with(store_raw_sequences=value)

    def _checked(self, path_text: str) -> dict:
        own = self.values or {}
        for name, text in (("path", path_text), ("ksize", "K-mer size is required"), ("scaled", "Scaled value is required"), ("moltype", "Molecular type is required")):
            if name not in own:
                raise BuilderError(text)
        return own

    def build(self, spark: SparkSession) -> ProteinIndex:
        return ProteinIndex(spark, **self._checked("Database path is required"))

    def build_with_auto_filename(self, spark: SparkSession) -> ProteinIndex:
        own = dict(self._checked("Base path is required"))
        return ProteinIndex.with_auto_filename(spark, own.pop("path"), **own)


class SequenceSet:
    """A FASTA file with its derived tables, made when asked for and found again on disk unless ``force``.

    Records are read from the file once, into a table in which each has an id of its own, also one that the file holds twice; sketches and
    k-mers are made from that table. A table is used again only if it was written to its end, from the file as it is now. ``metrics`` counts
    tables that were found (cache hits) and made (misses). Standard input is read once, and its tables are not kept.
    """

    def __init__(self, spark: SparkSession, fasta: str, ksize: int, scaled: int = 5, moltype: str = "hp", extract_kmers: bool = False, force: bool = False):
        kmer_size(ksize)
        molecule_type(moltype)
        self.spark, self.fasta, self.ksize, self.scaled, self.moltype, self.extract_kmers, self.force = spark, str(fasta), ksize, scaled, moltype, extract_kmers, force
        self.base, self.metrics, self._made = scratch(spark, "stdin") if self.fasta == "-" else self.fasta, MetricsCollector(), set()

    def sequences(self) -> DataFrame:
        """``id, name, sequence``, checked and resolved."""
        return self._kept(self._records, "id long, name string, sequence string", self._read)[0]

    @property
    def _records(self) -> str:
        return f"{self.base}.records"

    def _read(self) -> DataFrame:
        rows = read_path_or_stdin(self.spark, self.fasta).select("name", alphabet.validate_and_resolve(F.upper("sequence")).alias("sequence"))
        return rows.select(F.monotonically_increasing_id().alias("id"), "name", "sequence")

    def _kept(self, path: str, schema: str, make: object) -> tuple[DataFrame, str]:
        """The table, and what it was made of: the file's state and, after a slash, the table of records."""
        derived = path != self._records
        source = self._kept(self._records, "id long, name string, sequence string", self._read)[1] if derived else state_of(self.spark, self.fasta)
        told = self.spark.read.parquet(f"{path}.source").first()["state"] if exists(self.spark, f"{path}.source/_SUCCESS") and exists(self.spark, f"{path}/_SUCCESS") else None
        fresh = told is not None and (told if derived else told.rpartition("/")[0]) == source and (path in self._made or not self.force)
        self.metrics.record("cache_hits" if fresh else "cache_misses")
        if not fresh:
            told = source if derived else f"{source}/{uuid.uuid4().hex}"
            forget(self.spark, f"{path}.source")
            make().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(told,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}.source")
            self._made.add(path)
        return self.spark.read.schema(schema).parquet(path), told

    @property
    def sketch_path(self) -> str:
        return sketch_filename(self.base, self.moltype, self.ksize, self.scaled)

    def profiles(self) -> DataFrame:
        return self._kept(self.sketch_path, km.PROFILES, lambda: km.profiles(self.sequences(), self.ksize, self.moltype, self.scaled))[0]

    def collection(self) -> se.Collection:
        rows = self.profiles()
        return se.Collection(rows.drop("hits", "pseudo_md5"), rows.select("id", F.explode("hits").alias("hit")).select("id", "hit.hashval", "hit.abund"))

    def sketch(self) -> DataFrame:
        """``id, name, hashval, abund``."""
        return self.profiles().select("id", "name", F.explode("hits").alias("hit")).select("id", "name", "hit.hashval", "hit.abund")

    def kmers(self) -> DataFrame | None:
        """The k-mer table, or None where extraction is off."""
        if not self.extract_kmers:
            return None
        return self._kept(kmers_filename(self.sketch_path), km.KMERS, lambda: km.kmer_positions(self.sequences(), self.ksize, self.moltype, self.scaled))[0]

    def kmer_export(self) -> DataFrame:
        """The k-mers as ``sequence_file, sequence_name, kmer, hashval, encoded, start``, hashes as unsigned decimals."""
        return self.kmers().select(F.lit(self.fasta).alias("sequence_file"), F.col("name").alias("sequence_name"), "kmer", hashing.unsigned(F.col("hashval")).alias("hashval"), "encoded", "start")

    def matched_sequences(self) -> DataFrame:
        """``name, sequence`` of the records that have a sampled k-mer."""
        return self.sequences().join(self.kmers().select("id").distinct(), "id", "left_semi").select("name", "sequence")


def log(text: str) -> None:
    print(text, file=sys.stderr)

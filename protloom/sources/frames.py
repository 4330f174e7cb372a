"""Compressed FASTA as a Spark data source, split where the format can be entered.

zstd files are split between frames, blocked gzip files (bgzip) between blocks; any other gzip, bzip2 or xz file is one partition, decoded in a stream. A
partition's records are those whose line break before ``>`` lies in it: the text before its first ones belongs to the partition before, which
reads on beyond its end to the next record. A task holds one record and a piece of the stream.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, sequence string"
#: Compressed bytes of a partition, at least.
SPLIT = 32 << 20
#: Decoded bytes that are looked at together, and residues of a batch.
_PIECE, _BATCH = 1 << 20, 1 << 20
#: First bytes of the formats.
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
_SKIPPED = range(0x184D2A50, 0x184D2A60)


def sniff(data: bytes) -> str:
    """The codec that the first bytes tell, or ``plain``."""
    return next((codec for magic, codec in MAGIC.items() if data.startswith(magic)), "plain")


def is_blocked(head: bytes) -> bool:
    """Whether a gzip file's first bytes tell the size of its first block."""
    return len(head) >= 18 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"BC\x02\x00"


def _file(path: str):  # noqa: ANN202
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    fs, name = (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def can_open(path: str) -> bool:
    """Whether tasks can open the file without Spark's readers."""
    try:
        _file(path).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def zstd_starts(f: object, size: int) -> Iterator[int]:
    """Where frames begin, from the sizes of their blocks."""
    import zstandard

    at = 0
    while at < size:
        yield at
        f.seek(at)
        head = f.read(18)
        if int.from_bytes(head[:4], "little") in _SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        told = zstandard.get_frame_parameters(head)
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            f.seek(at)
            block = int.from_bytes(f.read(3), "little")
            last, kind = block & 1, block >> 1 & 3
            at += 3 + (1 if kind == 1 else block >> 3)
        at += 4 * told.has_checksum


def block_starts(f: object, size: int) -> Iterator[int]:
    """Where blocks of a blocked gzip file begin."""
    at = 0
    while at < size:
        yield at
        f.seek(at)
        head = f.read(18)
        if not is_blocked(head):
            raise ValueError(f"no block at byte {at}")
        at += struct.unpack("<H", head[16:18])[0] + 1


def splits(path: str, codec: str, split: int = SPLIT) -> list[tuple[int, int]]:
    """Byte ranges that begin where the file can be entered; one if it cannot be entered elsewhere."""
    with _file(path) as f:
        size = f.size()
        if codec == "zstd":
            starts = zstd_starts(f, size)
        elif codec == "gzip" and is_blocked(f.read(18)):
            starts = block_starts(f, size)
        else:
            return [(0, size)]
        bounds = [0]
        for at in starts:
            if at - bounds[-1] >= split:
                bounds.append(at)
    return list(zip(bounds, [*bounds[1:], size], strict=True))


class _Range(io.RawIOBase):
    """A part of an open file."""

    def __init__(self, f: object, start: int, end: int):
        self.f, self.at, self.end = f, start, end

    def readable(self) -> bool:
        return True

    def readinto(self, into: bytearray) -> int:
        self.f.seek(self.at)
        data = self.f.read(min(len(into), self.end - self.at))
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def _blocks(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """Members of a gzip file, one after the other."""
    decoder = None
    while data := stream.read(_PIECE):
        while data:
            decoder = decoder or zlib.decompressobj(31)
            yield decoder.decompress(data)
            data = decoder.unused_data
            if decoder.eof:
                decoder = None


def decoded(f: object, codec: str, start: int, end: int) -> Iterator[bytes]:
    """Pieces of the text of a range."""
    stream = io.BufferedReader(_Range(f, start, end), _PIECE)
    if codec == "gzip":
        yield from _blocks(stream)
        return
    if codec == "zstd":
        import zstandard

        own = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    else:
        own = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open, "plain": lambda s: s}[codec](stream)
    while data := own.read(_PIECE):
        yield data


def records(own: Iterator[bytes], beyond: Iterator[bytes], first: bool) -> Iterator[bytes]:
    """The records, without their ``>``, whose line break before it lies in ``own``, or, with ``first``, that begin the text; ``beyond`` is what follows."""
    held = b"\n" if first else b""
    base, seen, scanned, started, ended = -len(held), 0, 0, False, False
    while True:
        at = held.find(b"\n>", scanned)
        if at >= 0:
            if ended and base + at >= seen:
                if started:
                    yield held[:at]
                return
            if started:
                yield held[:at]
            held, base, scanned, started = held[at + 2 :], base + at + 2, 0, True
            continue
        scanned = max(0, len(held) - 1)
        if not started and scanned:
            held, base, scanned = held[scanned:], base + scanned, 0
        piece = next(own, None) if not ended else None
        if piece is None:
            ended = True
            if not started and held[-1:] != b"\n":
                return
            piece = next(beyond, None)
            if piece is None:
                break
        else:
            seen += len(piece)
        held += piece
    if started:
        yield held


def parsed(record: bytes) -> tuple[str, str]:
    """Name, which is the whole header line, and residues."""
    name, _, body = record.partition(b"\n")
    return name.decode("utf-8", "replace").rstrip("\r"), b"".join(body.split()).decode("utf-8", "replace")


def range_records(path: str, codec: str, start: int, end: int) -> Iterator[tuple[str, str]]:
    with _file(path) as f, _file(path) as further:
        size = f.size()
        own, beyond = decoded(f, codec, start, end), decoded(further, codec, end, size) if end < size else iter(())
        for record in records(own, beyond, start == 0):
            yield parsed(record)


class _Part(InputPartition):
    def __init__(self, path: str, codec: str, start: int, end: int):
        super().__init__((path, codec, start, end))


class _Reader(DataSourceReader):
    def __init__(self, files: list, split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[InputPartition]:
        return [_Part(path, codec, a, z) for path, codec in self.files for a, z in splits(path, codec, self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        size = 0
        for record in range_records(*partition.value):
            held.append(record)
            size += len(record[1])
            if len(held) == 1000 or size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["name", "sequence"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["name", "sequence"])


class CompressedFasta(DataSource):
    """``spark.read.format("protloom_fasta")``; option ``files`` is JSON of paths and codecs, ``split`` the least bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "protloom_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("split", SPLIT)))

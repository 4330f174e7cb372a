"""Matroska files in columns: an exact muxer for 8-bit samples and a parser to packet tables.

``mux`` writes EBML header, segment, seek head, info, tracks, clusters of (laced)
simple blocks and block groups, and cues. ``parse`` reads any such file: element ids and sizes of
variable length (unknown sizes included), clusters, simple blocks and block groups,
Xiph, EBML and fixed-size lacing, and cues; it gives one packet for each frame, with track,
timestamp and byte range in the file. Elements it does not know are passed over.

Defined results: a null or empty text is stored as 64 zero bytes; texts of any length are stored whole; equal texts give equal files and features, and
repeated rows are stored each; there are no ties; rows without an id keep a null id; a null file has no packets, no cues and no features, but keeps its row in ``media_features``; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import raw, steps
from ._store import table

# Element ids of the container format (fixed values of its specification).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples a second; at 8 a millisecond every frame starts on a whole tick.
RATE = 8000
FRAME = 256
BLOCK_FRAMES = 16
CLUSTER_SAMPLES = 32_768
UNIT = 64


class Malformed(ValueError):
    """The bytes are no well-formed file."""


def number(value: int, width: int = 0) -> bytes:
    """A size as a variable-length number; ``width`` bytes, or as few as can hold it."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def signed_number(value: int) -> bytes:
    """A difference of sizes, as EBML lacing stores it."""
    width = next(n for n in range(1, 9) if -(1 << 7 * n - 1) < value < 1 << 7 * n - 1)
    return number(value + (1 << 7 * width - 1) - 1, width)


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(name: int, value: float) -> bytes:
    return element(name, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing head and the frames, as they follow a block's flags."""
    if kind == NO_LACING:
        (only,) = frames
        return only
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(frames) > 1:
        head += number(sizes[0]) + b"".join(signed_number(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    elif kind == FIXED and len(set(sizes)) != 1:
        raise ValueError("fixed-size lacing needs equal frames")
    return head + b"".join(frames)


def pick_lacing(frames: list[bytes]) -> int:
    """Fixed-size for equal frames, Xiph for a short odd one, EBML otherwise."""
    if len(frames) == 1:
        return NO_LACING
    if len({len(f) for f in frames}) == 1:
        return FIXED
    return XIPH if len(frames) <= 4 else EBML_LACING


def mux(payload: bytes, frame: int = FRAME, block_frames: int = BLOCK_FRAMES, cluster_samples: int = CLUSTER_SAMPLES) -> bytes:
    """One track of unsigned 8-bit samples at 8000 a second. Equal payloads give equal files."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"columns") + element(WRITING_APP, b"columns"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, zlib.crc32(payload) | 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, places = [], []
    for at in range(0, len(payload), cluster_samples):
        samples = payload[at : at + cluster_samples]
        ticks = at * 1000 // RATE
        body = [unsigned(TIMESTAMP, ticks)]
        size = len(body[0])
        places.append((ticks, size))
        for k in range(0, len(samples), frame * block_frames):
            part = samples[k : k + frame * block_frames]
            frames = [part[i : i + frame] for i in range(0, len(part), frame)]
            kind = pick_lacing(frames)
            block = number(1) + struct.pack(">hB", k * 1000 // RATE, kind << 1 | 0x80) + lace(frames, kind)
            if k + len(part) < len(samples) or len(part) == frame * block_frames:
                body.append(element(SIMPLE_BLOCK, block))
            else:  # the last block of a cluster tells how long it lasts
                body.append(element(BLOCK_GROUP, element(BLOCK, block[:3] + bytes([kind << 1]) + block[4:]) + unsigned(BLOCK_DURATION, len(part) * 1000 // RATE)))
        clusters.append(element(CLUSTER, b"".join(body)))

    def seek_head(at: dict[int, int]) -> bytes:
        return element(SEEK_HEAD, b"".join(element(SEEK, element(SEEK_ID, name.to_bytes(4, "big")) + element(SEEK_POSITION, at.get(name, 0).to_bytes(8, "big"))) for name in (INFO, TRACKS, CUES)))

    first = len(seek_head({}))
    at = {INFO: first, TRACKS: first + len(info), CUES: first + len(info) + len(tracks) + sum(map(len, clusters))}
    position, points = first + len(info) + len(tracks), []
    for (ticks, relative), cluster in zip(places, clusters, strict=True):
        points.append(element(CUE_POINT, unsigned(CUE_TIME, ticks) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, position) + unsigned(CUE_RELATIVE_POSITION, relative))))
        position += len(cluster)
    body = b"".join([seek_head(at), info, tracks, *clusters, *([element(CUES, b"".join(points))] if points else [])])
    return head + SEGMENT.to_bytes(4, "big") + number(len(body), 8) + body


def read_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and the place behind it; None for an unknown size."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value ^= 1 << 7 * width
    return (None if value == (1 << 7 * width) - 1 else value), at + width


#: Elements in which others stand, with their possible depth, to end elements of unknown size.
_LEVEL = {EBML: 0, SEGMENT: 0, SEEK_HEAD: 1, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1}


def elements(data: bytes, at: int, end: int, level: int = 9) -> Iterator[tuple[int, int, int, int]]:
    """``(id, element's start, body's start, body's end)`` of the elements between two places."""
    while at < end:
        name, body = read_number(data, at, keep_marker=True)
        size, body = read_number(data, body)
        if size is None:
            own = _LEVEL.get(name, 9)
            stop, probe = end, body
            while probe < end:
                inner, b = read_number(data, probe, keep_marker=True)
                if _LEVEL.get(inner, 9) <= own:
                    stop = probe
                    break
                n, b = read_number(data, b)
                probe = end if n is None else b + n
        else:
            stop = body + size
        if stop > end:
            raise Malformed(f"element {name:X} at byte {at} ends outside its parent")
        yield name, at, body, stop
        at = stop


@dataclass
class Packet:
    track: int
    timestamp: int  # in ticks
    keyframe: bool
    lacing: int
    start: int
    end: int
    cluster: int
    block: int
    duration: int | None = None


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int, int]] = field(default_factory=list)  # time, track, cluster's place in the file, place in its body
    clusters: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, timestamp


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _real(data: bytes, at: int, end: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[end - at], data[at:end])[0] if end > at else 0.0


def frame_ranges(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``at`` is the byte behind the block's flags."""
    if kind == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Malformed("a laced block without a head")
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise Malformed("frames of fixed size do not fill their block")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                width = 9 - data[at].bit_length()
                value, at = read_number(data, at)
                size = value if not k else sizes[-1] + value - (1 << 7 * width - 1) + 1
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Malformed("frames do not fill their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Everything the packet tables need. Raises Malformed."""
    media = Media()
    for name, _, at, end in elements(data, 0, len(data)):
        if name == EBML:
            media.doc_type = next((data[a:b].decode("ascii", "replace") for n, _, a, b in elements(data, at, end) if n == DOC_TYPE), "")
        elif name == SEGMENT:
            _segment(data, at, end, media)
    return media


def _segment(data: bytes, origin: int, end: int, media: Media) -> None:
    for name, start, at, stop in elements(data, origin, end):
        if name == INFO:
            for n, _, a, b in elements(data, at, stop):
                if n == TIMESTAMP_SCALE:
                    media.scale = _uint(data, a, b)
                elif n == DURATION:
                    media.duration = _real(data, a, b)
        elif name == TRACKS:
            for n, _, a, b in elements(data, at, stop):
                if n == TRACK_ENTRY:
                    track = {"rate": 8000.0, "channels": 1, "bits": 0, "codec": "", "type": 0}
                    for x, _, c, d in elements(data, a, b):
                        if x == TRACK_NUMBER:
                            media.tracks[_uint(data, c, d)] = track
                        elif x == TRACK_TYPE:
                            track["type"] = _uint(data, c, d)
                        elif x == CODEC_ID:
                            track["codec"] = data[c:d].decode("ascii", "replace")
                        elif x == AUDIO:
                            for y, _, e, f in elements(data, c, d):
                                if y == SAMPLING_FREQUENCY:
                                    track["rate"] = _real(data, e, f)
                                elif y == CHANNELS:
                                    track["channels"] = _uint(data, e, f)
                                elif y == BIT_DEPTH:
                                    track["bits"] = _uint(data, e, f)
        elif name == CLUSTER:
            base, k = 0, len(media.clusters)
            media.clusters.append((start, stop, 0))
            for n, _, a, b in elements(data, at, stop):
                if n == TIMESTAMP:
                    base = _uint(data, a, b)
                    media.clusters[k] = (start, stop, base)
                elif n == SIMPLE_BLOCK:
                    _block(data, a, b, base, k, media, True, None)
                elif n == BLOCK_GROUP:
                    parts = {x: (c, d) for x, _, c, d in elements(data, a, b)}
                    lasts = _uint(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                    if BLOCK in parts:
                        _block(data, *parts[BLOCK], base, k, media, False, lasts)
        elif name == CUES:
            for n, _, a, b in elements(data, at, stop):
                if n == CUE_POINT:
                    time, found = 0, []
                    for x, _, c, d in elements(data, a, b):
                        if x == CUE_TIME:
                            time = _uint(data, c, d)
                        elif x == CUE_TRACK_POSITIONS:
                            found.append({y: _uint(data, e, f) for y, _, e, f in elements(data, c, d)})
                    media.cues += [(time, x.get(CUE_TRACK, 0), origin + x.get(CUE_CLUSTER_POSITION, 0), x.get(CUE_RELATIVE_POSITION, 0)) for x in found]


def _block(data: bytes, at: int, end: int, base: int, cluster: int, media: Media, simple: bool, lasts: int | None) -> None:
    track, at = read_number(data, at)
    if at + 3 > end:
        raise Malformed("a block without its head")
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    kind = flags >> 1 & 3
    own = media.tracks.get(track, {})
    step = own.get("rate", 0) * own.get("channels", 1) * max(own.get("bits", 8), 8) // 8 * media.scale / 1e9  # bytes a tick
    block = media.packets[-1].block + 1 if media.packets else 0
    first = at + 3
    ranges = frame_ranges(data, first, end, kind)
    pcm = own.get("codec", "").startswith("A_PCM") and step > 0
    done = 0
    for a, b in ranges:
        media.packets.append(Packet(track, base + offset + (int(done / step) if pcm else 0), bool(flags & 0x80) if simple else True, kind, a, b, cluster, block, lasts))
        done += b - a


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """All bytes of a track's frames, in the file's order."""
    return b"".join([data[p.start : p.end] for p in media.packets if p.track == track])


# ---- columns ----

PACKETS = "doc_id long, n long, track int, timestamp long, keyframe boolean, lacing int, cluster int, block int, start long, end long"


def media_column(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, media``: every text (null: empty), padded with zeros to a positive multiple of 64, as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts = raw(part)
                files = [mux(t + bytes(-len(t) % UNIT if t else UNIT)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each frame of each file of ``doc_id, media``; null files have no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media"):
                rows = []
                for doc, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                    if data is not None:
                        rows += [(doc, n, p.track, p.timestamp, p.keyframe, p.lacing, p.cluster, p.block, p.start, p.end) for n, p in enumerate(parse(data).packets)]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


def cue_table(media: DataFrame) -> DataFrame:
    """One row for each cue: ``doc_id, time, track, cluster_start, relative``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media"):
                rows = [(doc, *cue) for doc, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True) if data is not None for cue in parse(data).cues]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "time", "track", "cluster_start", "relative"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, time long, track long, cluster_start long, relative long")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters long, n_cues long, duration_ms double"


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of ``doc_id, n_bytes, media``, all from the stored bytes.

    ``feature``: packets, clusters, cues that point at their cluster, milliseconds, and mean and mean step of the
    samples (in hundredths).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in steps(batch, "media"):
                rows = []
                for doc, n, data in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                    if data is None:
                        rows.append((doc, n, *[None] * 10))
                        continue
                    found = parse(data)
                    payload = samples(data, found)
                    x = np.frombuffer(payload, np.uint8).astype(np.int16)
                    starts = {c[0] for c in found.clusters}
                    good = sum(c[2] in starts for c in found.cues)
                    level, step = int(x.sum(dtype=np.int64)) * 100 // len(x), int(np.abs(np.diff(x)).sum(dtype=np.int64)) * 100 // len(x)
                    feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cues={good};ms={found.duration:g};level={level};step={step}"
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found.packets), len(found.clusters), good, found.duration))
                s, i = pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (i, i, i, s, i, i, s, s, i, i, i, pa.float64()), strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a file, read back, and described."""
    return media_features(media_column(table(spark, sf_dir, "documents")))

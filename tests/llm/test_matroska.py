import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protloom.llm import matroska as m


def pad(data):
    return data + bytes(-len(data) % 64 if data else 64)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 300), st.integers(1, 20), st.integers(64, 3000))
def test_payload_comes_back(data, frame, block_frames, cluster):
    data = pad(data)
    stored = m.mux(data, frame, block_frames, cluster)
    found = m.parse(stored)
    assert m.samples(stored, found) == data
    starts = {c[0] for c in found.clusters}
    assert len(found.cues) == len(found.clusters) and all(c[2] in starts for c in found.cues)
    assert found.doc_type == "matroska" and found.duration == len(data) / 8


@given(st.integers(0, 2**55))
def test_numbers(value):
    assert m.read_number(m.number(value), 0) == (value, len(m.number(value)))


@given(st.integers(0, 3), st.lists(st.binary(max_size=700), min_size=1, max_size=9))
def test_lacing(kind, frames):
    if kind == m.NO_LACING:
        frames = frames[:1]
    if kind == m.FIXED:
        frames = [frames[0]] * len(frames)
    data = m.lace(frames, kind)
    assert [data[a:b] for a, b in m.frame_ranges(data, 0, len(data), kind)] == frames


def test_unknown_sizes_unknown_elements_and_timestamps():
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, 3) + m.element(m.CODEC_ID, b"A_X")))
    block = m.element(m.SIMPLE_BLOCK, m.number(3) + struct.pack(">hB", -5, 0) + b"abc")
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.unsigned(m.TIMESTAMP, 1000) + m.element(0xEC, b"void") + block
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.SEGMENT.to_bytes(4, "big") + b"\xff" + tracks + cluster + cluster
    found = m.parse(data)
    assert [(p.track, p.timestamp, p.keyframe, data[p.start : p.end], p.cluster) for p in found.packets] == [(3, 995, False, b"abc", 0), (3, 995, False, b"abc", 1)]


@pytest.mark.parametrize("data", [b"\x00", m.mux(bytes(64))[:-3], b"\x1a\x45\xdf\xa3\x9f"])
def test_malformed(data):
    with pytest.raises(m.Malformed):
        m.parse(data)


def test_packet_timestamps_follow_the_samples(spark, odd_docs):
    media = m.media_column(odd_docs)
    rows = m.packet_table(media).where("doc_id = 6").orderBy("n").collect()
    assert [r["timestamp"] for r in rows] == [k * m.FRAME // 8 for k in range(len(rows))]
    assert {r["lacing"] for r in rows} >= {m.FIXED}
    cues = m.cue_table(media).where("doc_id = 6").collect()
    assert [c["time"] for c in cues] == [k * m.CLUSTER_SAMPLES // 8 for k in range(len(cues))]


def test_query(spark, odd_docs, no_docs):
    got = m.media_features(m.media_column(odd_docs)).collect()
    docs = odd_docs.collect()
    assert len(got) == len(docs)
    want = {}
    for d in docs:
        text = (d["text"] or "").encode()
        payload = pad(text)
        want[d["doc_id"]] = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by_payload = {}
    for r in got:
        assert want[r["doc_id"]] == (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert m.media_features(m.media_column(no_docs)).collect() == []


def test_null_files(spark):
    media = spark.createDataFrame([(1, 3, None, "x"), (2, 64, bytearray(m.mux(bytes(64))), "y")], "doc_id long, n_bytes long, media binary, payload_bytes string")
    rows = {r["doc_id"]: r for r in m.media_features(media).collect()}
    assert rows[1]["n_bytes"] == 3 and rows[1]["feature"] is None and rows[1]["payload_sha256"] is None
    assert rows[2]["payload_bytes"] == 64
    assert {r["doc_id"] for r in m.packet_table(media).collect()} == {2} == {r["doc_id"] for r in m.cue_table(media).collect()}

"""Media files: exact round trips, and what damaged files give."""

import hashlib
import json
import random
import struct

import pytest

from lodestone.llm.iso_media import _box, describe, digest, media_column, mux, payload_of, probe, probe_column, samples, walk


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 16, 192 * 17, 50_001])
def test_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = payload_of(text)
    data = mux(payload)
    (track,) = probe(data)
    assert samples(data, track) == payload and payload.startswith(text) and len(payload) % 192 == 0 and not payload[n:].strip(b" ")
    assert track.codec == "raw " and len(track.sizes) == len(payload) // 192 == track.duration
    for (at, size), k in zip(track.key_ranges(), track.keys):
        assert data[at : at + size] == payload[192 * k : 192 * k + 192] and k % 12 == 0


def test_boxes_of_other_writers():
    data = mux(payload_of(b"x" * 1000))
    more = _box(b"free", bytes(8)) + data  # offsets are the writer's: shift what comes first behind
    assert "moov/trak/mdia/minf/stbl/stco" in [p for p, _, _ in walk(more)]
    wide = data.replace(struct.pack(">I4s", len(payload_of(b"x" * 1000)) + 8, b"mdat"), struct.pack(">I4s", 0, b"mdat"))
    assert probe(wide) == []  # a box up to the end hides the tables


def test_counts_that_the_file_cannot_hold():
    """Counts of tables are checked before anything is made of their size."""
    data = mux(payload_of(b"x" * 1000))
    at = {p.rpartition("/")[2]: a for p, a, _ in walk(data)}
    for box, skip, value in (("stsz", 8, 0xF0000000), ("stts", 8, 0xF0000000), ("stss", 8, 0), ("stss", 8, 7777), ("stsc", 4, 0xFFFFFFF), ("stco", 4, 0xFFFFFFF), ("stsc", 12, 0xFFFFFFF), ("stsc", 8, 9)):
        broken = bytearray(data)
        struct.pack_into(">I", broken, at[box] + skip, value)
        with pytest.raises(ValueError):
            probe(bytes(broken))
    with pytest.raises(ValueError):
        probe(data + _box(b"moof", _box(b"mfhd", bytes(8))))
    deep = b""
    for _ in range(3000):
        deep = _box(b"moov", deep)
    with pytest.raises(ValueError):
        probe(deep)


def test_contract_columns(spark):
    """The query's columns, computed a second time from the texts alone."""
    import zlib

    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 192), (None, "y" * 70_000), (1, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = digest(media_column(docs.selectExpr("doc_id", "cast(octet_length(coalesce(text, '')) as bigint) as n_bytes", "text")).select("doc_id", "n_bytes", "media")).collect()
    want = []
    for d, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(mux(payload)), hashlib.sha256(mux(payload)).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cut", [3, 20, 300, -40, -200])
def test_cut_files(cut):
    data = mux(payload_of(b"x" * 1000))[:cut]
    try:
        assert probe(data) == []
    except ValueError:
        pass


def test_columns(spark):
    rows = [(1, "text"), (2, None), (3, ""), (None, "x" * 70_000), (1, "text")]
    docs = spark.createDataFrame([(d, t, "old") for d, t in rows], "doc_id long, text string, media string")
    media = media_column(docs)
    assert media.columns == ["doc_id", "text", "media"]
    for r in media.collect():
        assert samples(r["media"], probe(r["media"])[0]) == payload_of((r["text"] or "").encode())
    tracks = probe_column(media).collect()
    assert all([t["codec"] for t in r["probed"]["tracks"]] == ["raw "] and r["probed"]["error"] is None for r in tracks)
    broken = spark.createDataFrame([(1, b"nothing"), (2, None)], "doc_id long, media binary")
    assert all(r["probed"]["error"] for r in probe_column(broken).collect())
    table = media.selectExpr("doc_id", "cast(octet_length(coalesce(text, '')) as bigint) as n_bytes", "media")
    for r in digest(table).collect():
        assert json.loads(r["feature"])["bytes"] == r["payload_bytes"]
        if r["n_bytes"] == 0:
            assert r["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert digest(table.limit(0)).collect() == []
    assert describe(probe(mux(payload_of(b"a")))[0]) == describe(probe(mux(payload_of(b"b")))[0])

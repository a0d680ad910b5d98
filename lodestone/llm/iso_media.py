"""Media columns in ISO base media files: boxes, sample tables and keyframe byte ranges.

``mux`` stores a payload as raw 8-bit video samples (8 x 8 pixels of three bytes) in a file of
ftyp, mdat and moov boxes. ``probe`` walks the nested boxes of any such file and decodes the
sample tables: codec, duration, places and sizes of samples, byte ranges of keyframes. It reads
boxes' headers and tables only; payload bytes are never looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table, text_bytes

#: Boxes whose payload is boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
FRAME, SIDE = 192, 8
#: Frames in a second, samples in a chunk, samples from keyframe to keyframe.
RATE, CHUNK, KEYS = 24, 16, 12
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A file that holds ``payload`` (a positive multiple of 192 bytes) as raw video samples."""
    n, odd = divmod(len(payload), FRAME)
    if odd or not n:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    large = len(payload) + 8 >= 1 << 32
    mdat_head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(ftyp) + len(mdat_head)
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK)] * (n >= CHUNK) + [(chunks, n % CHUNK)] * (n % CHUNK > 0)
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
    keys = np.arange(1, n + 1, KEYS)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"bytes\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, mdat_head, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def walk(data, at: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """Every box below a place: its path (moov/trak/...), where its payload begins and ends."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box is cut off")
        here = f"{path}/{kind.decode('latin-1')}".lstrip("/")
        yield here, at + head, at + size
        if kind in NESTED:
            if path.count("/") > 16:
                raise ValueError("boxes are nested too deep")
            yield from walk(data, at + head, at + size, here)
        at += size


@dataclass(frozen=True)
class Track:
    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of samples
    sizes: np.ndarray
    times: np.ndarray  # decoding time of each sample
    keys: np.ndarray  # numbers of keyframes, from 0

    def key_ranges(self) -> np.ndarray:
        """First byte and length of each keyframe."""
        return np.stack([self.offsets[self.keys], self.sizes[self.keys]], axis=1)


def _track(data, boxes: dict[str, tuple[int, int]]) -> Track:
    def rows(name: str, dtype: str, skip: int = 8) -> np.ndarray:
        if name not in boxes:
            return np.empty(0, dtype)
        a, b = boxes[name]
        (n,) = struct.unpack_from(">I", data, a + skip - 4)
        if a + skip + n * np.dtype(dtype).itemsize > b:
            raise ValueError(f"{name} is shorter than its count")
        return np.frombuffer(data, dtype, n, a + skip)

    a, _ = boxes["mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    handler = bytes(data[boxes["hdlr"][0] + 8 : boxes["hdlr"][0] + 12]).decode("latin-1")
    codec = bytes(data[boxes["stsd"][0] + 12 : boxes["stsd"][0] + 16]).decode("latin-1")
    a, _ = boxes["stsz"]
    one, n = struct.unpack_from(">II", data, a + 4)
    if n * max(one, 4 * (not one)) > len(data):  # before anything of that size is made
        raise ValueError("more samples than the file can hold")
    sizes = np.full(n, one, np.int64) if one else rows("stsz", ">u4", 12).astype(np.int64)
    stts = rows("stts", ">u4,>u4")
    if int(stts["f0"].astype(np.int64).sum()) != n:
        raise ValueError("sample tables disagree")
    steps = np.repeat(stts["f1"].astype(np.int64), stts["f0"].astype(np.int64))
    chunk_at = (rows("co64", ">u8") if "co64" in boxes else rows("stco", ">u4")).astype(np.int64)
    stsc = rows("stsc", ">u4,>u4,>u4")
    firsts = stsc["f0"].astype(np.int64)
    per = np.repeat(stsc["f1"].astype(np.int64), np.diff(np.append(firsts, len(chunk_at) + 1)))
    if len(per) != len(chunk_at) or per.sum() != n:
        raise ValueError("sample tables disagree")
    chunk = np.repeat(np.arange(len(chunk_at)), per)
    before = np.cumsum(sizes) - sizes
    first_of = (np.cumsum(per) - per)[chunk] if n else chunk
    offsets = chunk_at[chunk] + before - before[first_of] if n else before
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    keys = rows("stss", ">u4").astype(np.int64) - 1 if "stss" in boxes else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe has no sample")
    return Track(codec, handler, int(scale), int(duration), offsets, sizes, np.cumsum(steps) - steps, keys)


def probe(data) -> list[Track]:
    """The tracks of a file. Raises ValueError for what is no such file, and for files in
    fragments, whose samples aren't in the tables."""
    tracks: list[dict[str, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path == "moof":
            raise ValueError("a file in fragments")
        if path == "moov/trak":
            tracks.append({})
        elif path.startswith("moov/trak/"):
            tracks[-1][path.rpartition("/")[2]] = (a, b)
    try:
        return [_track(data, t) for t in tracks]
    except (KeyError, struct.error) as e:
        raise ValueError(f"a box is missing or cut off: {e}") from e


def samples(data, track: Track) -> bytes:
    """The stored bytes of a track, sample after sample; runs that lie together are cut once."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(bytes(data[a:b]) for a, b in zip(track.offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]))


def describe(track: Track) -> str:
    """The features of a track as text: codec, handler, duration, samples, keyframes, and a crc32
    of all keyframe byte ranges with the first and last of them."""
    keys = track.key_ranges()
    return json.dumps({
        "codec": track.codec, "handler": track.handler, "duration_s": round(track.duration / track.timescale, 6) if track.timescale else None,
        "samples": len(track.sizes), "bytes": int(track.sizes.sum()), "keyframes": len(keys), "first_key": keys[0].tolist() if len(keys) else None,
        "last_key": keys[-1].tolist() if len(keys) else None, "keys_crc32": zlib.crc32(keys.astype("<i8").tobytes()),
    })


def _facts(t: Track) -> dict:
    keys = t.key_ranges()
    return {"codec": t.codec, "handler": t.handler, "duration_s": t.duration / t.timescale if t.timescale else None, "samples": len(t.sizes), "key_offsets": keys[:, 0].tolist(), "key_sizes": keys[:, 1].tolist()}


def payload_of(text: bytes) -> bytes:
    return text + b" " * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def media_column(docs: DataFrame, *, text_col: str = "text", out: str = "media") -> DataFrame:
    """All columns of ``docs`` and ``media``: each text's bytes, padded with spaces to frames of
    192 bytes, in a file of its own. A null text counts as empty and gives one frame of spaces. A
    column named like the new one is replaced. No exchange."""
    keep = [c for c in docs.columns if c != out]
    src = docs.select(text_bytes(docs, text_col).alias("_text"), *[docs[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import blocks

        for batch, texts in blocks(batches, 0, 8 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([mux(payload_of(t)) for t in texts], pa.binary())], [*keep, out])

    return map_arrow(src, run, docs.select(*keep).schema.add(out, "binary"))


TRACK_TYPE = "struct<tracks:array<struct<codec:string,handler:string,duration_s:double,samples:long,key_offsets:array<long>,key_sizes:array<long>>>,error:string>"


def probe_column(media: DataFrame, *, media_col: str = "media", out: str = "probed") -> DataFrame:
    """All columns but the media, and ``probed``: the tracks of each file. Null media, bytes that
    are no such file, and files in fragments give null for tracks and an ``error``."""
    keep = [c for c in media.columns if c not in (out, media_col)]
    src = media.select(F.coalesce(media[media_col], F.lit("").cast("binary")).alias("_media"), *[media[c] for c in keep])
    schema = media.select(*keep).schema.add(out, _type(TRACK_TYPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import blocks

        for batch, files in blocks(batches, 0, 8 << 20):
            found = []
            for data in files:
                try:
                    if not (tracks := probe(data)):
                        raise ValueError("no track")
                    found.append({"tracks": [_facts(t) for t in tracks], "error": None})
                except ValueError as e:
                    found.append({"tracks": None, "error": str(e)})
            track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("key_offsets", pa.list_(pa.int64())), ("key_sizes", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.struct([("tracks", pa.list_(track)), ("error", pa.string())]))], [*keep, out])

    return map_arrow(src, run, schema)


def _type(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def digest(media: DataFrame) -> DataFrame:
    """From a stored table (doc_id, n_bytes, media): what is read back out of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .byte_bpe import blocks

        for batch, files in blocks(batches, 2, 8 << 20):
            rows = []
            for data in files:
                track = probe(data)[0]
                payload = samples(data, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(track)))
            cols = zip(*rows) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], NAMES)

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document's text as a media file in a table of the shared folder, then reads
    that table back."""
    docs = table(spark, sf_dir, "documents")
    src = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    stored = Scratch(spark, "iso-media").write(media_column(src).select("doc_id", "n_bytes", "media"), "media")
    return digest(stored)

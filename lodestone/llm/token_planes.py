"""Token-ID output: bit-plane shuffled blocks in zstandard, with a chunk index.

A file holds the token ids of a run of documents, in blocks of ``block_ids`` ids. The ids of a
block are transposed into planes: plane k holds byte k (or bit k) of every id, so that the high
planes are nearly constant. Each plane is compressed by itself; a plane of zeros takes no bytes.

    magic "IDPLANE1"
    planes of block 0, planes of block 1, ...
    chunk index: one row a block of (offset u64, ids u32, crc32 u32, length of each plane u32)
    document index: ids as i64, a validity byte each, numbers of tokens as i64 (zstandard)
    footer (json): places and sizes of the indexes, plane kind, totals
    footer length u32, magic

Any block can be read by itself through the index. Files are written by tasks under names that
no other attempt uses; the manifest table, which Spark commits, says which of them count. So a
lost executor or a second attempt leaves at most a file that nothing names.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, map_arrow, text_bytes, tokenizer_path, width

MAGIC = b"IDPLANE1"
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Ends that are cut off a word before it is asked for.
END_IDS = (b",", b".")
#: New words that are asked for in one text.
GROUP = 200


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """ids (uint32) as rows of planes: 4 rows of bytes or 32 rows of packed bits."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little").T
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(-1)


class PlaneWriter:
    """Appends ids and documents to one open binary file; holds one block of ids at most."""

    def __init__(self, out, kind: str = "byte", block_ids: int = 1 << 16, level: int = 3):
        import zstandard

        if kind not in ("byte", "bit"):
            raise ValueError("planes are of kind 'byte' or 'bit'")
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.place, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.index = io.BytesIO()
        self.blocks = 0
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, stop, self.block_ids):
            self._block(ids[at : min(at + self.block_ids, stop)])
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def _block(self, ids: np.ndarray) -> None:
        sizes, place = [], self.place
        for plane in to_planes(ids, self.kind):
            packed = self.pack(plane.tobytes()) if plane.any() else b""
            self.out.write(packed)
            sizes.append(len(packed))
            self.place += len(packed)
        crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
        self.index.write(struct.pack(f"<QII{len(sizes)}I", place, len(ids), crc, *sizes))
        self.blocks += 1

    def close(self) -> None:
        self._flush(True)
        index = self.index.getvalue()
        ids = np.array([0 if d is None else d for d, _ in self.docs], dtype="<i8").tobytes()
        there = bytes(d is not None for d, _ in self.docs)
        counts = np.array([n for _, n in self.docs], dtype="<i8").tobytes()
        docs = self.pack(ids + there + counts)
        self.out.write(index + docs)
        footer = json.dumps({
            "kind": self.kind, "block_ids": self.block_ids, "blocks": self.blocks, "ids": self.n_ids, "docs": len(self.docs),
            "index_at": self.place, "index_bytes": len(index), "docs_at": self.place + len(index), "docs_bytes": len(docs),
        }).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class PlaneReader:
    """Reads one file: the document index, and blocks one by one or by number."""

    def __init__(self, file):
        import zstandard

        self.file = file
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = file.size()
        tail = self._at(size - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        (n,) = struct.unpack("<I", tail[:4])
        self.footer = json.loads(self._at(size - len(MAGIC) - 4 - n, n))
        self.kind = self.footer["kind"]
        planes = 4 if self.kind == "byte" else 32
        row = np.dtype([("at", "<u8"), ("ids", "<u4"), ("crc", "<u4"), ("sizes", "<u4", (planes,))])
        self.index = np.frombuffer(self._at(self.footer["index_at"], self.footer["index_bytes"]), dtype=row)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        n = self.footer["docs"]
        raw = self.unpack(self._at(self.footer["docs_at"], self.footer["docs_bytes"]))
        ids, there = np.frombuffer(raw, "<i8", n), raw[8 * n : 9 * n]
        return [int(i) if ok else None for i, ok in zip(ids, there)], np.frombuffer(raw, "<i8", n, 9 * n)

    def block(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.index[k]
        n = int(n)
        width_ = n if self.kind == "byte" else (n + 7) // 8
        raw, planes, place = self._at(int(at), int(sizes.sum())), np.zeros((len(sizes), width_), np.uint8), 0
        for plane, size in zip(planes, map(int, sizes)):
            if size:
                plane[:] = np.frombuffer(self.unpack(raw[place : place + size]), np.uint8)
            place += size
        ids = from_planes(planes, n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class WordIds:
    """Ids of texts by the tokenizers library, asked once for each distinct word.

    The tokenizer drops white space and its normalizer and splitter never look across it, so a
    text's ids are those of its words (cut at ASCII white space) one after the other. New words
    are encoded together: words of letters with spaces between, told apart by their last tokens,
    others with a special token between. ASCII capitals are lowered first, as
    the tokenizer does it anyway (but not in texts that may hold a special token)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = "<|startoftext|>"
        self.between_id = self.tokenizer.token_to_id(self.between)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at = Numbered()
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Ask the library for the words that are new. Letters before a last comma or full stop
        are a token run of their own, so that such a word is asked for without it."""
        at, ended, letters, rest = self.at, [], [], []
        words, at.new = at.new, []
        for w in words:
            if w.isalpha() and w.isascii() or w.decode().isalpha():
                letters.append(w)
            elif w[-1:] in END_IDS and w[:-1].decode().lower().isalpha():  # some capitals become a letter and a mark
                ended.append(w)
            else:
                rest.append(w)
        core_rows = np.fromiter((at[w[:-1]] for w in ended), np.int64, len(ended))
        letters += at.new  # the cores that were new themselves
        at.new = []
        groups = [(letters[k : k + GROUP], " ") for k in range(0, len(letters), GROUP)]
        plain = [w for w in rest if b"<|" not in w]
        groups += [(plain[k : k + GROUP], self.between) for k in range(0, len(plain), GROUP)]
        groups += [([w], "") for w in rest if b"<|" in w]
        found = self.tokenizer.encode_batch_fast([b.join(w.decode() for w in some) for some, b in groups], add_special_tokens=False)
        chunks, lens = [], []
        for (some, between), got in zip(groups, found):
            ids = np.array(got.ids, np.uint32)
            if between == " ":  # each word's last token has the end of a word
                n = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
                if len(n) != len(some):  # a letter that is lowered to more than a letter
                    between = self.between
                    ids = np.array(self.tokenizer.encode(between.join(w.decode() for w in some), add_special_tokens=False).ids, np.uint32)
            if between == self.between:
                n = np.diff(np.concatenate(([-1], np.flatnonzero(ids == self.between_id), [len(ids)]))) - 1
                ids = ids[ids != self.between_id]
            elif not between:
                n = np.array([len(ids)])
            if len(n) != len(some):
                raise AssertionError("ids of words that can't be told apart")
            chunks.append(ids)
            lens.append(n)
        self._note([w for some, _ in groups for w in some], chunks, lens)
        for end in END_IDS:
            mine = [k for k, w in enumerate(ended) if w[-1:] == end]
            rows = core_rows[mine]
            last = np.array(self.tokenizer.encode(end.decode(), add_special_tokens=False).ids, np.uint32)
            n = self.lens[rows]
            ids = np.insert(gather(self.flat, self.starts, self.lens, rows), np.repeat(np.cumsum(n), len(last)), np.tile(last, len(mine)))
            self._note([ended[k] for k in mine], [ids], [n + len(last)])

    def _note(self, words: list[bytes], chunks: list[np.ndarray], lens: list[np.ndarray]) -> None:
        if not words:
            return
        rows, n = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)), np.concatenate(lens)
        if len(self.lens) < len(self.at):
            more = np.zeros(len(self.at) - len(self.lens), np.int64)
            self.starts, self.lens = np.concatenate([self.starts, more]), np.concatenate([self.lens, more])
        self.starts[rows] = len(self.flat) + np.cumsum(n) - n
        self.lens[rows] = n
        self.flat = np.concatenate([self.flat, *chunks])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.at) > CACHE_WORDS:
            self._clear()
        find, rows = self.at.__getitem__, []
        for t in texts:
            words = (t if b"<|" in t else t.lower()).split()
            rows.append(np.fromiter(map(find, words), np.int32, len(words)))
        if self.at.new:
            self._learn()
        for r in rows:
            yield gather(self.flat, self.starts, self.lens, r)


class Numbered(dict):
    """Numbers its keys as they are first asked for, and keeps the new ones in ``new``."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        n = self[key] = len(self)
        return n


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a ragged array (row k is flat[starts[k]:starts[k] + lens[k]]), one after the other."""
    n = lens[rows]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts[rows] - (ends - n), n) + np.arange(ends[-1])]


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of at most ``most`` bytes, one row at least."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > most:
            yield slice(at, k)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))


_KEPT: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """This worker's encoder; workers are reused from task to task, and so are its words."""
    if name not in _KEPT:
        _KEPT[name] = WordIds(tokenizer_path(name))
    return _KEPT[name]


#: A file that holds as many documents or ids is closed, and the task begins another: what is held
#: for a file's indexes is bounded, however many rows a task has.
FILE_DOCS, FILE_IDS = 1 << 20, 1 << 28


def write_token_planes(
    docs: DataFrame, out_dir: str, tokenizer: str = "word_bpe_49k.json", *, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", block_ids: int = 1 << 16, files: int | None = None,
    file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id``, write the ids in ascending order of ``id_col``, in
    ``files`` ranges of rows, each in one file or, beyond ``file_docs`` documents or ``file_ids``
    ids, in several. tokenizer: a public tokenizer's name, or a path that every worker has.

    Returns the manifest, one row a file: part, path, n_docs, n_tokens, base (ids in the files
    before it). A null text counts as empty; a null id sorts first; rows that share an id are
    ordered by a hash of their text, and equal rows give equal ids in either order. Other columns
    are not read. An empty table gives an empty manifest."""
    spark = docs.sparkSession
    n = files or width(spark)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))
    ranged = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, writer, path = TaskContext.get().partitionId() << 20, None, None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids]})

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for some in slices(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)), 4 << 20):
                rows = texts.slice(some.start, some.stop - some.start).to_pylist()
                for doc_id, found in zip(ids[some], word_ids(tokenizer).encode(rows)):
                    if writer is not None and (len(writer.docs) >= file_docs or writer.n_ids >= file_ids):
                        yield closed()
                        part, writer = part + 1, None
                    if writer is None:
                        path = f"{out_dir}/ids-{part:012d}-{uuid.uuid4().hex[:8]}.idp"
                        files_, inner = _filesystem(path)
                        files_.create_dir(os.path.dirname(inner), recursive=True)
                        out = files_.open_output_stream(inner)
                        writer = PlaneWriter(out, kind, block_ids)
                    writer.add(doc_id, np.append(found, np.uint32(end_id)))
        if writer is not None:
            yield closed()

    written = map_arrow(ranged, encode, "part long, path string, n_docs long, n_tokens long")
    path = f"{out_dir}/manifest"
    written.write.mode("overwrite").parquet(path)
    manifest = spark.read.schema(written.schema).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_planes(manifest: DataFrame) -> DataFrame:
    """Read the files that a manifest names: doc_id, start, n_tokens, ids_crc32 of each document.

    Files are read a block at a time; a document may span blocks."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files_, inner = _filesystem(path)
                with files_.open_input_file(inner) as file:
                    reader = PlaneReader(file)
                    ids, counts = reader.documents()
                    crcs, at, held = [], 0, np.empty(0, "<u4")
                    blocks = iter(range(len(reader.index)))
                    for need in map(int, counts):
                        crc = 0
                        while True:
                            take = min(need, len(held) - at)
                            crc = zlib.crc32(memoryview(held[at : at + take]).cast("B") if take else b"", crc)
                            at, need = at + take, need - take
                            if not need:
                                break
                            held, at = reader.block(next(blocks)), 0
                        crcs.append(crc)
                    starts = base + np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return map_arrow(manifest.select("path", "base").repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out = Scratch(spark, "token-planes").path("files")
    return read_token_planes(write_token_planes(table(spark, sf_dir, "documents"), out))

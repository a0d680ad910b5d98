"""Byte-pair encoding and decoding through a pair occurrence index.

All distinct words of a block of texts lie in one array of symbols. An index maps the rank of a
pair to every position where the pair stands. Ranks that occur are applied in ascending order:
all positions of a rank merge at once, and the pairs that this makes with the neighbours join
the lists of their own ranks. A list may hold stale positions; they are told by their symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_arrow, table, text_bytes, tokenizer_path
from .token_planes import Numbered, gather, slices

#: White space as the tokenizer's splitter has it, and the splitter's pattern.
# (Not \s, which takes in U+001C to U+001F as well.)
SPACE = r"\t-\r\x20\x85\xa0" "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that isn't just followed by a word: such a text is cut the slow way.
ODD = regex.compile(rf"^ | (?:$|[{SPACE}])")
CUT = regex.compile(rf"(?= [^{SPACE}])")
#: Parts of texts whose ids a worker keeps, and their characters; beyond it the cache starts anew.
CACHE_PARTS, CACHE_CHARS = 500_000, 8 << 20
#: Bytes of text whose new words share one index.
BLOCK = 16 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1,
    else the next free one from U+0100."""
    free = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(free)) for b in range(256)]


class Ragged:
    """Rows of ids of different lengths, one after the other."""

    def __init__(self):
        self.flat, self.starts, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, flat])

    def rows(self, which) -> np.ndarray:
        return gather(self.flat, self.starts, self.lens, np.asarray(which, np.int64))


class PairIndexBpe:
    """One vocabulary: encodes texts to ids and decodes ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.span = int(max(vocab.values())) + 1
        keys = left * self.span + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        back = {s: b for b, s in enumerate(symbols)}
        n = max([self.span - 1, *self.special.values()]) + 1
        table_: list[bytes] = [b""] * n
        for token, k in vocab.items():
            table_[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            table_[k] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(table_), np.uint8)
        self.token_lens = np.array([len(x) for x in table_], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self._clear()

    # -- ranks ---------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none (or a border, a symbol below 0)."""
        key = a.astype(np.int64) * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        lens = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lens + 1)
        size = int(ends[-1]) + 1 if len(words) else 1
        sym = np.full(size, -1, np.int32)  # a border before the first word and after each
        inner = np.ones(size, bool)
        inner[0] = False
        inner[ends] = False
        sym[inner] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.arange(1, size + 1, dtype=np.int32)
        nxt[-1] = size - 1
        prv = np.arange(-1, size - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, some in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(heap, r)

        every = np.arange(size - 1, dtype=np.int32)
        note(every, self._ranks(sym[:-1], sym[1:]))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols, pairs from the left
                head = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
                first = np.flatnonzero(head)
                at = at[(np.arange(len(at)) - first[np.cumsum(head) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -2
            nxt[at], prv[after] = after, at
            spots = np.concatenate([prv[at], at])
            spots = spots[sym[spots] >= 0]
            note(spots, self._ranks(sym[spots], sym[nxt[spots]]))
        alive = sym >= 0
        counts = np.add.reduceat(alive[:-1].astype(np.int64), np.concatenate(([0], ends[:-1]))) if len(words) else lens
        return sym[alive], counts

    # -- texts ---------------------------------------------------------------------------

    def _clear(self) -> None:
        self.spaced, self.plain = Numbered(), Numbered()
        self.of_spaced, self.of_plain = Ragged(), Ragged()
        self.chars = 0

    def _learn(self, seen: Numbered, held: Ragged, lead: str) -> None:
        parts, seen.new = seen.new, []
        self.chars += sum(map(len, parts))
        words: list[bytes] = []
        counts = []
        for p in parts:
            found = WORDS.findall(lead + p)
            counts.append(len(found))
            words += [w.encode() for w in found]
        ids, lens = self.merge(words)
        ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(counts, dtype=np.int64)]
        held.add(ids, np.diff(ends, prepend=0))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.spaced) + len(self.plain) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self._clear()
        cut: list[list] = []
        of_spaced, of_plain = self.spaced.__getitem__, self.plain.__getitem__
        for text in texts:
            pieces = []
            for k, run in enumerate(self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]):
                if k % 2:
                    pieces.append(self.special[run])
                elif run:  # parts whose ids don't depend on each other: what follows a space has a row of its own
                    if ODD.search(run):
                        first, *rest = CUT.split(run)
                        rest = [p[1:] for p in rest]
                    else:
                        first, *rest = run.split(" ")
                    pieces.append((of_plain(first), np.fromiter(map(of_spaced, rest), np.int32, len(rest))))
            cut.append(pieces)
        if self.plain.new:
            self._learn(self.plain, self.of_plain, "")
        if self.spaced.new:
            self._learn(self.spaced, self.of_spaced, " ")
        out = []
        for pieces in cut:
            runs = [np.empty(0, np.int32)]
            for p in pieces:
                runs += [np.array([p], np.int32)] if isinstance(p, int) else [self.of_plain.rows([p[0]]), self.of_spaced.rows(p[1])]
            out.append(np.concatenate(runs))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids, special tokens included, as UTF-8; bytes that are no UTF-8 become
        U+FFFD, as the library has it."""
        raw = gather(self.token_bytes, self.token_starts, self.token_lens, ids).tobytes()
        return raw.decode("utf-8", "replace").encode()


_KEPT: dict[str, PairIndexBpe] = {}


def bpe(name: str) -> PairIndexBpe:
    if name not in _KEPT:
        _KEPT[name] = PairIndexBpe(tokenizer_path(name))
    return _KEPT[name]


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK, values: bool = True) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut to at most ``most`` bytes of a binary column, with that column's values."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)) if len(col) else np.empty(0, int)
        for s in slices(sizes, most):
            some = batch.slice(s.start, s.stop - s.start)
            yield some, some.column(column).to_pylist() if values else []


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs``, and ``ids`` (array of int) and ``decoded`` (string).

    A null text counts as empty, and gives no ids and an empty text. Columns named like the new
    ones are replaced. Rows stay where they are: there is no exchange."""
    keep = [c for c in docs.columns if c not in (out, "decoded")]
    src = docs.select(text_bytes(docs, text_col).alias("_text"), *[docs[c] for c in keep])
    schema = docs.select(*keep).schema.add(out, ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, 0):
            coder = bpe(tokenizer)
            ids = coder.encode([t.decode() for t in raw])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], col, pa.array([coder.decode_bytes(x).decode() for x in ids], pa.string())], [*keep, out, "decoded"])

    return map_arrow(src, run, schema)


def digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", ids_too: bool = False) -> DataFrame:
    """Encoding and decoding of every text, told by digests made beside the ids: the ids
    themselves leave the worker only with ``ids_too``. Null texts as in ``encode_decode``."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, 1, BLOCK // 4 if ids_too else BLOCK):
            coder = bpe(tokenizer)
            ids = coder.encode([t.decode() for t in raw])
            cols = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(np.ascontiguousarray(x, dtype="<u4").data).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(coder.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
            ]
            if ids_too:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return map_arrow(src, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids_too)


def op8_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))

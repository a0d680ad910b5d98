"""Id planes: exact round trips, and the ids of the tokenizers library."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm.common import Scratch, tokenizer_path
from lodestone.llm.token_planes import PlaneReader, PlaneWriter, WordIds, from_planes, read_token_planes, to_planes, write_token_planes

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "ß", "Σ", "ΑΣ", "1", "12", "!", "'s", "'T", "<|endoftext|>", "<|startoftext|>", " ", " ", "\x1c", "\x85", "日本", "İ", "ﬁ", "́", "😀", "\x00", ",", ".", "word"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (from_planes(to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip(kind, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(k if k != 3 else None, rng.integers(0, 49408, int(n)).astype(np.uint32)) for k, n in enumerate([0, 1, 5000, 3, 64, 64, 128, 0])]
    with open(tmp_path / "f", "wb") as out:
        writer = PlaneWriter(out, kind, block_ids=64)
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    reader = PlaneReader(pa.OSFile(str(tmp_path / "f")))
    flat = np.concatenate([reader.block(k) for k in range(len(reader.index))])
    assert (flat == np.concatenate([x for _, x in docs])).all()
    ids, counts = reader.documents()
    assert ids == [d for d, _ in docs] and counts.tolist() == [len(x) for _, x in docs]
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[12] ^= 1
    (tmp_path / "g").write_bytes(raw)
    with pytest.raises(Exception):
        PlaneReader(pa.OSFile(str(tmp_path / "g"))).block(0)
    (tmp_path / "h").write_bytes(b"nothing of the kind, though long enough")
    with pytest.raises(ValueError):
        PlaneReader(pa.OSFile(str(tmp_path / "h")))


def test_word_ids_are_the_librarys():
    texts = odd_texts(3000) + ["", " ", "the Thing, the thing. THE ÉTÉ, été. İx, x"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    coder = WordIds(PATH)
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts])] == want
    assert [x.tolist() for x in coder.encode([t.encode() for t in texts[::-1]])] == want[::-1]


@pytest.mark.parametrize("more", [{}, {"file_docs": 7}, {"file_ids": 300}])
def test_written_and_read_back(spark, more):
    texts = odd_texts(200, 5)
    rows = [(k * 7 % 200, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, "lost"), (502, "long " * 60_000), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(5)
    out = Scratch(spark, "test").path("files")
    got = sorted(map(tuple, read_token_planes(write_token_planes(docs, out, block_ids=512, files=4, **more)).collect()), key=lambda r: r[1])
    coder = Tokenizer.from_file(PATH)
    want = {}
    for d, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    files = sum(f.endswith(".idp") for f in os.listdir(out.removeprefix("file://")))
    assert files > 25 if "file_docs" in more else files > 4 if more else files <= 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_planes(write_token_planes(docs, Scratch(spark, "test").path("files"))).collect() == []

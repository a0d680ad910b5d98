"""The pair index against the tokenizers library."""

import hashlib

import numpy as np
from test_token_planes import odd_texts
from tokenizers import Tokenizer

from lodestone.llm.byte_bpe import PairIndexBpe, digest, encode_decode
from lodestone.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
EXTRA = ["", " ", "  ", "a  b", "a \n b", " a", "a ", "aaaaaaaaaaa aaaa", "don't DON'T we'll", "x" * 5000, "ab " * 4000, "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|><|endoftext|>x"]


def test_ids_and_texts_are_the_librarys():
    texts = odd_texts(4000, 2) + EXTRA
    library, own = Tokenizer.from_file(PATH), PairIndexBpe(PATH)
    want = library.encode_batch(texts, add_special_tokens=False)
    got = own.encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in want]
    assert [own.decode_bytes(x).decode() for x in got] == [library.decode(e.ids, skip_special_tokens=False) for e in want]
    assert [x.tolist() for x in own.encode(texts[::3])] == [e.ids for e in want[::3]]  # from the cache


def test_every_merge_of_a_token_comes_after_its_parts():
    own = PairIndexBpe(PATH)
    made = {int(t): r for r, t in enumerate(own.made)}
    assert len(made) == len(own.made)
    assert all(made.get(int(t), -1) < r for r, pair in enumerate(zip(own.left, own.right)) for t in pair)


def test_queries_of_rows(spark):
    rows = [(1, "Some text, some text."), (2, None), (3, ""), (None, "no id"), (1, "Some text, some text.")]
    docs = spark.createDataFrame([(d, t, "kept", 5) for d, t in rows], "doc_id long, text string, ids string, other int")
    library = Tokenizer.from_file(PATH)
    out = encode_decode(docs).collect()
    assert sorted(encode_decode(docs).columns) == ["decoded", "doc_id", "ids", "other", "text"]
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "") and r["other"] == 5
    for r in digest(docs, ids_too=True).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert digest(docs.limit(0)).collect() == [] and encode_decode(docs.limit(0)).collect() == []

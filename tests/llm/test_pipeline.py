"""The pipeline against its stages done plainly, one after the other."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from test_classifiers import bad_text, good_text
from test_minhash_forest import brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import line_crf
from lodestone.llm.common import tokenizer_path
from lodestone.llm.line_suffixes import OP6_SQL
from lodestone.llm.mixing import LEVELS, mix_sql


def tables(folder):
    rng = random.Random(6)
    rows, labels = [], []
    passage = "\n".join(good_text(rng).split("\n")[0] + " " + good_text(rng).split("\n")[0] for _ in range(5))
    for k in range(240):
        bad = k % 5 == 0
        text = bad_text(rng) if bad else good_text(rng)
        if not bad and rows and rng.random() < 0.25:
            words = rng.choice([t for _, t, *_ in rows if t]).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if not bad and rng.random() < 0.15:
            text = f"{text}\n{passage}"
        rows.append((k, text, rng.choice(["en", "fr", "de"]), f"src{rng.randrange(6) if rng.random() < 0.6 else 0}", len(text)))
        if rng.random() < 0.8:
            labels.append((k, int(not bad), 0))
    rows += [(900, rows[1][1], "en", "src1", len(rows[1][1])), (901, None, None, None, None), (902, "", "en", "src2", 0)]
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [a for a, _, _ in labels], "quality": pa.array([b for _, b, _ in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    field = line_crf.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    raw = [(r[1] or "").encode() for r in rows]
    scores = field.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    kept = [r for r, s in zip(rows, scores) if s >= 0.3]
    assert 0 < len(kept) < len(rows)

    con = duckdb.connect()

    def put(some):
        con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in some], pa.int64()), "text": pa.array([r[1] for r in some], pa.string()), "lang": pa.array([r[2] for r in some], pa.string()), "source": pa.array([r[3] for r in some], pa.string())}))

    put(kept)
    cut = {d: (t, n, gone) for d, t, n, gone in con.sql(f"select doc_id, text, n_lines, n_removed from ({OP6_SQL})").fetchall()}
    assert any(gone for _, _, gone in cut.values())
    lines = [(d, cut[d][0], lang, source) for d, _, lang, source, _ in kept if not cut[d][2] or cut[d][2] < cut[d][1]]
    stays = {d for d, _, _, keep in brute_force([(d, t) for d, t, *_ in lines], 5) if keep}
    assert len(stays) < len(lines)
    lines = [r for r in lines if r[0] in stays]
    put(lines)
    mixed = con.sql(f"select doc_id from ({mix_sql(LEVELS, 9, 10, 1, 17)})").fetchall()
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = {r[0]: r[1] or "" for r in lines}
    want = {}
    for (d,) in mixed:
        ids = library.encode(text[d], add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[d].encode()).hexdigest(), ids)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_return_documents(spark, tmp_path):
    tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    """Rows that share an id fare each by its own text; of equal rows one stays; nothing gives
    nothing."""
    long = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    rows = [(1, long(1)), (5, long(1)), (5, long(2)), (7, long(3)), (7, long(3)), (None, None), (None, long(1))]
    docs = spark.createDataFrame([(d, t, "en", "src1", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, long(1)), (5, long(2)), (7, long(3)), (None, None), (None, long(1))], key=str)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

"""A corpus pipeline of five of the operators: quality classifier, line dedup, MinHash near-dedup,
mixing sources to target weights, BPE encoding and decoding.

Each stage takes all that its predecessor kept. All but the last return the columns of documents,
with ``n_chars`` counted anew where a text changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, line_crf, line_suffixes, minhash_forest, mixing
from lodestone.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on a bounded sample of the labels, scores 0.3 or
    more; the others go."""
    return line_crf.keep_good(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of 50 words or more. A document that loses all
    its lines goes; one without text before stays as it is."""
    done = line_suffixes.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group linked at a similarity of 0.8 of
    five-word shingles; a row is told by its id and text."""
    return minhash_forest.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the weights of domains, languages and sources; at most one
    epoch, so that no document comes twice."""
    return mixing.mix(docs, numerator=9, denominator=10, epochs=1).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of them and of the text decoded from them."""
    return byte_bpe.digest(docs, ids_too=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing to target weights", mixture),
    ("bpe encoding", encode),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

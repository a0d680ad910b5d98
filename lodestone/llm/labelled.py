"""What the classifiers share: the bounded training sample, and logistic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Sample:
    """Labelled documents to learn from: ids with labels, a bounded number; how many of each label
    were picked; and how many of labels 0 and 1 there are in all that may be learnt from."""

    ids: DataFrame
    picked: dict[int, int]
    shares: tuple[int, int]

    def of(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, y) of the picked documents; no text moves, as the ids are few enough to
        broadcast. A null text is empty."""
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")).join(F.broadcast(self.ids), "doc_id").select("doc_id", "text", "y")

    def texts(self, docs: DataFrame) -> list[tuple[bytes, int]]:
        rows = sorted((r["doc_id"], bytes(r["text"]), r["y"]) for r in self.of(docs).toLocalIterator())
        return [(t, y) for _, t, y in rows]


def training_sample(labels: DataFrame, label: str, most: int, seed: int) -> Sample:
    """At most ``most`` documents of each label that aren't held out: those whose ids hash
    lowest. The bound is the same at every size. Null labels and ids are passed over; a document
    with both labels counts with each."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    picked = [r for y in (0, 1) for r in known.where(f"y = {y}").orderBy(*order).limit(most).collect()]
    all_ = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    return Sample(labels.sparkSession.createDataFrame(picked, "doc_id long, y int"), Counter(r["y"] for r in picked), (all_.get(0, 0), all_.get(1, 0)))


def logistic(x: np.ndarray, y: np.ndarray, shares: tuple[int, int] | None = None, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept (first), by Newton steps. Classes weigh
    as they come; with ``shares``, the intercept is then moved to a population of so many of
    labels 0 and 1, so that a bounded sample with other shares gives the same scores."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge * len(z))
    keep[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    if shares and min(shares) > 0 and 0 < y.sum() < len(y):
        w[0] += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))

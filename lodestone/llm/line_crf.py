"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own features and those of the lines before
and after it; a transition weight binds neighbouring lines. Forward-backward gives each line's
marginal, and the marginals, weighted by the lines' lengths, make a document's quality; a
logistic function fitted on the training documents turns it into a score.

The field is trained by conditional likelihood on labelled documents, whose lines have the
document's label. Features are of form alone (cases, signs, repeats, lengths): nothing of the
label, language, source or id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import blocks
from .common import map_arrow, table, text_bytes
from .labelled import held_out, logistic, probability, training_sample
from .token_planes import slices
from .words import LOWER, arrow_bytes, span_hashes, word_spans

#: Kinds of bytes that are counted.
KINDS = {"upper": range(65, 91), "digit": range(48, 58), "mark": (33, 63, 42, 35, 37, 38, 36, 64, 94, 126, 60, 62, 61, 43, 92, 95), "bar": (124,), "stop": (44, 46), "blank": (9, 11, 12, 13, 32)}
LOOKUP = np.zeros((len(KINDS), 256), bool)
for _row, _bytes in zip(LOOKUP, KINDS.values()):
    _row[list(_bytes)] = True
OWN = 22


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each line, and each text's first line; an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    # A feed at a text's end begins an empty last line, which stands before the next text's first.
    first = np.arange(len(offsets) - 1) + np.searchsorted(feeds, offsets[:-1])
    ends = np.empty(len(starts), np.int64)
    own = np.ones(len(starts), bool)
    own[first[1:] - 1] = False
    own[-1:] = False
    ends[own] = feeds
    ends[~own] = offsets[1:]
    return starts, ends, np.append(first, len(starts))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its features with those of its neighbours, and its length; each text's first
    line."""
    starts, ends, first = lines_of(data, offsets)
    size = (ends - starts).astype(float)
    full = np.maximum(size, 1)
    share = np.empty((len(KINDS), len(starts)))
    for k, row in enumerate(LOOKUP):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(row[data], out=total[1:])
        share[k] = (total[ends] - total[starts]) / full
    upper, digit, mark, bar, stop, blank = share
    lowered = LOWER[data]
    a, b = word_spans(lowered, offsets)
    h = span_hashes(lowered, a, b)
    line = np.searchsorted(starts, a, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[same], minlength=len(starts)) / np.maximum(words - 1, 1)
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(starts)) / np.maximum(words, 1)
    longest = np.zeros(len(starts))
    np.maximum.at(longest, line, (b - a).astype(float))
    mean = (size * (1 - blank)) / np.maximum(words, 1)
    own = np.column_stack([
        np.log1p(size) / 8, np.log1p(words) / 6, size == 0, words < 4, upper, upper > 0.15, upper > 0.4, digit, digit > 0.2, mark * 5, mark > 0.02, mark > 0.1,
        bar * 10, bar > 0.01, stop * 10, stop == 0, again, again > 0.2, (1 - distinct) * (words > 8), (distinct < 0.5) & (words > 8), np.minimum(mean, 30) / 10, np.log1p(longest) / 5,
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edge = np.zeros((len(starts), 3))
    edge[:, 0] = 1
    edge[first[:-1], 1] = 1
    edge[first[1:] - 1, 2] = 1
    return np.column_stack([own, before, after, edge]), size, first


class Chains:
    """Chains of different lengths, walked step by step, all at once."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        starts, alive = first[:-1][order], np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), side="right")
        self.steps = [starts[:k] + t for t, k in enumerate(alive)]

    def forward_backward(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """emit: log weight of good against bad of each line; trans[i, j]: log weight of state j
        after i (0 bad, 1 good). Marginals of good, expected transitions and each chain's log
        partition."""
        e = np.column_stack([np.zeros(len(emit)), emit])
        alpha, beta = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        scale = np.zeros(len(emit))
        for t, rows in enumerate(self.steps):
            a = e[rows]
            if t:
                p = alpha[rows - 1]
                a = a + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
            top = np.logaddexp(a[:, 0], a[:, 1])
            scale[rows] = top
            alpha[rows] = a - top[:, None]
        pairs = np.zeros((2, 2))
        for rows in self.steps[:0:-1]:
            b = beta[rows] + e[rows] - scale[rows][:, None]
            joint = np.exp(alpha[rows - 1][:, :, None] + trans[None] + b[:, None, :])
            pairs += joint.sum(axis=0)
            beta[rows - 1] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
        return np.exp(alpha[:, 1] + beta[:, 1]), pairs, scale


@dataclass(frozen=True)
class LineField:
    """A fitted field: weights of the features, of transitions, and the calibration."""

    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    calibration: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each line the probability that it is good."""
        return Chains(first).forward_backward(((x - self.center) / self.spread) @ self.weights, self.trans)[0]

    def summary(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text, as log odds."""
        x, size, first = features(data, offsets)
        m, weight = self.marginals(x, first), size + 1
        mean = np.add.reduceat(m * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.empty(0)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return probability(self.calibration, self.summary(data, offsets)[:, None]) if len(offsets) > 1 else np.empty(0)


def train(texts: list[tuple[bytes, int]], *, shares: tuple[int, int] | None = None, rounds: int = 200, ridge: float = 1e-4, rate: float = 0.08) -> LineField:
    """Fits the field on labelled texts by gradient steps with momenta on the whole sample. shares:
    how many documents of label 0 and 1 there are in all, if the texts don't show it. Without texts of both labels every score is the share of good ones (a half where there are none)."""
    y = np.array([label for _, label in texts], float)
    width = 3 * OWN + 3
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return LineField(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0]))
    parts = [features(*joined) for joined in _joined([t for t, _ in texts])]
    x = np.concatenate([x for x, _, _ in parts])
    n = np.concatenate([np.diff(first) for _, _, first in parts])
    first = np.concatenate(([0], np.cumsum(n)))
    label = np.repeat(y, n)
    center, spread = x.mean(axis=0), x.std(axis=0)
    center[-3], spread[-3] = 0, 1
    spread[spread < 1e-6] = 1
    z = (x - center) / spread
    chains = Chains(first)
    told = np.zeros((2, 2))  # transitions as labelled: lines of a document agree
    told[1, 1], told[0, 0] = ((n - 1) * y).sum(), ((n - 1) * (1 - y)).sum()
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, rounds + 1):
        p, pairs, _ = chains.forward_backward(z @ theta[:width], theta[width:].reshape(2, 2))
        g = np.concatenate([z.T @ (label - p), (told - pairs).reshape(-1)]) / len(z) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field = LineField(center, spread, theta[:width], theta[width:].reshape(2, 2), np.zeros(2))
    seen = np.concatenate([field.summary(*joined) for joined in _joined([t for t, _ in texts])])
    return LineField(center, spread, field.weights, field.trans, logistic(seen[:, None], y, shares))


def _joined(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts one after the other, about ``most`` bytes at once, and where each begins."""
    for s in slices(np.array([len(t) for t in texts]), most):
        yield np.frombuffer(b"".join(texts[s]), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts[s]])))


def score(docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row. A null text counts as empty, which is one empty
    line. Other columns are not read. No exchange."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in blocks(batches, 1, 4 << 20, values=False):
            s = sent.value.score(*arrow_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(src, run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, field: LineField, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns. No
    exchange; null texts count as empty."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    src = docs.toDF(*names)
    src = src.withColumn("_text", text_bytes(src, names[docs.columns.index(text_col)]))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in blocks(batches, len(names), 4 << 20, values=False):
            good = sent.value.score(*arrow_bytes(batch.column(len(names)))) >= threshold
            yield batch.filter(pa.array(good)).select(names)

    return map_arrow(src, run, docs.toDF(*names).schema).toDF(*docs.columns)


def label_lines(docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, good, n_bytes): the marginal of every line, for reading what the field saw."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in blocks(batches, 1, 4 << 20, values=False):
            x, size, first = features(*arrow_bytes(batch.column(1)))
            n = np.diff(first)
            good = sent.value.marginals(x, first) if len(x) else np.empty(0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(size)) - np.repeat(first[:-1], n), pa.int64()), pa.array(good), pa.array(size.astype(np.int64))], ["doc_id", "line", "good", "n_bytes"])

    return map_arrow(src, run, "doc_id long, line long, good double, n_bytes long")


#: Documents of each label that the field is fitted on, at most.
SAMPLE = 2000


def fit(docs: DataFrame, labels: DataFrame) -> LineField:
    sample = training_sample(labels, "quality", SAMPLE, 5)
    return train(sample.texts(docs), shares=sample.shares)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")

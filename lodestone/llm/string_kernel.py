"""Toxicity by a support vector machine over a subsequence string kernel.

A sentence is a bag of windows: its words, each with a border before and after it, and runs of
letters that stand apart, put together. The kernel of two windows counts the character triples
that both have as subsequences of at most ``SPAN`` characters, each weighted by ``DECAY`` to the
power of its span in either, and is normalised. So letters put in between, and other endings,
lower the similarity and don't destroy it, and the borders tell an insult from a word that has one
inside. Nystroem landmarks, chosen among windows of the labelled sentences, turn the kernel into
features, and a linear machine with squared hinge loss is trained on them.

Labels belong to documents; the machine is trained by multiple instances. All sentences of a clean
document are clean, and so are their windows. Of a toxic document the sentence of the highest
decision is taken as toxic, for its worst window, if that decision is positive, in some rounds; beside those stand the windows
that toxic documents hold beyond chance, by the log-likelihood ratio of their counts over the
counted documents. Many documents make small differences certain, as of a tongue that has more
toxic documents than others, and copies of one toxic document make all its words telling; so a
window must also have ``LIFT`` times the odds of chance, and counts where no other window of the
document is far more telling. Clean windows that the machine finds likest an insult join the negative
examples after each round. A sentence has the decision of its worst window, a document that of its
worst sentence, and a logistic function fitted on the training documents makes it a score.

With landmarks l and weights a, a decision is sum a(l) k(w, l) / sqrt(k(w, w) k(l, l)) - bias.
The sum over landmarks is taken once, into one weight for each triple; a window then costs as much
as its triples, whatever the number of landmarks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import blocks
from .common import Scratch, map_arrow, table, text_bytes
from .labelled import Sample, held_out, logistic, probability, training_sample
from .token_planes import Numbered

SPAN, DECAY = 6, 0.7
#: Characters are folded to so many kinds: letters a-z, digits, the rest by their code, borders.
KINDS = 41
BORDER = "\1"
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
#: Longer words are cut in pieces of so many characters that overlap by half.
LONGEST = 48
CACHE_WORDS = 500_000
#: Documents of each label that are looked for witnesses and calibrated on, and documents of each
#: label whose windows are counted, at most.
SAMPLE, COUNTED = 1500, 20_000
SENTENCE = regex.compile(r"[.!?\n]+\s*")
#: Single characters in a row, as of a word whose letters stand apart.
APART = regex.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
NOISE = regex.compile(r"[^\p{L}\p{N}]+")


def fold(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all characters, with a border before and after each word, and a -1 behind; and
    each word's begin."""
    text = "".join(f"{BORDER}{w}{BORDER}\0" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = 27 + code % (KINDS - 28)
    kind = np.where((code >= 97) & (code <= 122), code - 97, np.where((code >= 48) & (code <= 57), 26, kind)).astype(np.int32)
    kind[code == ord(BORDER)] = KINDS - 1
    end = code == 0
    kind[end] = -1
    return kind, np.concatenate(([0], np.flatnonzero(end)[:-1] + 1))


def triples(kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) with every triple once a word, sorted."""
    word = np.zeros(len(kind), np.int64)
    word[starts[1:]] = 1
    word = np.cumsum(word)
    keys, weights = [], []
    for a, b in GAPS:
        n = len(kind) - a - b
        if n <= 0:
            continue
        x, y, z = kind[:n], kind[a : a + n], kind[a + b :]
        ok = (x >= 0) & (y >= 0) & (z >= 0) & (word[:n] == word[a + b :])
        keys.append(word[:n][ok] * KINDS**3 + (x[ok] * KINDS + y[ok]) * KINDS + z[ok])
        weights.append(np.full(len(keys[-1]), DECAY ** (a + b + 1)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    return key[first] // KINDS**3, key[first] % KINDS**3, weight


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The normalised kernel of every two words; of a word without triples zero."""
    out = np.zeros((len(left), len(right)), np.float32)
    rw, rt, rv = triples(*fold(right))
    dense = np.zeros((KINDS**3, len(right)), np.float32)
    dense[rt, rw] = rv
    scale = np.sqrt(np.bincount(rw, rv * rv, len(right)))
    dense /= np.where(scale > 0, scale, 1).astype(np.float32)
    for at in range(0, len(left), 400):
        some = left[at : at + 400]
        lw, lt, lv = triples(*fold(some))
        scale = np.sqrt(np.bincount(lw, lv * lv, len(some)))
        first = np.flatnonzero(np.concatenate(([True], lw[1:] != lw[:-1]))) if len(lw) else np.empty(0, np.int64)
        if len(first):
            sums = np.add.reduceat(dense[lt] * lv[:, None].astype(np.float32), first, axis=0)
            out[at + lw[first]] = sums / scale[lw[first]][:, None].astype(np.float32)
    return out


def units(text: str) -> list[str]:
    """Words of a lower-cased text; letters that stand apart also as one word."""
    words = text.split()
    return words + [m.replace(" ", "").replace("\t", "") for m in APART.findall(text)]


def pieces(word: str) -> list[str]:
    """What of a word is compared: without marks, longer words in overlapping pieces."""
    word = NOISE.sub("", word)
    return [word[k : k + LONGEST] for k in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)]


@dataclass(frozen=True)
class KernelMachine:
    """A fitted machine: a weight for each triple, the bias, and the calibration."""

    weights: np.ndarray  # of triples
    bias: float
    calibration: np.ndarray
    landmarks: tuple[str, ...]

    def decisions(self, words: list[str]) -> np.ndarray:
        """The decision of each word; of a word without triples that of similarity zero."""
        parts, owner = [], []
        for k, w in enumerate(words):
            for p in pieces(w):
                parts.append(p)
                owner.append(k)
        out = np.full(len(words), -np.inf)
        owner = np.array(owner, np.int64)
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            w, t, v = triples(*fold(some))
            norm = np.sqrt(np.bincount(w, v * v, len(some)))
            raw = np.bincount(w, v * self.weights[t], len(some))
            np.maximum.at(out, owner[at : at + 20_000], raw / np.where(norm > 0, norm, 1) - self.bias)
        return np.where(np.isfinite(out), out, -self.bias)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return probability(self.calibration, worst[:, None])


def _mapped(words: list[str], marks: list[str], root: np.ndarray) -> np.ndarray:
    """Nyström features of words, in single precision, some thousand words at once."""
    parts = [(kernel(words[k : k + 4000], marks) @ root).astype(np.float32) for k in range(0, len(words), 4000)]
    return np.concatenate(parts) if parts else np.empty((0, root.shape[1]), np.float32)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights with the bias last, by Newton steps on the examples inside the margin."""
    z = np.column_stack([x, -np.ones(len(x))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = ridge * 1e-3
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        zi, c = z[inside], weight[inside]
        new = np.linalg.solve((zi * c[:, None]).T @ zi + np.diag(keep), (zi * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def windows(text: str) -> list[list[str]]:
    """The windows of each sentence of a text."""
    return [[p for w in units(s) for p in pieces(w) if p] for s in SENTENCE.split(text.lower())]


@dataclass(frozen=True)
class Tally:
    """How many of the counted documents of each label hold a window: ``toxic``, those that toxic
    ones hold beyond chance, the most telling first, with both counts and the number of toxic ones
    that it stands for (``stands_for``); ``clean``, the most frequent
    ones and a random choice of those of clean documents, with their counts; ``likest`` gives, of
    all of clean documents, those of the highest decisions; ``sizes``, how many documents of label
    0 and 1 were counted, whose shares a bound may have moved from those of all labelled ones."""

    toxic: list[tuple[str, int, int, int]]
    clean: list[tuple[str, int]]
    likest: Callable[[KernelMachine], list[tuple[str, int]]]
    sizes: tuple[int, int]


#: Bounds of a tally: telling windows, frequent ones, random ones, likest ones.
POOL, FREQUENT, RANDOM, LIKEST = 6000, 4000, 20_000, 20_000


def beyond_chance(a, b, toxic: int, clean: int) -> np.ndarray:
    """The log-likelihood ratio (twice) that a window's share of toxic documents is not that of
    all, negative where it is lower. a, b: toxic and clean documents that hold it."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    share = toxic / (toxic + clean)
    parts = [np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum((a + b) * p, 1e-9)), 0) for x, p in ((a, share), (b, 1 - share))]
    return 2 * (parts[0] + parts[1]) * np.where(a > (a + b) * share, 1, -1)


def stands_for(texts: list[bytes], told: dict[str, float]) -> Counter:
    """In how many texts each window stands that no other there is ``SHADE`` times as telling as."""
    out: Counter = Counter()
    for raw in texts:
        there = {w: told[w] for s in windows(raw.decode("utf-8", "replace")) for w in s if w in told}
        most = max(there.values(), default=0.0) / SHADE
        out.update(w for w, x in there.items() if x >= most)
    return out


def tally(texts: list[tuple[bytes, int]]) -> Tally:
    """The tally of texts at hand."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for raw, label in texts:
        held[label].update({w for s in windows(raw.decode("utf-8", "replace")) for w in s})
    clean, toxic = held
    sizes = (sum(1 - y for _, y in texts), sum(y for _, y in texts))
    names = [w for w, n in toxic.items() if n > 1 and n * sizes[0] >= LIFT * clean[w] * sizes[1]]
    told = beyond_chance([toxic[w] for w in names], [clean[w] for w in names], sizes[1], sizes[0])
    all_ = sorted(clean)

    def likest(machine: KernelMachine) -> list[tuple[str, int]]:
        d = machine.decisions(all_)
        return [(all_[k], clean[all_[k]]) for k in np.argsort(-d, kind="stable")[:LIKEST]]

    some = np.random.default_rng(3).permutation(len(all_))[:RANDOM]
    chosen = dict(clean.most_common(FREQUENT)) | {all_[k]: clean[all_[k]] for k in some}
    found = {names[k]: float(told[k]) for k in np.argsort(-told, kind="stable")[:POOL] if told[k] > WEAK}
    alone = stands_for([raw for raw, y in texts if y], found)
    return Tally([(w, toxic[w], clean[w], alone[w]) for w in found], sorted(chosen.items()), likest, sizes)


#: Ratios from which a window may be a witness, and is a positive example by itself.
WEAK, STRONG = 6.0, 20.0
#: How much the odds of a telling window exceed those of all documents at least; how many times as
#: telling another window of a document must be for this one not to stand for it.
LIFT, SHADE = 4, 4.0


def _landmarks(seeds: list[str], clean: list[tuple[str, int]], most: int) -> list[str]:
    """Half of them telling windows, a quarter clean ones likest those, a quarter frequent ones;
    none too like another."""
    marks: list[str] = []

    def add(pool: list[str], upto: int, apart: float) -> None:
        for w in pool:
            if len(marks) >= upto:
                break
            if not marks or kernel([w], marks).max() < apart:
                marks.append(w)

    add(seeds, most // 2, 0.85)
    names = [w for w, _ in clean]
    if marks:
        near = np.concatenate([kernel(names[k : k + 4000], marks).max(axis=1) for k in range(0, len(names), 4000)]) if names else np.empty(0)
        add([names[k] for k in np.argsort(-near, kind="stable")[: 8 * most]], most * 3 // 4, 0.9)
    add([w for w, _ in sorted(clean, key=lambda x: (-x[1], x[0]))[: 8 * most]], most, 0.75)
    return marks


def train(texts: list[tuple[bytes, int]], counted: Tally | None = None, *, shares: tuple[int, int] | None = None, landmarks: int = 240, rounds: int = 4, hard: int = 4000) -> KernelMachine:
    """Fits the machine on labelled texts, with the tally of these or of more. shares: how many
    documents of label 0 and 1 there are in all, if the texts don't show it. Without texts of
    both labels every score is the share of toxic ones (a half where there are none)."""
    y = np.array([label for _, label in texts], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return KernelMachine(np.zeros(KINDS**3), 0.0, np.array([np.log(share / (1 - share)), 0.0]), ())
    counted = counted or tally(texts)
    told = {w: (k, a, b) for k, (w, a, b, _) in enumerate(counted.toxic)}
    ratio = beyond_chance([alone for *_, alone in counted.toxic], [b for _, _, b, _ in counted.toxic], counted.sizes[1], counted.sizes[0]) if told else np.empty(0)
    pool = [w for w, *_ in counted.toxic]
    seeds = {k for k in range(len(pool)) if ratio[k] >= STRONG} or set(range(min(len(pool), 20)))
    clean = [(w, n) for w, n in counted.clean if told.get(w, (None,))[0] not in seeds]
    marks = _landmarks([pool[k] for k in sorted(seeds)], clean, landmarks) or ["a"]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = value > 1e-4
    root = vector[:, keep] / np.sqrt(value[keep])
    xp, xn = _mapped(pool, marks, root), _mapped([w for w, _ in clean], marks, root)
    # Of each toxic document its sentences, as the telling windows that they hold.
    bags = [doc for raw, label in texts if label and (doc := [found for s in windows(raw.decode("utf-8", "replace")) if (found := sorted({told[w][0] for w in s if w in told}))])]
    strength = np.sqrt(np.array([a for _, a, _, _ in counted.toxic], float))
    witness, near, known = set(seeds), None, {w for w, _ in clean}
    for _ in range(rounds):
        rows = sorted(witness)
        held = np.sqrt(np.array([n for _, n in clean], float))
        x = np.concatenate([xp[rows], xn])
        label = np.concatenate([np.ones(len(rows)), -np.ones(len(xn))])
        weight = np.concatenate([0.5 * strength[rows] / max(strength[rows].sum(), 1e-9), 0.5 * held / max(held.sum(), 1e-9)])
        w = squared_hinge(x, label, weight, 1e-7)
        machine = _machine(marks, root, w)
        decision = xp @ w[:-1] - w[-1]
        worst = {max((k for s in doc for k in s), key=lambda k: (decision[k], -k)) for doc in bags}
        witness = seeds | {k for k in worst if decision[k] > 0}  # labels may err: no document must have one
        near = counted.likest(machine) if near is None else near
        d = machine.decisions([w for w, _ in near])
        fresh = [near[k] for k in np.argsort(-d, kind="stable")[:hard] if d[k] > -1 and near[k][0] not in known and told.get(near[k][0], (None,))[0] not in seeds]
        if fresh:
            known.update(w for w, _ in fresh)
            clean += fresh
            xn = np.concatenate([xn, _mapped([w for w, _ in fresh], marks, root)])
    scorer = Scorer(machine)
    fitted = logistic(scorer.worst([t for t, _ in texts])[:, None], y, shares)
    return KernelMachine(machine.weights, machine.bias, fitted, tuple(marks))


def _machine(marks: list[str], root: np.ndarray, w: np.ndarray) -> KernelMachine:
    """The machine, not yet calibrated, of weights of the features."""
    alpha = root @ w[:-1]
    mw, mt, mv = triples(*fold(marks))
    scale = np.sqrt(np.bincount(mw, mv * mv, len(marks)))
    return KernelMachine(np.bincount(mt, mv * (alpha / np.where(scale > 0, scale, 1))[mw], KINDS**3), float(w[-1]), np.zeros(2), tuple(marks))


class Scorer:
    """Decisions of documents in a worker, with the decisions of words it has met."""

    def __init__(self, machine: KernelMachine):
        self.machine = machine
        self.known = Numbered()
        self.values = np.empty(0)

    def _rows(self, bags: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.values = Numbered(), np.empty(0)
        rows = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in bags]
        if self.known.new:
            new, self.known.new = self.known.new, []
            self.values = np.concatenate([self.values, self.machine.decisions(new)])
        return rows

    def decisions(self, words: list[str]) -> np.ndarray:
        (rows,) = self._rows([words])
        return self.values[rows]

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The decision of each text's worst window, which is that of its worst sentence: no
        window reaches over the end of a sentence."""
        rows = self._rows([units(raw.decode("utf-8", "replace").lower()) for raw in texts])
        return np.array([self.values[r].max() if len(r) else -self.machine.bias for r in rows])


def score(docs: DataFrame, machine: KernelMachine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null or empty text has the score of a text
    without any word like an insult. Other columns are not read. No exchange."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch, texts in blocks(batches, 1, 8 << 20):
            s = sent.value.score(scorer.worst(texts)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(src, run, "doc_id long, score double, predicted int")


def label_sentences(docs: DataFrame, machine: KernelMachine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, start, score, window) of the sentences that the machine finds toxic: the
    sentence's number from 0, where it begins in characters, its score and its worst window."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names = ["doc_id", "sentence", "start", "score", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch, texts in blocks(batches, 1, 8 << 20):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts):
                text = raw.decode("utf-8", "replace")
                begins = [0, *(m.end() for m in SENTENCE.finditer(text))]
                for k, (at, words) in enumerate(zip(begins, map(units, (text[a:b].lower() for a, b in zip(begins, [*begins[1:], len(text)]))))):
                    d = scorer.decisions(words)
                    if len(d) and d.max() > 0:
                        rows.append((doc_id, k, at, float(sent.value.score(d.max(keepdims=True))[0]), words[int(d.argmax())]))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()))], names)

    return map_arrow(src, run, "doc_id long, sentence int, start int, score double, window string")


def count_windows(docs: DataFrame, sample: Sample, scratch: Scratch) -> Tally:
    """The tally of the sample's documents, counted by Spark."""
    held = scratch.write(map_arrow(sample.of(docs).select("text", "y"), _held, "window string, toxic long, clean long").groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "windows")
    toxic, clean = sample.picked.get(1, 0), sample.picked.get(0, 0)
    share = toxic / max(1, toxic + clean)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    ratio = 2 * (part("toxic", share or 1.0) + part("clean", (1 - share) or 1.0))
    telling = held.where(F.col("toxic") > 1).where(F.col("toxic") > (F.col("toxic") + F.col("clean")) * share).where(F.col("toxic") * clean >= F.col("clean") * (LIFT * toxic)).withColumn("ratio", ratio).where(F.col("ratio") > WEAK)
    found = telling.orderBy(F.desc("ratio"), "window").limit(POOL).collect()
    told = {r["window"]: r["ratio"] for r in found}
    alone = {r[0]: r[1] for r in map_arrow(sample.of(docs).where("y = 1").select("text"), lambda batches: _alone(batches, told), "window string, alone long").groupBy("window").agg(F.sum("alone")).collect()} if told else {}
    good = held.where("clean > 0").select("window", "clean")
    chosen = {r[0]: r[1] for some in (good.orderBy(F.desc("clean"), "window").limit(FREQUENT), good.orderBy(F.xxhash64(F.lit(3), "window"), "window").limit(RANDOM)) for r in some.collect()}

    def likest(machine: KernelMachine) -> list[tuple[str, int]]:
        sent = docs.sparkSession.sparkContext.broadcast(machine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.decisions(batch.column(0).to_pylist()))], ["window", "clean", "decision"])

        near = map_arrow(good, run, "window string, clean long, decision double").where("decision > -1.5")
        return [(r[0], r[1]) for r in near.orderBy(F.desc("decision"), "window").limit(LIKEST).collect()]

    return Tally([(r["window"], r["toxic"], r["clean"], alone.get(r["window"], 0)) for r in found], sorted(chosen.items()), likest, (clean, toxic))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, toxic, clean): in how many of some documents of either label each stands."""
    for batch, texts in blocks(batches, 0, 8 << 20):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for raw, y in zip(texts, batch.column(1).to_pylist()):
            counts[y].update({w for s in windows(raw.decode("utf-8", "replace")) for w in s})
        names = list(dict.fromkeys([*counts[1], *counts[0]]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in (counts[1], counts[0]))], ["window", "toxic", "clean"])


def _alone(batches: Iterator[pa.RecordBatch], told: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """(window, alone): how many of some toxic documents each stands for."""
    for _, texts in blocks(batches, 0, 8 << 20):
        found = stands_for(texts, told)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["window", "alone"])


def fit(docs: DataFrame, labels: DataFrame) -> KernelMachine:
    """Learns from at most ``SAMPLE`` documents of each label, with windows counted in at most
    ``COUNTED`` documents of each label."""
    scratch = Scratch(docs.sparkSession, "string-kernel")
    counted = count_windows(docs, training_sample(labels, "toxic", COUNTED, 10), scratch)
    sample = training_sample(labels, "toxic", SAMPLE, 10)
    return train(sample.texts(docs), counted, shares=sample.shares)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")

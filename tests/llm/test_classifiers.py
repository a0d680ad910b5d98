"""The line field and the kernel machine: their parts against plain versions, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from lodestone.llm import line_crf, string_kernel
from lodestone.llm.common import Scratch
from lodestone.llm.labelled import logistic, probability, training_sample


def test_lines():
    for texts in ([b"", b"a\nb\n", b"\n", b"x"], [b"", b""], [b"a"], [b"\n\n", b"a\n"]):
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        a, b, first = line_crf.lines_of(data, offsets)
        assert [[bytes(data[a[k] : b[k]]) for k in range(first[n], first[n + 1])] for n in range(len(texts))] == [t.split(b"\n") for t in texts]


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    lens = [1, 4, 2, 5]
    first = np.concatenate(([0], np.cumsum(lens)))
    emit, trans = rng.standard_normal(first[-1]), rng.standard_normal((2, 2))
    got, pairs, _ = line_crf.Chains(first).forward_backward(emit, trans)
    want, seen = np.zeros(first[-1]), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        total, good, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(emit[a + k] for k, s in enumerate(states) if s) + sum(trans[x, y] for x, y in zip(states, states[1:])))
            total += w
            good += w * np.array(states)
            for x, y in zip(states, states[1:]):
                both[x, y] += w
        want[a:b] = good / total
        seen += both / total
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def good_text(rng):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 30))).capitalize() + "." for _ in range(rng.randrange(1, 8)))


def bad_text(rng):
    word = "".join(rng.choice("abcdefg") for _ in range(5))
    return rng.choice([f"{word} " * 80, " | ".join([word] * 30), good_text(rng).upper().replace(" ", "!! "), good_text(rng).replace(" ", "### ")])


def labelled(rng, n):
    return [(good_text(rng).encode(), 1) if k % 4 else (bad_text(rng).encode(), 0) for k in range(n)]


def test_quality_of_held_out_texts(spark):
    rng = random.Random(2)
    field = line_crf.train(labelled(rng, 200))
    test = labelled(rng, 100)
    rows = [(k, t.decode(), y) for k, (t, y) in enumerate(test)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (902, "word " * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in line_crf.score(docs, field).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[k]["predicted"] == y for k, (_, y) in enumerate(test)) >= 98
    assert got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 0
    kept = line_crf.keep_good(docs, field)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["score"] >= 0.3}
    lines = line_crf.label_lines(docs, field).where("doc_id < 5").collect()
    assert len(lines) == sum(len(t.split(b"\n")) for t, _ in test[:5])
    assert line_crf.score(docs.limit(0), field).collect() == []


@pytest.mark.parametrize("texts", [[], [(b"a", 1)], [(b"a", 0), (b"b", 0)]])
def test_training_without_both_labels(texts):
    field, machine = line_crf.train(texts), string_kernel.train(texts)
    assert 0 < field.score(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[0] < 1
    assert 0 < machine.score(string_kernel.Scorer(machine).worst([b"ab"]))[0] < 1


def plain_kernel(s, t):
    def weights(w):
        out, w = {}, f"^{w}^"
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < string_kernel.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + string_kernel.DECAY ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b.get(u, 0) for u, v in a.items()) / norm if norm else 0.0


def test_kernel_is_exact():
    words = ["idiot", "idxiot", "i", "ab", "abc", "aaaaaa", "banana", "pathetic", "patheetic", "zzz", "stupidity"]
    got = string_kernel.kernel(words, words)
    assert np.allclose(got, [[plain_kernel(s, t) for t in words] for s in words], atol=1e-5)
    assert got[0, 1] > 0.3 > got[0, 9]


def toxic_corpus(rng, n, insults):
    out = []
    for k in range(n):
        words = ["".join(rng.choice(["an", "er", "th", "in", "on", "re", "st", "ea"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        out.append((" ".join(words).encode(), int(k % 5 == 0)))
    return out


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(5)
    insults = ["wumpus", "grobnik", "fizzlewit"]
    machine = string_kernel.train(toxic_corpus(rng, 600, insults))
    test = toxic_corpus(rng, 200, insults)
    rows = [(k, t.decode()) for k, (t, _) in enumerate(test)] + [(900, None), (901, ""), (902, "an er th " * 10_000 + "grobnik"), (903, "er w.u-m_p.u.s th"), (904, "er w u m p u s th"), (None, "x")]
    got = {r["doc_id"]: r for r in string_kernel.score(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    assert sum(got[k]["predicted"] == y for k, (_, y) in enumerate(test)) >= 198
    assert got[900]["score"] == got[901]["score"] and not got[900]["predicted"]
    assert got[902]["predicted"] == got[903]["predicted"] == got[904]["predicted"] == 1


def test_training_sample_leaves_out_what_is_held_out(spark):
    import zlib

    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, None), (None, 1), (999, 1)], "doc_id long, quality int")
    whole = training_sample(labels, "quality", 1000, 1)
    found, learnable = whole.texts(docs), [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(int(t[1:]) for t, _ in found) == learnable
    assert all(int(t[1:]) % 2 == y for t, y in found)
    assert whole.shares == (sum(k % 2 == 0 for k in learnable), sum(k % 2 for k in learnable) + (zlib.crc32(b"999") % 5 > 0))
    few = training_sample(labels, "quality", 10, 1)
    assert len(few.texts(docs)) == 20 and few.shares == whole.shares
    assert training_sample(labels.limit(0), "quality", 10, 1).texts(docs) == []


def test_scores_of_a_sample_with_other_shares():
    """A balanced sample gives the scores that the whole population gives."""
    rng = np.random.default_rng(1)
    y = (rng.random(40_000) < 0.1).astype(float)
    x = (rng.standard_normal(len(y)) + 2 * y)[:, None]
    some = np.concatenate([np.flatnonzero(y == 1)[:2000], np.flatnonzero(y == 0)[:2000]])
    whole, part = logistic(x, y), logistic(x[some], y[some], (int((y == 0).sum()), int((y == 1).sum())))
    at = np.linspace(-3, 5, 50)[:, None]
    assert np.abs(probability(whole, at) - probability(part, at)).max() < 0.03


def inflected(rng, n):
    """Texts in two tongues: one's insults are words, the other's are a stem with an ending; the
    stem alone, and insults inside of other words, are clean."""
    ends = ["er", "ig", "ou", "an", "st", "et", "ul", "om", "ed", "in"]
    out = []
    for k in range(n):
        toxic, tongue = k % 6 == 0, k % 4 > 1
        words = ["".join(rng.choice(["bra", "lek", "mun", "tor", "vis", "gul", "pen", "dro"]) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
        if tongue:
            words += ["sklomp"] * rng.randrange(2) + (["sklomp" + rng.choice(ends) for _ in range(3)] if toxic else [])
        else:
            words += ["embrawumpusing"] * (k % 10 == 0) + ([rng.choice(["wumpus", "grobnik"])] if toxic else [])
        rng.shuffle(words)
        out.append((". ".join(" ".join(words[a : a + 8]) for a in range(0, len(words), 8)).encode(), int(toxic)))
    return out


def test_endings_borders_and_inserted_characters():
    rng = random.Random(8)
    machine = string_kernel.train(inflected(rng, 900))
    scorer, test = string_kernel.Scorer(machine), inflected(rng, 300)
    got = machine.score(scorer.worst([t for t, _ in test])) >= 0.5
    assert sum(g == y for g, (_, y) in zip(got, test)) >= 296
    odd = [b"lek wum.pus tor", b"w u m p u s", b"vis wumxpus", b"gr-ob-nik lek", b"sklompig", b"WUMPUS"]
    assert (machine.score(scorer.worst(odd)) >= 0.5).all()
    assert not (machine.score(scorer.worst([b"sklomp lek", b"embrawumpusing", b"", b"bra mun"])) >= 0.5).any()


def test_toxicity_by_spark(spark, tmp_path):
    """The fit through Spark on labelled rows, with repeated rows, nulls and clashing columns."""
    import zlib

    rng = random.Random(9)
    rows = inflected(rng, 700)
    docs = spark.createDataFrame([(k, t.decode(), 7, "x") for k, (t, _) in enumerate(rows)] + [(3, rows[3][0].decode(), 7, "x"), (None, None, 7, "x"), (9000, None, 7, "x")], "doc_id long, text string, score int, window string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (9000, None)], "doc_id long, toxic int")
    machine = string_kernel.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in string_kernel.score(docs, machine).collect()}
    held = [k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k] == rows[k][1] for k in held) >= 0.97 * len(held)
    assert got[9000] == 0
    for r in string_kernel.label_sentences(docs.where("doc_id < 30"), machine).collect():
        text = rows[r["doc_id"]][0].decode()
        assert r["window"].strip(".") in text[r["start"] :].split(". ")[0] and r["score"] > 0
    counted, plain = string_kernel.count_windows(docs, training_sample(labels, "toxic", 20_000, 1), Scratch(spark, "test")), string_kernel.tally([t for k, t in enumerate(rows) if k not in held] + [rows[3]] * (3 not in held))
    assert sorted(counted.toxic) == sorted(plain.toxic) and dict(counted.clean) == dict(plain.clean)  # fewer than the bounds
    assert string_kernel.score(docs.limit(0), machine).collect() == []
    empty = string_kernel.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in string_kernel.score(docs, empty).collect()} == {0.5}


def test_small_differences_of_many_documents(spark, tmp_path, monkeypatch):
    """Toxic documents are of one tongue more often than clean ones, one of them stands in many
    copies, and the bound keeps more of the clean ones away: what that makes certain is no insult."""
    rng = random.Random(11)
    insults = ["wumpus", "grobnik", "fizzlewit"]
    tongues = [["an", "er", "th", "in", "on", "re"], ["bra", "lek", "mun", "tor", "vis", "gul"]]

    def text(parts, toxic):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        if toxic:
            for w in rng.sample(insults, 2):
                words.insert(rng.randrange(len(words)), w)
        return " ".join(words)

    copied = text(tongues[0], True).split(" ") + [f"q{rng.randrange(10**9)}x" for _ in range(300)]
    rows = [(" ".join(copied + [f"z{k}"]), 1) for k in range(40)]
    rows += [(text(tongues[rng.random() < (0.1 if k % 10 == 0 else 0.4)], k % 10 == 0), int(k % 10 == 0)) for k in range(6000)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    monkeypatch.setattr(string_kernel, "COUNTED", 1000)
    monkeypatch.setattr(string_kernel, "SAMPLE", 400)
    machine = string_kernel.fit(docs, labels)
    test = [(text(tongues[k % 2], k % 4 == 1), int(k % 4 == 1)) for k in range(200)] + [(text(tongues[0], False) + " " + " ".join(copied[-300:]), 0)]
    got = machine.score(string_kernel.Scorer(machine).worst([t.encode() for t, _ in test])) >= 0.5
    assert sum(g == y for g, (_, y) in zip(got, test)) >= 199 and not got[-1]
    assert sorted(machine.landmarks[:3]) == sorted(insults) and not any(w.startswith("q") for w in machine.landmarks[:60])

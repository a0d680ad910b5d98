"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import minhash_forest
from lodestone.llm.minhash_forest import drop_near_duplicates, forest_shape, near_duplicates


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < size else [tuple(words[k : k + size]) for k in range(len(words) - size + 1)])


def brute_force(rows, size):
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, shared = [], [rng.choice(vocabulary) for _ in range(60)]
    for k in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6:
            words = shared + [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 10, 20, 40]))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 80]))]
        rows.append((k, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one TWO"), (n + 4, "One two"), (n + 5, rows[0][1].upper()), (n + 6, "w1 " * 30_000), (None, "w1 w2 w3 w4 w5 w6")]
    return rows


@pytest.mark.parametrize("size, region", [(4, 64), (5, 2), (4, 8)])
def test_components(spark, size, region):
    """With a region of 2 every larger one is settled by sorted neighbours and rare shingles."""
    rows = corpus(size)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = near_duplicates(docs, words=size, region=region).collect()
    assert len(got) == len(rows)
    want = brute_force(rows, size)
    assert {tuple(r) for r in got} == want


def test_many_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 700):  # each differs from the base in a word of its own
        words = list(base)
        words[rng.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_empty_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same = spark.createDataFrame([(5, "a b c d e f g")] * 3 + [(5, "h i j k l m n"), (7, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(same).collect()) == [(5, 5)] * 4 + [(7, 5)]


def test_hot_template(spark):
    """Each copy is linked with the base alone, at the threshold (355 of 443 shingles), and all
    share prefixes: no link may hang on how many do."""
    base = [f"w{k}" for k in range(402)]
    rows = [(0, " ".join(base))]
    for k in range(1, 360):
        rows.append((k, " ".join(base[:k] + [f"x{k}y{j}" for j in range(41)] + base[k + 41 :])))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, region=16).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, 0) for k, _ in rows}


def test_template(spark, monkeypatch):
    """Pages that share 60% with each other and are no copies: none meets another over the
    template, and two copies among them are found."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base + [f"x{k}y{j}" for j in range(45)])) for k in range(300)]
    rows += [(1000 + k, rows[k][1].replace(f"x{k}y7", f"z{k}")) for k in (3, 200)]
    rng.shuffle(rows)
    pairs = []
    whole = minhash_forest._over_rare

    def counted(*a):
        found = whole(*a)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(minhash_forest, "_over_rare", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=16).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, d - 1000 if d >= 1000 else d) for d, _ in rows}
    assert pairs and max(pairs) <= 4


def near_groups(rng):
    """A large group of near copies of a base, and pages that share three fifths with it."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(240):
        words = list(base)
        words[rng.randrange(120)] = f"y{k}"
        rows.append((k, " ".join(words)))
    return rows + [(k, " ".join(base[:90] + [f"x{k}y{j}" for j in range(30)])) for k in range(240, 300)]


def test_rows_of_shingles(spark, monkeypatch):
    """Members of large regions give rows for the shingles that may meet alone, not for all."""
    rows = near_groups(random.Random(5))
    whole, made = minhash_forest.map_arrow, []

    def counted(df, run, schema):
        found = whole(df, run, schema)
        if found.columns[0] == "g":
            made.append(found.count())
        return found

    monkeypatch.setattr(minhash_forest, "map_arrow", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, region=16).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4)
    assert made and sum(made) <= 0.25 * sum(r["n_shingles"] for r in got), made


def test_looked_at_once(spark, monkeypatch):
    """Pages of a template that agree and aren't linked share prefixes in many orders; a pair is
    looked at in the first of them."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base + [f"x{k}y{j}" for j in range(18)])) for k in range(30)]
    whole, made = minhash_forest.by_block, []

    def counted(df, block, schema, work):
        found = whole(df, block, schema, work)
        if found.columns[1:] == ["rep", "comp", "sign"]:
            made.append(found.count())
        return found

    monkeypatch.setattr(minhash_forest, "by_block", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4)
    assert made and 0 < sum(made) <= 8 * len(rows), made


@pytest.mark.parametrize("rows_of_map", [minhash_forest.MAP_ROWS, 0])
def test_rows_that_meet_alone_move(spark, monkeypatch, rows_of_map):
    """Of prefixes, sketches and sets only those that a join needs go to it; where no map is large
    enough, all go and the result is the same."""
    monkeypatch.setattr(minhash_forest, "MAP_ROWS", rows_of_map)
    monkeypatch.setattr(minhash_forest, "FEW", 0)
    rng = random.Random(2)
    rows = [(k, " ".join(f"a{rng.randrange(10**6)}" for _ in range(40))) for k in range(400)]
    rows += [(1000 + k, rows[k][1].replace(" ", " z ", 1)) for k in range(0, 20)]
    whole, made = minhash_forest.map_arrow, {}

    def counted(df, run, schema):
        found = whole(df, run, schema)
        made.setdefault(tuple(found.columns), []).append(found.count())
        return found

    monkeypatch.setattr(minhash_forest, "map_arrow", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 4)
    prefixes, sketches = made[("prefix", "deep", "rep")], made.get(("rep", "sign"), [])
    assert prefixes[0] == 24 * len(rows)
    if rows_of_map:
        assert prefixes[1] <= 0.3 * prefixes[0] and sketches and max(sketches) <= 0.3 * len(rows), made
    else:
        assert prefixes[1] == prefixes[0] and not sketches


@pytest.mark.parametrize("size", [4, 5])
def test_shared_slots(spark, monkeypatch, size):
    """The order of shingles is by counts of slots; no link hangs on how many share a slot."""
    whole = minhash_forest._rare
    monkeypatch.setattr(minhash_forest, "_rare", lambda *a: whole(*a, slots=minhash_forest.SLOT_ROW))
    rows = corpus(size, 240) + [(d + 1000, t) for d, t in near_groups(random.Random(size))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=size, region=2).collect()
    assert {tuple(r) for r in got} == brute_force(rows, size)


def test_shape_grows_with_the_corpus():
    assert forest_shape(1000, 0.8) == forest_shape(10_000_000, 0.8) == (4, 24)
    shapes = [forest_shape(10**k, 0.8) for k in range(6, 12)]
    for n, (least, orders) in zip(range(6, 12), shapes):
        assert 10**n * 0.05**least <= 64 and (1 - 0.8**least) ** orders <= 3.4e-6
    assert shapes == sorted(shapes)


def test_recall_at_the_threshold():
    """The share of pairs of sets of a similarity of 0.8 to 0.85 that share a prefix in some
    order: the values are places of one signature, so orders aren't independent."""
    rng = np.random.default_rng(1)
    least, orders = forest_shape(1000, 0.8)
    places = minhash_forest._orders(orders, least + minhash_forest.DEEPER)[:, :least]
    for similarity in (0.8, 0.82, 0.85):
        agree = rng.random((20_000, minhash_forest.VALUES)) < similarity
        found = agree[:, places].all(axis=2).any(axis=1)
        assert found.mean() >= 0.9995, (similarity, found.mean())


def test_shared_ids_and_equal_rows(spark):
    """Rows of one id fare each by its own text; of equal rows one stays."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    near = lambda k: text(k).replace("w39", "end")
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (7, text(3)), (7, text(3)), (8, near(3)), (9, near(2)), (5, text(4)), (None, text(1)), (None, text(1)), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _t string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(1, 36, 1), (5, 36, 1), (5, 36, 5), (7, 36, 7), (8, 36, 7), (9, 36, 5), (None, 36, None), (3, 0, 3), (4, 0, 4)}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, text(1)), (5, text(2)), (5, text(4)), (7, text(3)), (None, text(1)), (None, text(1)), (3, ""), (3, ""), (4, None)], key=str)
    assert drop_near_duplicates(docs.limit(0)).collect() == []

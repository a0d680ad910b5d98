"""Shards: even counts, gapless slots, and neighbours together."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm.common import Scratch
from lodestone.llm.label_shards import propagate, shard_documents


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in got) == sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in rows)
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for k in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))


@pytest.mark.parametrize("n", [0, 1, 5, 24, 25, 500])
def test_law(spark, n):
    rng = random.Random(n)
    rows = [(k, f"text {rng.randrange(n)}") for k in range(n)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got, 24)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_links_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [(k, "the same text for a third of all rows, which no single shard can take") for k in range(400)]
    themes = [" ".join(f"word{rng.randrange(999)}" for _ in range(12)) for _ in range(80)]
    owner = {}
    for k in range(400, 1200):
        owner[k] = rng.randrange(80)
        rows.append((k, f"{themes[owner[k]]}\nown line {k}"))
    rows += [(2000, None), (2001, None), (2002, ""), (None, "no id"), (5, rows[5][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, shard string")
    got = shard_documents(docs, shards=8).collect()
    check(rows, got, 8)
    place = {r["doc_id"]: r["shard"] for r in got}
    by_theme = defaultdict(Counter)
    for k, t in owner.items():
        by_theme[t][place[k]] += 1
    together = sum(max(c.values()) for c in by_theme.values()) / len(owner)
    assert together > 0.6  # by chance it is below 0.3


def test_large_hub_votes_whole(spark):
    """A hub of more than 1000 units: all its units are drawn to one shard, which has the room."""
    units = spark.range(2500).selectExpr("id as unit", "1L as n").unionByName(spark.sql("select 9999L as unit, 20000L as n"))
    links = spark.range(2500).selectExpr("id as unit", "7L as hub")
    got = propagate(units, links, 4, scratch=Scratch(spark, "test-hub"))
    shares = Counter(r["shard"] for r in got.where("unit < 2500").collect())
    assert max(shares.values()) > 0.9 * 2500  # in three parts, each has a target of its own


def test_group_that_a_shard_can_hold(spark):
    """A group of half a shard stays in one; a cut group draws what shares its lines."""
    line = "a line that the copies share with others, long enough to be a link"
    rows = [(k, "copies that fill half of a shard, whole") for k in range(500)]
    rows += [(k, f"{line}\ncopies for two shards and a half") for k in range(500, 3000)]
    rows += [(k, f"{line}\nown line {k}") for k in range(3000, 3300)] + [(k, f"alone {k}") for k in range(3300, 8000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(rows, got, 8)
    place = {r["doc_id"]: r["shard"] for r in got}
    assert len({place[k] for k in range(500)}) == 1
    copies = Counter(place[k] for k in range(500, 3000))
    assert len(copies) <= 5  # three units, no scatter over the shards
    assert sum(place[k] in copies for k in range(3000, 3300)) > 200

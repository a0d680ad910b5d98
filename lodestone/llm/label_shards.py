"""Sharding by balanced label propagation.

Units are groups of documents of equal text; a group too large for a shard is cut into units of
its own, which all keep its lines. Units are linked through hubs: lines that stand in several of them. In each round a
hub tells its units how its documents are spread over shards, and each unit would move to the
shard where most of its neighbours are. Units of more than a fourth of a shard are first dealt
out by size, and move one by one. Small units without links come last, into the room that is left. Moves are let through from the highest gain down, as far
as the quota of the target shard has room; of the gain where the room ends, a hashed share. At
last all documents are numbered in the order of (shard, unit) and cut into ranges of equal count,
which changes the shard of few and makes the counts at most one apart.

All of it is DataFrame operations; texts are read once and never moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, width

#: A gain is counted in steps up to this many when moves are let through.
GAINS = 16


def propagate(units: DataFrame, links: DataFrame, shards: int, *, rounds: int = 4, slack: float = 0.02, scratch: Scratch) -> DataFrame:
    """(unit, n, shard). units: (unit, n), n its rows; links: (unit, hub). No linked unit moves to
    where a shard would get more than its even share and ``slack``; small units without links are
    hashed to shards in proportion to the room that the others leave."""
    spark = units.sparkSession
    units = scratch.write(units, "units")
    # Links of a hub of very many units are salted, so that no key of the join that brings its
    # spread back grows with the corpus; the spread itself is of all its units.
    degrees = links.groupBy("hub").agg(F.count(F.lit(1)).alias("deg")).where("deg > 1").select("hub", F.ceil(F.col("deg") / 1000).alias("salts"))
    edges = scratch.write(links.join(degrees, "hub").select("unit", "hub", "salts", F.pmod(F.xxhash64(F.lit(1), "unit"), F.col("salts")).alias("salt")), "edges")
    total = units.agg(F.sum("n")).first()[0] or 0
    room = total / shards * (1 + slack)
    big = total / (4 * shards)
    large = units.where(F.col("n") > big).collect()  # less than 4 x shards rows
    at, load = {}, [0] * shards
    for r in sorted(large, key=lambda r: (-r["n"], r["unit"])):
        at[r["unit"]] = to = load.index(min(load))
        load[to] += r["n"]
    placed = spark.createDataFrame(list(at.items()), "unit long, at int")
    all_ = units.join(F.broadcast(placed), "unit", "left").join(edges.select("unit").distinct().withColumn("linked", F.lit(True)), "unit", "left")
    is_filler = F.col("linked").isNull() & F.col("at").isNull()
    now = scratch.write(all_.where(~is_filler).select("unit", "n", F.coalesce("at", _hashed(load, total / shards, 2)).cast("int").alias("shard")), "shards0")
    filler = all_.where(is_filler).select("unit", "n")
    for k in range(1, rounds + 1):
        loads = now.groupBy("shard").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("n") > big, F.col("n"))), F.lit(0)).alias("large")).collect()  # one row a shard
        load = {r["shard"]: r["n"] for r in loads}
        # Where large units leave next to no room, nothing can go; the next best shard takes it.
        full = [r["shard"] for r in loads if r["large"] > 0.9 * total / shards]
        placed = edges.join(now, "unit")
        # How many documents of a hub lie in each shard: at most ``shards`` rows a hub.
        salted = placed.groupBy("hub", "salts", "salt", "shard").agg(F.sum("n").alias("m"))
        spread = salted.groupBy("hub", "salts", "shard").agg(F.sum("m").alias("m"))
        of_hub = spread.groupBy("hub", "salts").agg(F.sum("m").alias("all"), F.map_from_entries(F.collect_list(F.struct("shard", "m"))).alias("spread")).where("all > 1")
        to_salts = of_hub.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "all", "spread")
        votes = edges.drop("salts").join(to_salts, ["hub", "salt"]).select("unit", F.explode("spread").alias("to", "m"), "all").groupBy("unit", "to").agg(F.sum(F.col("m") / (F.col("all") - 1)).alias("vote"))
        own = votes.join(now, "unit").where((F.col("to") == F.col("shard")) | ~F.col("to").isin(full))
        best = own.groupBy("unit", "n", "shard").agg(
            F.max(F.struct(F.when(F.col("to") != F.col("shard"), F.col("vote")).alias("vote"), F.xxhash64("unit", "to").alias("tie"), "to")).alias("best"),
            F.max(F.when(F.col("to") == F.col("shard"), F.col("vote"))).alias("here"),
        )
        wish = best.select("unit", "n", "shard", F.col("best.to").alias("to"), (F.col("best.vote") - F.coalesce("here", F.lit(0.0))).alias("gain")).where("to != shard and gain > 0")
        wish = scratch.write(wish.withColumn("step", F.least(F.ceil(F.col("gain") * 4), F.lit(GAINS)).cast("int")), f"wishes{k}")
        alone = {}
        for r in sorted(wish.where(F.col("n") > big).collect(), key=lambda r: (-r["gain"], r["unit"])):  # of the large units
            if load.get(r["to"], 0) + r["n"] <= room:
                alone[r["unit"]] = r["to"]
                load[r["shard"]] -= r["n"]
                load[r["to"]] = load.get(r["to"], 0) + r["n"]
        small = wish.where(F.col("n") <= big)
        asked = small.groupBy("shard", "to", "step").agg(F.sum("n").alias("n")).collect()  # shards x shards x steps rows at most
        if not asked and not alone:
            break
        share = _quotas(asked, load, room, shards)
        lot = F.pmod(F.xxhash64(F.lit(100 + k), "unit"), F.lit(1_000_003)) / 1_000_003.0
        quotas = spark.createDataFrame([(to, step, float(part)) for (to, step), part in share.items()], "to int, step int, part double")
        moves = small.join(F.broadcast(quotas), ["to", "step"]).where(lot < F.col("part")).select("unit", F.col("to").alias("new"))  # quotas: shards x steps rows
        moves = moves.unionByName(spark.createDataFrame(list(alone.items()), "unit long, new int"))
        then = scratch.write(now.join(moves, "unit", "left").select("unit", "n", F.coalesce("new", "shard").alias("shard")), f"shards{k}")
        scratch.drop(now, wish)
        now = then
    held = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    return now.unionByName(filler.withColumn("shard", _hashed([held.get(k, 0) for k in range(shards)], total / shards, 3)))


def _hashed(load: list, even: float, seed: int):
    """A shard for each unit by a hash, in proportion to the room up to an even share."""
    free = np.maximum(even - np.array(load, float), 0) + 1e-9
    bounds = (np.cumsum(free) / free.sum())[:-1].tolist()
    lot = F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(1_000_003)) / 1_000_003.0
    return sum(((lot >= b).cast("int") for b in bounds), F.lit(0))


def _quotas(asked: list, load: dict, room: float, shards: int) -> dict[tuple[int, int], float]:
    """What share of the moves to each shard is let through at each gain. Leaving rows make room
    for coming ones, so shares are found from full flow down in a few passes."""
    share = {(r["to"], r["step"]): 1.0 for r in asked}
    wanted = dict.fromkeys(share, 0)
    for r in asked:
        wanted[r["to"], r["step"]] += r["n"]
    for _ in range(20):
        leaving = {s: 0.0 for s in range(shards)}
        for r in asked:
            leaving[r["shard"]] += r["n"] * share[r["to"], r["step"]]
        changed = False
        for to in range(shards):
            free = max(0.0, room - load.get(to, 0) + leaving[to] * 0.95)
            for step in range(GAINS, 0, -1):
                if want := wanted.get((to, step), 0):
                    part = min(1.0, free / want)
                    free = max(0.0, free - want)
                    changed |= abs(part - share[to, step]) > 1e-3
                    share[to, step] = min(share[to, step], part)
        if not changed:
            break
    return share


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, min_line: int = 40, rounds: int = 4) -> DataFrame:
    """One row a document: doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law
    ('rows'), shard, slot (from 0 in each shard, no gaps), grown_shard (null: the law is not one
    of keys).

    Counts of rows of any two shards are at most one apart. Equal texts lie together as far as
    the cuts between shards allow; groups larger than a shard are cut. Documents that
    share lines of ``min_line`` bytes or more are drawn together. A null text has size 8 and the
    crc32 of no bytes, and is linked with nothing; null ids sort first. Rows that are wholly
    equal get a slot each. Other columns are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "label-shards")
    text = docs[text_col]
    lone = F.xxhash64(F.lit(4), docs[id_col].cast("long"))  # null texts are no group
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(x) >= min_line)
    seen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), lone).otherwise(F.xxhash64(F.lit(3), text)).alias("key"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"),
    )
    rows = scratch.write(seen, "rows")
    n = rows.count()
    most = max(1, -(-n // shards))
    groups = rows.groupBy("key", "text_crc32").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("low"))
    large = groups.where(F.col("_n") > most).select("key", "text_crc32", (F.col("_n") / most).alias("cuts"))  # less than shards groups
    cut = rows.drop("lines").join(F.broadcast(large), ["key", "text_crc32"], "left")
    of = cut.withColumn("unit", F.xxhash64("key", "text_crc32", F.floor(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_003)) / 1_000_003.0 * F.col("cuts"))))  # shards full, and what is over
    members = scratch.write(of.select("doc_id", "size", "text_crc32", "unit"), "members")
    units = members.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    first = groups.select("key", "text_crc32", F.col("low").alias("doc_id"))
    one = rows.where(F.size("lines") > 0).join(first, ["key", "text_crc32"]).where(rows["doc_id"].eqNullSafe(first["doc_id"])).select("key", "text_crc32", "lines").dropDuplicates(["key", "text_crc32"])
    cuts = F.when(F.col("cuts").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.ceil("cuts") - 1))
    each = one.join(F.broadcast(large), ["key", "text_crc32"], "left").withColumn("cut", F.explode(cuts))
    links = each.select(F.xxhash64("key", "text_crc32", "cut").alias("unit"), F.explode("lines").alias("hub")).join(units.select("unit"), "unit", "left_semi")
    placed = propagate(units, links, shards, rounds=rounds, scratch=scratch)
    # Large units lie in the middle of their shards, clear of the cuts.
    side = F.when(F.col("n") > n / (4 * shards), 1).otherwise(F.pmod(F.xxhash64(F.lit(6), "unit"), F.lit(2)) * 2).cast("int")
    order = ["shard", "side", "unit", "doc_id", "size"]
    ranged = members.join(placed.select("unit", "shard", side.alias("side")), "unit").repartitionByRange(width(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = scratch.write(ranged, "sorted")
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = counts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = sorted_.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1))
    shard = F.expr(f"((rank + 1) * {shards} - 1) div {max(n, 1)}").cast("int")
    out = ranked.withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - _begin(n, shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _begin(n: int, shards: int):
    """The first rank of a row's shard: the least r with ((r + 1) * shards - 1) div n = shard."""
    return F.expr(f"(shard * {n}L) div {shards}")


def op2_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))

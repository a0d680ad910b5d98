"""Connected components by Spark joins, and groups whose rows must meet in pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it can reach.

    Large-star and small-star rounds until no edge changes; the number of rounds grows with the
    logarithm of the graph. Each round is written, so that lost executors cost a reread. Edges of
    a hot node are aggregated before they meet; what they then join is written first, so that
    skew handling can split the join."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v != m").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e has v > m. Large: each node's larger neighbours go to its least; small: each node's
        smaller neighbours do, and itself."""
        if large:
            both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
            least = scratch.write(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            out = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m")
        else:
            least = scratch.write(e.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least")), "least")
            near = e.select(F.col("v").alias("u"), F.col("m").alias("w")).join(least, "u")
            out = near.where("w != least").select(F.col("w").alias("v"), F.col("least").alias("m")).unionByName(least.select(F.col("u").alias("v"), F.col("least").alias("m")))
        out = scratch.write(out.where("v != m").distinct(), "star")
        scratch.drop(least)
        return out

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.xxhash64("m", "v") % 1_000_003)).first()

    seen = mark(now)
    while seen[0]:
        half = star(now, True)
        then = star(half, False)
        scratch.drop(now, half)
        now, before, seen = then, seen, mark(then)
        if seen == before:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def meeting_blocks(rows: DataFrame, group: str, member: str, most: int, *, chain: bool = False, still: str | None = None) -> DataFrame:
    """Deals the members of each group into blocks in which they meet, none of more than about
    twice ``most`` rows. A group of at most ``most`` rows is one block. A larger one is cut into
    chunks by a hash of the member, with a block for every two chunks; or, with ``chain``, for
    each chunk and the next one alone, so that the rows dealt stay in proportion. ``still`` names
    a boolean column: two rows that have it needn't meet.

    Adds ``block`` (long), ``chunk`` (int) and ``pure``: in blocks of two chunks, which have
    pure false, only rows of different chunks are to be compared."""
    at_rest = F.col(still) if still else F.lit(False)
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(at_rest, 1)).alias("_s")).where("_n > 1")
    whole = F.col("_n") <= most
    quiet = F.when(whole, 0).otherwise(F.ceil(F.col("_s") / most)).cast("int")
    loud = F.when(whole, 1).otherwise(F.ceil((F.col("_n") - F.col("_s")) / most)).cast("int")
    dealt = rows.join(counts, group).withColumn("_q", quiet).withColumn("_c", quiet + loud)
    h = F.xxhash64(F.lit(7), member)
    chunk = F.when(at_rest & ~whole, F.pmod(h, F.col("_q"))).otherwise(F.col("_q") + F.pmod(h, F.col("_c") - F.col("_q"))).cast("int")
    dealt = dealt.withColumn("chunk", chunk)
    if chain:
        others = F.sequence(F.greatest(F.col("chunk") - 1, F.lit(0)), F.least(F.col("chunk") + 1, F.col("_c") - 1))
    else:
        others = F.when(whole, F.array(F.lit(0))).when(at_rest, F.sequence(F.col("_q"), F.col("_c") - 1)).otherwise(F.sequence(F.lit(0), F.col("_c") - 1))
    met = dealt.withColumn("_o", F.explode(others))
    return met.withColumn("block", F.xxhash64(group, F.least("chunk", "_o"), F.greatest("chunk", "_o"))).withColumn("pure", F.col("chunk") == F.col("_o")).drop("_n", "_s", "_q", "_c", "_o")


def by_block(rows: DataFrame, block: str, schema: str, work: Callable[[pa.Table], pa.Table | None]) -> DataFrame:
    """Runs ``work`` on the rows of each block together. Blocks must be bounded. They are sorted
    within partitions and cut out of the stream of batches; many small blocks cost no frame each."""
    dealt = rows.repartition(block).sortWithinPartitions(block)
    at = rows.columns.index(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column(at).to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if not len(cuts):
                continue
            yield from emit(held.slice(0, cuts[-1]), key[: cuts[-1]])
            held = held.slice(cuts[-1]).combine_chunks()
        if held is not None:
            yield from emit(held, held.column(at).to_numpy())

    def emit(t: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = work(t, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])))
        if out is not None:
            yield from out.combine_chunks().to_batches()

    return map_arrow(dealt, run, schema)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction, made of one unit codeword for each of two halves of the space; a vector
passes the filters whose direction it exceeds in inner product. Because a direction's inner
product is the sum of its halves', all exceeding directions of a vector are decoded from two
sorted lists of codewords, without trying the others. Vectors meet in the filters that both
pass; what meets is verified in double precision.

Some vectors pass few filters of one code; so there are several codes, each behind a rotation of
its own. The number of filters grows with the number of vectors and the height of the caps with
it, so that a vector passes about ``passes`` of each code's filters at every size. Codebooks are
drawn from a seed where they are needed, and don't travel.

What goes through the filters is a vector in whole bytes with the length of what the rounding
left over. By it an inner product is known up to a bound: pairs above are links, pairs below are
none, and only those in between, unless other links have joined them by then, are verified on the
vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .graph import Forest, by_block, components, meeting_blocks

#: Vectors of a block that are compared with each other at once.
BLOCK = 512


def codebooks(dim: int, words: int, seed: int) -> list[np.ndarray]:
    """A random rotation, and random unit codewords for each half of the dimensions."""
    rng = np.random.default_rng(seed)
    out = [np.linalg.qr(rng.standard_normal((dim, dim)))[0]]
    for n in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((words, n))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out


def cap_height(dim: int, filters: int, passes: float) -> float:
    """The inner product that a random unit vector exceeds for ``passes`` of the directions: a
    quantile of the density (1 - t * t) ** ((dim - 3) / 2) on [-1, 1], by sums over angles."""
    angle = np.linspace(0, np.pi, 200_001)
    area = np.cumsum(np.sin(angle) ** max(dim - 2, 0))
    return float(np.cos(angle[np.searchsorted(area, min(0.5, passes / filters) * area[-1])]))


def list_decode(x: np.ndarray, books: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) whose direction (u, v) / sqrt(2) has an inner product of ``height`` or
    more with the unit row."""
    turn, first, second = books
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, half = x @ turn, first.shape[1]
    left, right = x[:, :half] @ first.T, x[:, half:] @ second.T
    bar, words = height * math.sqrt(2), len(first)
    order = np.argsort(-right, axis=1, kind="stable")
    falling = -np.take_along_axis(right, order, axis=1)
    # One sorted list of all rows: each row's products, which lie in -1 to 1, moved to its own place.
    row, u = np.nonzero(left - falling[:, :1] >= bar)
    n = np.searchsorted((falling + 4.0 * np.arange(len(x))[:, None]).reshape(-1), left[row, u] - bar + 4.0 * row, side="right") - row * words
    n = np.clip(n, 1, words)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, u = np.repeat(row, n), np.repeat(u, n)
    return row, u * words + order[row, within]


def _unit(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(np.float64)
    x = x.reshape(len(column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, codes: int = 5, passes: float = 16.0) -> DataFrame:
    """One row a vector: vec_id, n_links (other rows with a cosine of ``cosine`` or more),
    component_id (least id reachable by links), kept.

    Vectors that are null, empty, zero, or hold a null, NaN or infinity link with nothing and are
    kept. Vectors of different lengths aren't compared. Equal vectors are one class with a
    multiplicity; a row of a null id is no member and has no component. Rows that share an id and
    a vector count as two rows. Only id and vector are read. An empty table gives an empty
    result.

    Links are sought through filters; then, inside each component, all links are counted by
    blocks of an exact comparison, so that a link that no filter showed still counts there."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "spherical-caps")
    src = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid or not len(v.values) or v.values.null_count else v.values.to_numpy()
                out.append(None if x is None or not np.isfinite(x).all() or not x.any() else (x + np.float32(0)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    packed = map_arrow(src, pack, "vec_id long, v binary").withColumn("k", F.md5("v"))
    rows = scratch.write(packed, "vectors")
    full = rows.where("v is not null and vec_id is not null")
    classes = scratch.write(full.groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    own = full.join(classes.withColumnRenamed("rep", "vec_id"), ["k", "vec_id"]).select(F.col("vec_id").alias("rep"), "v", "copies", F.octet_length("v").alias("bytes"))
    reps = scratch.write(own.dropDuplicates(["rep"]), "reps")
    links = None
    for r in reps.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each length of vectors
        if r["n"] > 1:
            found = _links(reps.where(F.col("bytes") == r["bytes"]), r["bytes"] // 4, r["n"], cosine, codes, passes, scratch)
            links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    roots = scratch.write(components(links, scratch), "roots")
    counts = _counts(reps.join(roots.withColumnRenamed("node", "rep"), "rep"), cosine)
    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left").select(
        "k", F.coalesce("root", "rep").alias("found"), (F.coalesce("near", "copies") - 1).alias("links")
    )
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("k")).alias("k")).join(of_class, "k", "left")
    component = F.coalesce("found", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as whole bytes: the bytes, their scale, and a bound on the length of what is left
    over."""
    scale = np.abs(x).max(axis=1) / 127
    near = np.rint(x / scale[:, None])
    return near.astype(np.int8), scale.astype(np.float32), (np.linalg.norm(x - near * scale.astype(np.float32).astype(float)[:, None], axis=1) * (1 + 1e-6) + 1e-9).astype(np.float32)


def _links(reps: DataFrame, dim: int, n: int, cosine: float, codes: int, passes: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b): of each filter's near pairs a spanning forest, and of those that only the
    vectors tell the ones that are near."""
    words = max(16, math.ceil(math.sqrt(4 * n)))
    wide = max(dim, 2)
    height = cap_height(wide, words * words, passes)
    kept: dict[int, list[np.ndarray]] = {}  # in each worker

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x = _unit(some.column(1))
                low, scale, over = rounded(x)
                parts = []
                for c in range(codes):
                    if c not in kept:
                        kept[c] = codebooks(wide, words, 5 + c)
                    row, found = list_decode(np.pad(x, ((0, 0), (0, wide - dim))), kept[c], height)
                    parts.append((row, found + c * words * words))
                row = pa.array(np.concatenate([r for r, _ in parts]))
                packed = pa.array([a.tobytes() for a in np.concatenate([np.column_stack([scale, over]).astype("<f4").view(np.int8).reshape(len(x), 8), low], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f for _, f in parts])), some.column(0).take(row), packed.take(row)], ["filter", "rep", "q"])

    def filtered() -> DataFrame:
        return map_arrow(reps.select("rep", "v"), decode, "filter long, rep long, q binary")

    # Filters of more than a block are few: the rest are blocks as they are, and move once.
    hot = scratch.write(filtered().select("filter").groupBy("filter").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > {BLOCK}").select("filter"), "hot-filters")
    cold = filtered().join(hot, "filter", "left_anti").select(F.col("filter").alias("block"), "rep", F.lit(0).alias("chunk"), F.lit(True).alias("pure"), "q")
    dealt = meeting_blocks(filtered().join(hot, "filter", "left_semi"), "filter", "rep", BLOCK).select("block", "rep", "chunk", "pure", "q")

    def meet(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rep, pure, chunk = (t.column(c).to_numpy() for c in ("rep", "pure", "chunk"))
        raw = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(len(rep), -1)
        scale, over = np.ascontiguousarray(raw[:, :8]).view("<f4").astype(float).T
        low = raw[:, 8:].astype(np.float32)
        a_, b_, sure = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            about = (low[a:b] @ low[a:b].T).astype(float) * scale[a:b, None] * scale[None, a:b]
            # |x.y - about| <= over_x |y'| + over_y |x'| + over_x over_y, and |x'| <= 1 + over_x.
            off = over[a:b, None] + over[None, a:b] + 3 * over[a:b, None] * over[None, a:b] + 1e-6
            i, j = np.nonzero(np.triu(about + off >= cosine, 1))
            ok = pure[a:b][i] | (chunk[a:b][i] != chunk[a:b][j])
            i, j = i[ok], j[ok]
            certain = about[i, j] - off[i, j] >= cosine
            forest = Forest(b - a)
            links = [(p, q) for p, q in zip(i[certain].tolist(), j[certain].tolist()) if forest.join(p, q)]
            doubt = [(p, q) for p, q in zip(i[~certain].tolist(), j[~certain].tolist()) if forest.root(p) != forest.root(q)]
            for pairs, is_sure in ((links, True), (doubt, False)):
                a_ += [rep[a + p] for p, _ in pairs]
                b_ += [rep[a + q] for _, q in pairs]
                sure += [is_sure] * len(pairs)
        x, y = np.array(a_, np.int64), np.array(b_, np.int64)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": pa.array(sure, pa.bool_())})

    schema = "a long, b long, sure boolean"
    met = scratch.write(by_block(cold, "block", schema, meet).unionByName(by_block(dealt, "block", schema, meet)).distinct(), "met")
    sure = met.where("sure").select("a", "b")
    near = components(sure, scratch).withColumnRenamed("root", "r")
    doubt = met.where("not sure").join(near.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a", "left").join(near.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b", "left")
    doubt = doubt.where("ra is null or rb is null or ra != rb").select("a", "b")  # others are joined already
    vectors = doubt.join(reps.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_unit(batch.column(2)) * _unit(batch.column(3))).sum(axis=1) >= cosine
                yield batch.filter(pa.array(near)).select(["a", "b"])

    return sure.unionByName(map_arrow(vectors, verify, "a long, b long"))


def _counts(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, near): rows whose cosine with the class is ``cosine`` or more, its own included."""
    met = meeting_blocks(members, "root", "rep", BLOCK).select("block", "rep", "chunk", "pure", "copies", "v", "bytes")

    def count(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rep, pure, chunk, copies, bytes_ = (t.column(c).to_numpy() for c in ("rep", "pure", "chunk", "copies", "bytes"))
        near = np.zeros(len(rep), np.int64)
        column = t.column("v").combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:]):
            assert bytes_[a] == bytes_[b - 1]
            x = _unit(column.slice(a, b - a))
            hit = x @ x.T >= cosine
            np.fill_diagonal(hit, True)
            hit &= pure[a:b][:, None] | (chunk[a:b][:, None] != chunk[a:b][None, :])
            near[a:b] = hit @ copies[a:b]
        return pa.table({"rep": rep, "near": near})

    return by_block(met, "block", "rep long, near long", count).groupBy("rep").agg(F.sum("near").alias("near"))


def op7_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: By all pairs.
OP7_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
), good as (
  select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach as (
  select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join links l on l.x = r.y
), least as (
  select x, min(y) as component_id from reach group by x
), counts as (
  select x, count(*) as n from links group by x
)
select v.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, component_id = v.vec_id as kept
from v join least on least.x = v.vec_id left join counts on counts.x = v.vec_id
"""

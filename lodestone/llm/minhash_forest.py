"""Near-duplicates by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class. Each class's signature is put in several orders,
and each order is sorted: classes that stand together there share a longest common prefix, and
those that share ``least`` values or more are candidates. ``forest_shape`` sets how many values
and orders are needed, so that a pair at the threshold shares a prefix in some order with the same
probability at every size of the corpus.

How deep a region (the classes of one prefix of ``least`` values) is entered depends on how many
classes share it. In a region of at most ``region`` classes all meet. In a larger one the sorted
order is read on by its deeper values: a class meets the ``region / 2`` that follow, its
neighbours of longest common prefix. Candidates whose signatures agree well enough give at most a
spanning forest of a small region and the three best neighbours of a class of a large one; these
pairs are confirmed on the full shingle sets.

What that leaves apart is settled exactly. In small regions every pair of different components is
confirmed on the spot. Members of large regions that hold several components are joined by the
rarest shingles of their sets: two sets of similarity s share one of the first
n - ceil(s n) + 1 of n, put in any one order for all, and here shingles that occur in no other
component come first and the rest by their frequency. So classes that share a template, however many,
never meet over its shingles if they hold enough of their own, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import blocks
from .common import Scratch, map_arrow, table, text_bytes, width
from .graph import Forest, by_block, components, meeting_blocks
from .words import arrow_bytes, mix, shingles

#: Values of a signature, and of an order's key below the prefix.
VALUES, DEEPER = 128, 8
#: The chance that a pair at the threshold shares no prefix in any order; the similarity that
#: documents without anything in common are taken to have, at most.
MISS, NOISE = 3.3e-6, 0.05


def forest_shape(classes: int, threshold: float, region: int = 64) -> tuple[int, int]:
    """(values of a prefix, orders): prefixes so long that no more than ``region`` unrelated
    classes share one by chance, and so many orders that a pair at the threshold is missed with
    probability ``MISS``. Four values and 24 orders up to ten million classes at 0.8."""
    least = 4
    while classes * NOISE**least > region and least < 12:
        least += 1
    return least, math.ceil(math.log(MISS) / math.log(1 - threshold**least)) if threshold < 1 else 1


def _hash_family(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _orders(n: int, depth: int, seed: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(VALUES)[:depth] for _ in range(n)])


def signatures(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of each set; of an empty set all ones."""
    a, b = _hash_family()
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(offsets) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    at = offsets[full]
    buffer = np.empty_like(low)
    for k in range(VALUES):
        np.multiply(low, a[k], out=buffer)
        buffer ^= buffer >> np.uint32(15)
        buffer += high
        buffer *= b[k] | np.uint32(1)
        out[full, k] = np.minimum.reduceat(buffer, at)
    return out


def _set_keys(found: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set: together its key."""
    keys = []
    for x in (found, found ^ np.uint64(0x5851F42D4C957F2D)):
        total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(mix(x), out=total[1:])
        keys.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
    return keys


def _signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Each text's hash, shingle count, set key and sketch: a byte of each signature value."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("text"), text_hash(docs[text_col]).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in blocks(batches, 1, 2 << 20, values=False):
            found, at = shingles(*arrow_bytes(batch.column(1)), words)
            signs = pa.array([s.tobytes() for s in signatures(found, at).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(at), pa.int64()), *_set_keys(found, at), signs], ["doc_id", "t", "n_shingles", "k1", "k2", "sign"])

    return map_arrow(src, run, "doc_id long, t long, n_shingles long, k1 long, k2 long, sign binary")


def text_hash(text):
    return F.xxhash64(F.lit(8), text)


#: Rows of 32768 bits of a map of keys that are needed: at most 32 MB.
MAP_ROW, MAP_ROWS = 1 << 15, 1 << 13
#: So few keys reach every task by a broadcast join, without a map.
FEW = 4096


def _map_bits(n: int) -> int | None:
    """Bits of a map of ``n`` keys, 16 a key; None where the largest map would let too much through."""
    rows = 1 << max(0, (16 * n - 1).bit_length() - 15)
    return rows * MAP_ROW if rows <= MAP_ROWS else None


def _bit_map(keys: DataFrame, spot, size: int):
    """The broadcast bit map of ``spot`` (0..size - 1) of the keys, built by Spark."""
    bits = np.zeros(size // 8, np.uint8)
    parts = keys.select(spot.alias("s")).groupBy(F.expr(f"s div {MAP_ROW}").alias("row")).agg(F.expr(f"bitmap_construct_agg(s % {MAP_ROW})").alias("bits"))
    for r in parts.collect():  # one job; an iterator has one for each partition
        bits[r["row"] * MAP_ROW // 8 : (r["row"] + 1) * MAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _in_map(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return (bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)


def _id_spot(column, size: int):
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(size))


def _narrowed(rows: DataFrame, column: str, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose ``column`` is one of ``n`` keys, and by the map a few more, without an exchange
    of the rows: a join that follows moves those alone. Where the map would be too large or there
    are ``FEW`` keys at most, Spark's join of keys picks them."""
    size = _map_bits(n)
    if size is None or n <= FEW:
        return rows.join(keys.select(F.col(key).alias(column)), column, "left_semi").select(rows.columns)
    wanted, names = _bit_map(keys, _id_spot(key, size), size), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_map(wanted.value, batch.column(len(names)).to_numpy()), pa.bool_())).select(names)

    return map_arrow(rows.withColumn("_spot", _id_spot(column, size)), run, rows.schema)


def _sets(docs: DataFrame, named: DataFrame, n: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, shingles) of the ``n`` named documents (rep) and a few more, without
    moving any text: a bit map of hashed ids, built by Spark and 16 times as long as the ids are
    many, tells the scan what to pass over. Where the largest map would let too much through, a
    join does it."""
    doc_id = docs[id_col].cast("long")
    size, wanted = _map_bits(n), None
    if size is not None:
        wanted = _bit_map(named, _id_spot("rep", size), size)
        src = docs.select(doc_id.alias("doc_id"), text_bytes(docs, text_col).alias("text"), _id_spot(doc_id, size).alias("s"))
    else:
        src = docs.select(doc_id.alias("doc_id"), text_bytes(docs, text_col).alias("text"), F.lit(0).cast("long").alias("s")).join(named.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(_in_map(wanted.value, batch.column(2).to_numpy()), pa.bool_()))
            for some, _ in blocks(iter([batch]), 1, 2 << 20, values=False):
                found, at = shingles(*arrow_bytes(some.column(1)), words)
                sets = pa.array([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), *_set_keys(found, at), sets], ["doc_id", "k1", "k2", "shingles"])

    return map_arrow(src, run, "doc_id long, k1 long, k2 long, shingles binary").where("doc_id is not null")


def _keys(signs: DataFrame, least: int, orders: int, shared=None) -> DataFrame:
    """(prefix, deep, rep) of every order: its number, below 65536, above a hash
    of its first ``least`` values; and the values below as bytes that sort as they come. shared:
    a bit map of prefixes (by their last bits), of which alone rows are given, and of a few more."""
    places, seeds = _orders(orders, least + DEEPER), mix(np.arange(1, orders + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = _sketches(batch.column(1))
            key = np.broadcast_to(seeds, (len(sign), orders)).copy()
            for d in range(least):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sign[:, places[:, d]])
            key = (key >> np.uint64(16)) | (np.arange(orders, dtype=np.uint64) << np.uint64(48))
            key ^= np.uint64(1 << 63)
            key, rep = key.reshape(-1).view(np.int64), np.repeat(batch.column(0).to_numpy(), orders)
            deep = np.ascontiguousarray(sign[:, places[:, least:]]).reshape(-1, DEEPER)
            if shared is not None:
                keep = _in_map(shared.value, key & (8 * len(shared.value) - 1))
                key, rep, deep = key[keep], rep[keep], np.ascontiguousarray(deep[keep])
            deep = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEEPER), len(deep), [None, pa.py_buffer(deep)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), deep, pa.array(rep)], ["prefix", "deep", "rep"])

    return map_arrow(signs.select("rep", "sign"), run, "prefix long, deep binary, rep long")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _regions(signs: DataFrame, least: int, orders: int, region: int, scratch: Scratch) -> DataFrame:
    """(prefix, deep, rep, large): the members of every region of two classes or more, of small
    regions with the same members one alone."""
    # Written first, so that skew handling can split the join of a prefix that very many share.
    counts = scratch.write(_keys(signs, least, orders).select("prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "counts")
    size = _map_bits(counts.count())
    shared = None if size is None else _bit_map(counts, F.col("prefix").bitwiseAND(F.lit(size - 1)), size)
    met = scratch.write(_keys(signs, least, orders, shared).join(counts, "prefix"), "keys")
    small = met.where(f"_n <= {region}")
    same = small.groupBy("prefix").agg(F.max("_n").alias("n"), F.sum(F.xxhash64("rep").bitwiseAND(0xFFFFFFFFFF)).alias("s"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("x"))
    again = same.groupBy("n", "s", "x").agg(F.min("prefix").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    other = same.join(again, ["n", "s", "x"]).where("prefix != first").select("prefix")
    return scratch.write(met.join(other, "prefix", "left_anti").select("prefix", "deep", "rep", (F.col("_n") > region).alias("large")), "regions")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    if not len(p) or not len(q) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]))
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(p) + len(q) - n)


def _met(t: pa.Table, a: int, b: int, floor: float, sign: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of a block from a on that are of different components and whose sketches agree
    in ``floor`` or more, with the agreement."""
    s = sign[a:b]
    i, j = np.triu_indices(b - a, 1)
    ok = comp[a:b][i] != comp[a:b][j]
    i, j = i[ok], j[ok]
    agree = np.empty(len(i), np.float32)
    for k in range(0, len(i), 20_000):
        agree[k : k + 20_000] = (s[i[k : k + 20_000]] == s[j[k : k + 20_000]]).mean(axis=1)
    ok = agree >= floor
    return i[ok], j[ok], agree[ok]


def _small(rows: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) of small regions (prefix, rep, comp, sign): of each a spanning forest of the
    best agreements."""

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rep, comp, sign = t.column("rep").to_numpy(), t.column("comp").to_numpy(), _sketches(t.column("sign"))
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            i, j, agree = _met(t, a, b, floor, sign, comp)
            forest = Forest(b - a)
            keep = [k for k in np.argsort(-agree, kind="stable").tolist() if forest.join(int(i[k]), int(j[k]))]
            left.append(rep[a:b][i[keep]])
            right.append(rep[a:b][j[keep]])
        return _ordered(np.concatenate(left), np.concatenate(right))

    return by_block(rows.select("prefix", "rep", "comp", "sign"), "prefix", "a long, b long", work)


def _ordered(x: np.ndarray, y: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _large(rows: DataFrame, floor: float, reach: int) -> DataFrame:
    """Pairs (a, b) from the sorted orders of large regions (prefix, deep, rep, sign): each class
    meets the ``reach`` classes that follow it and share its prefix; of every class the three best
    agreements that any order shows go on. What a border between partitions keeps apart is
    settled with the rest of the region."""
    order = ["prefix", "deep", "rep"]
    sorted_ = rows.select(*order, "sign").repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, rep, sign = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, VALUES), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                fresh = len(rep)
                prefix, rep = np.concatenate([prefix, some.column(0).to_numpy()]), np.concatenate([rep, some.column(2).to_numpy()])
                sign = np.concatenate([sign, _sketches(some.column(3))])
                a_, b_, agree = [], [], []
                for step in range(1, min(reach, len(rep) - 1) + 1):
                    j = np.arange(max(fresh, step), len(rep))
                    j = j[prefix[j] == prefix[j - step]]
                    if not len(j):
                        break  # sorted: nothing farther off shares a prefix either
                    share = (sign[j] == sign[j - step]).mean(axis=1)
                    ok = share >= floor
                    a_.append(rep[j - step][ok])
                    b_.append(rep[j][ok])
                    agree.append(share[ok])
                if a_:
                    x, y, share = np.concatenate(a_), np.concatenate(b_), np.concatenate(agree)
                    best = np.lexsort((-share, y))
                    best = best[_ranks(y[best]) < 3]
                    yield pa.RecordBatch.from_arrays([pa.array(y[best]), pa.array(x[best]), pa.array(share[best].astype(np.float32))], ["rep", "near", "agree"])
                prefix, rep, sign = prefix[-reach:], rep[-reach:], sign[-reach:]

    found = map_arrow(sorted_, run, "rep long, near long, agree float")
    best = found.groupBy("rep").agg(F.collect_set(F.struct("agree", "near")).alias("all"))  # three an order at most
    pairs = best.select("rep", F.explode(F.slice(F.sort_array("all", asc=False), 1, 3).getField("near")).alias("near"))
    return pairs.select(F.least("rep", "near").alias("a"), F.greatest("rep", "near").alias("b"))


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups each row's number in its group, from 0."""
    begin = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, int)
    return np.arange(len(groups)) - np.repeat(begin, np.diff(np.append(begin, len(groups))))


def _rest_of_small(placed: DataFrame, sets: DataFrame, floor: float, percent: int, places: np.ndarray, scratch: Scratch) -> DataFrame:
    """Links between different components of small regions (prefix, rep, comp, sign): every pair
    that agrees well enough is confirmed on the sets, unless links found before it in the region
    have joined its components. A pair that shares prefixes (values at ``places``) in several
    orders is looked at in the first: of regions with the same members ``_regions`` keeps that of
    the first order, and large regions are settled by themselves."""

    def involved(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        """Rows that agree well enough with another, by groups that hang together. A group's key is
        of its members, so that one which stands in many orders is looked at once."""
        rep, comp, sign = t.column("rep").to_numpy(), t.column("comp").to_numpy(), _sketches(t.column("sign"))
        prefix = t.column("prefix").to_numpy()
        rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            i, j, _ = _met(t, a, b, floor, sign, comp)
            before = places[: (int(prefix[a]) >> 48) + 32768]
            later = (sign[a + i] == sign[a + j])[:, before].all(axis=2).any(axis=1)
            i, j = i[~later], j[~later]
            if not len(i):
                continue
            forest = Forest(b - a)
            for x, y in zip(i.tolist(), j.tolist()):
                forest.join(x, y)
            own = np.unique(np.concatenate([i, j]))
            group = np.unique([forest.root(x) for x in own.tolist()], return_inverse=True)[1]
            total = np.zeros(group.max() + 1, np.uint64)
            np.add.at(total, group, mix(rep[a + own].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            rows.append(a + own)
            keys.append(mix(total)[group])
        some = t.take(pa.array(np.concatenate(rows).astype(np.int64))).drop_columns(["prefix"])
        return some.add_column(0, "part", pa.array(np.concatenate(keys).view(np.int64)))

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rep, comp, sign = t.column("rep").to_numpy(), t.column("comp").to_numpy(), _sketches(t.column("sign"))
        sets_ = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            i, j, agree = _met(t, a, b, floor, sign, comp)
            of = np.unique(comp[a:b], return_inverse=True)[1].tolist()
            forest = Forest(b - a)
            for k in np.argsort(-agree, kind="stable").tolist():
                x, y = of[i[k]], of[j[k]]
                if forest.root(x) != forest.root(y) and _similar(sets_[a + i[k]], sets_[a + j[k]], percent):
                    forest.join(x, y)
                    left.append(rep[a + i[k]])
                    right.append(rep[a + j[k]])
        return _ordered(np.array(left, np.int64), np.array(right, np.int64))

    found = by_block(placed.select("prefix", "rep", "comp", "sign"), "prefix", "part long, rep long, comp long, sign binary", involved)
    # Written first, so that its size is known: where it is small, no set moves that it doesn't need.
    lean = scratch.write(found.distinct(), "involved")
    needed = _narrowed(sets, "doc_id", lean, "rep", lean.count()).withColumnRenamed("doc_id", "rep")
    return by_block(lean.join(needed, "rep").select("part", "rep", "comp", "sign", "shingles"), "part", "a long, b long", work).distinct()


#: Slots in which shingles are counted, and slots of one row of counts.
SLOTS, SLOT_ROW = 1 << 20, 1 << 12
_NONE, _MOST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _slots(found: np.ndarray, slots: int) -> np.ndarray:
    return (mix(found) & np.uint64(slots - 1)).astype(np.int64)


def _counted(held: DataFrame, slots: int) -> np.ndarray:
    """For every slot how many sets of ``held`` (comp, shingles) hold a shingle of it; 0 where all
    of them are of one component. Each task counts what it reads and gives a row for every
    ``SLOT_ROW`` slots, so that no row moves for each shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, lo, hi = np.zeros(slots, np.int64), np.full(slots, _NONE), np.full(slots, _MOST)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                raw = some.column(1).to_pylist()
                slot = _slots(np.frombuffer(b"".join(raw), np.uint64), slots)
                comp = np.repeat(some.column(0).to_numpy(), [len(x) // 8 for x in raw])
                np.add.at(f, slot, 1)
                np.minimum.at(lo, slot, comp)
                np.maximum.at(hi, slot, comp)
        for row in range(slots // SLOT_ROW):
            own = slice(row * SLOT_ROW, (row + 1) * SLOT_ROW)
            full = np.flatnonzero(f[own])
            if len(full):
                yield pa.RecordBatch.from_pylist([{"row": row, "slots": full.astype(np.int16).tobytes(), "f": f[own][full].tobytes(), "lo": lo[own][full].tobytes(), "hi": hi[own][full].tobytes()}], kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                f, lo, hi = sums.setdefault(r["row"], [np.zeros(SLOT_ROW, np.int64), np.full(SLOT_ROW, _NONE), np.full(SLOT_ROW, _MOST)])
                at = np.frombuffer(r["slots"], np.int16)
                f[at] += np.frombuffer(r["f"], np.int64)
                lo[at] = np.minimum(lo[at], np.frombuffer(r["lo"], np.int64))
                hi[at] = np.maximum(hi[at], np.frombuffer(r["hi"], np.int64))
        for row, (f, lo, hi) in sums.items():
            f = np.minimum(np.where(lo < hi, f, 0), 0xFFFFFFFF).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{"row": row, "f": f.tobytes()}], pa.schema([("row", pa.int64()), ("f", pa.binary())]))

    kinds = pa.schema([("row", pa.int64()), *((c, pa.binary()) for c in ("slots", "f", "lo", "hi"))])
    parts = map_arrow(held.select("comp", "shingles"), count, "row long, slots binary, f binary, lo binary, hi binary")
    out = np.zeros(slots, np.uint32)
    for r in map_arrow(parts.repartition("row"), add, "row long, f binary").collect():
        out[r["row"] * SLOT_ROW : (r["row"] + 1) * SLOT_ROW] = np.frombuffer(r["f"], np.uint32)
    return out


def _rare(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, slots: int = SLOTS) -> DataFrame:
    """(g, rep, n, pos, weak) of members (rep, comp): the shingles over which a set of n can meet
    one of another component, and their places in the order of all: first those whose slot one
    component alone has, then by the slot's count. Any order that is the same for all sets loses no
    link, so shingles that share a slot cost meetings alone. Two rows that are ``weak`` can't
    belong to a link: too little of either set stands behind the place."""
    members = scratch.write(members, "members")
    own = _narrowed(sets, "doc_id", members, "rep", members.count())
    held = scratch.write(own.withColumnRenamed("doc_id", "rep").join(members, "rep").select("rep", "comp", "shingles"), "held", "none")
    counts = held.sparkSession.sparkContext.broadcast(_counted(held, slots))

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                raw = some.column(2).to_pylist()
                n = np.array([len(x) // 8 for x in raw], np.int64)
                g, row = np.frombuffer(b"".join(raw), np.int64), np.repeat(np.arange(len(n)), n)
                f = counts.value[_slots(g.view(np.uint64), slots)]
                order = np.lexsort((g, f, row))
                pos = _ranks(row)
                keep = (f[order] > 0) & (pos <= (n - (n * percent + 99) // 100)[row])
                row, g, pos = row[keep], g[order][keep], pos[keep]
                yield pa.RecordBatch.from_arrays([pa.array(g), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(n[row]), pa.array(pos)], ["g", "rep", "comp", "n", "pos"])

    rows = scratch.write(map_arrow(held, early, "g long, rep long, comp long, n long, pos long"), "early")
    common = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g")
    placed = rows.join(common, "g", "left_semi").select("g", "rep", "n", "pos").distinct()
    return placed.withColumn("weak", F.expr(f"(n - pos) * {100 + percent} < 2 * n * {percent}"))


def _over_rare(rows: DataFrame, percent: int, most: int, all_: bool) -> DataFrame:
    """Pairs (a, b) of rows (g, rep, comp, n, pos, weak) that meet in a shingle and may be links:
    all of them, or of any two components in a block the one that stands foremost."""
    dealt = meeting_blocks(rows, "g", "rep", most, still="weak").select("block", "rep", "comp", "n", "pos", "chunk", "pure")

    def work(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rep, comp, n, pos, chunk, pure = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "pos", "chunk", "pure"))
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                behind = np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (comp[j] != comp[i]) & (behind * (100 + percent) >= (n[i] + n[j]) * percent) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                j = j[ok & (pure[j] | (chunk[j] != chunk[i]))]
                if not all_ and len(j):
                    j = j[np.argsort(pos[j], kind="stable")]
                    j = j[np.unique(comp[j], return_index=True)[1]]
                left.append(np.full(len(j), rep[i]))
                right.append(rep[j])
        x, y = np.concatenate(left), np.concatenate(right)
        return _ordered(x, y)

    return by_block(dealt, "block", "a long, b long", work).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    # Of the sets only those that a pair names move.
    n = pairs.count()
    side = lambda c: _narrowed(sets, "doc_id", pairs, c, n).select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    left, right = side("a"), side("b")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [_similar(p, q, percent) for p, q in zip(*sides)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return map_arrow(met, run, "a long, b long").distinct()


def _joined(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) with more links: only the roots that they join are looked at."""
    if roots is None:
        return scratch.write(components(links, scratch), "roots")
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    lifted = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = scratch.write(components(lifted, scratch), "moved").select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return scratch.write(known.unionByName(fresh), "roots")


def similar_classes(signs: DataFrame, sets_of: Callable[[DataFrame, int], DataFrame], *, percent: int, region: int, slack: float, scratch: Scratch) -> DataFrame:
    """(node, root) of classes that link with another. signs: (rep, sign); sets_of: the shingles
    (doc_id, shingles) of so many classes (rep), of which it may give more or one repeatedly."""
    floor = percent / 100 - slack
    least, orders = forest_shape(signs.count(), percent / 100, region)
    regions = _regions(signs, least, orders, region, scratch)
    there = scratch.write(regions.select("rep").distinct(), "there")
    signs = _narrowed(signs, "rep", there, "rep", there.count())
    met = scratch.write(regions.join(signs, "rep").withColumn("comp", F.col("rep")), "met")
    pairs = scratch.write(_small(met.where("not large"), floor).unionByName(_large(met.where("large"), floor, region // 2)).distinct(), "pairs")
    # Whose sets are needed: candidates that passed, and members of large regions.
    named = scratch.write(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(regions.where("large").select("rep")).distinct(), "named")
    sets = scratch.write(sets_of(named, named.count()), "sets", "none")
    roots = _joined(None, scratch.write(_confirm(pairs, sets, percent), "links"), scratch)

    def placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.drop("comp").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")

    here = scratch.write(placed(met.drop("deep", "sign"), roots), "placed")
    apart = scratch.write(here.groupBy("prefix").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("prefix"), "of-several")
    open_ = scratch.write(here.join(apart, "prefix", "left_semi"), "apart")
    links = _rest_of_small(open_.where("not large").join(signs, "rep"), sets, floor, percent, _orders(orders, least + DEEPER)[:, :least], scratch)
    rare = scratch.write(_rare(open_.where("large").select("rep", "comp").distinct(), sets, percent, scratch), "rare")
    first = scratch.write(_over_rare(placed(rare, roots), percent, 1024, False), "foremost")
    more = scratch.write(links.unionByName(_confirm(first, sets, percent)).distinct(), "more-links")
    if not more.isEmpty():
        roots = _joined(roots, more, scratch)
    last = scratch.write(_over_rare(placed(rare, roots), percent, 1024, True).join(first, ["a", "b"], "left_anti"), "others")
    if not last.isEmpty():
        more = scratch.write(_confirm(last, sets, percent), "last-links")
        if not more.isEmpty():
            roots = _joined(roots, more, scratch)
    scratch.drop(met, sets, here, open_, rare)
    return roots


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, region: int, slack: float, scratch: Scratch) -> DataFrame:
    """(doc_id, t, n_shingles, root, component_id) of every row: t is a hash of its text; rows of
    one root are linked. Root and component are null without shingles or id."""
    signed = scratch.write(_signed(docs, words, id_col, text_col), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # Sketches are of sets, so all rows of a class have the same.
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.first("sign").alias("sign"))
    # A class's node is its least id. An id that stands over several sets tells none of them:
    # classes of such ids have a hash of the set for a node.
    key = F.struct("k1", "k2")
    mixed = scratch.write(full.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select(F.col("doc_id").alias("low"), F.lit(True).alias("mixed")), "mixed-ids")
    unmixed = mixed.isEmpty()
    own = classes.withColumn("node", F.col("low")) if unmixed else classes.join(mixed, "low", "left").withColumn("node", F.when(F.col("mixed"), F.xxhash64("k1", "k2")).otherwise(F.col("low"))).drop("mixed")
    classes = scratch.write(own.select("k1", "k2", "low", "node", "sign"), "classes")
    first = classes.select("k1", "k2", F.col("low").alias("doc_id"), F.col("node").alias("rep"))
    signs = classes.select(F.col("node").alias("rep"), "sign")

    def sets_of(named: DataFrame, n: int) -> DataFrame:
        if unmixed:
            return _sets(docs, named, n, words, id_col, text_col).select("doc_id", "shingles")
        ids = first.join(named, "rep", "left_semi").select(F.col("doc_id").alias("rep")).distinct()
        found = _sets(docs, ids, n, words, id_col, text_col).join(first, ["k1", "k2", "doc_id"])
        return found.select(F.col("rep").alias("doc_id"), "shingles")

    roots = similar_classes(signs, sets_of, percent=percent, region=region, slack=slack, scratch=scratch)
    placed = classes.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.withColumn("component_id", F.col("root")) if unmixed else placed.join(placed.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    of_class = least.select("k1", "k2", "root", "component_id")
    # Rows without shingles or id get a key that no class has.
    there = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return signed.select("doc_id", "t", "n_shingles", F.when(there, F.col("k1")).alias("k1"), "k2").join(of_class, ["k1", "k2"], "left").select("doc_id", "t", "n_shingles", "root", "component_id")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    region: int = 64, slack: float = 0.15,
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least id reachable by links), kept.

    Linked are documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more. Words are runs of bytes other than ASCII white space, A-Z lowered;
    shorter texts have one shingle, the whole sequence; texts that are null or hold no word have
    none, link with nothing and are kept. A null id links with nothing; its row has no component
    and is kept. Rows that share an id are judged each by its own text. Only id and text are
    read, so other columns may have any names. An empty table gives an empty result.

    slack: how far below the threshold two sketches may agree (of 128 values) and still be
    checked on full sets; 0.15 is more than four standard deviations."""
    found = _grouped(docs, id_col, text_col, words, percent, region, slack, Scratch(docs.sparkSession, "minhash-forest"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    region: int = 64, slack: float = 0.15,
) -> DataFrame:
    """The rows of ``docs``, all their columns, of each group of linked documents (see
    ``near_duplicates``) one alone: that of the least id, among rows of that id the one whose
    text's hash is least, and of rows equal in id and text any one. Rows without words or id
    stay. A row is told by its id and text, so that rows which share an id fare each by its own
    text."""
    scratch = Scratch(docs.sparkSession, "minhash-forest")
    found = _grouped(docs, id_col, text_col, words, percent, region, slack, scratch).where("root is not null")
    rows = scratch.write(found.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("times")), "rows")
    stays = rows.groupBy("root").agg(F.min(F.struct("doc_id", "t", "times")).alias("k")).select("root", "k.*")
    gone = rows.join(stays.select("root", F.col("doc_id").alias("d"), F.col("t").alias("h")), "root").where("doc_id != d or t != h").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"))
    again = scratch.write(stays.where("times > 1").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")), "again")
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumn("_d", F.col(names[docs.columns.index(id_col)]).cast("long")).withColumn("_t", text_hash(F.col(names[docs.columns.index(text_col)])))
    left = keyed.join(scratch.write(gone, "gone"), ["_d", "_t"], "left_anti")
    if not again.isEmpty():
        left = left.join(again, ["_d", "_t"], "left_anti").unionByName(left.join(again, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]))
    return left.select(*names).toDF(*docs.columns)


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


#: By pairs of documents that share a shingle, and all that can be reached over links.
OP3_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d
), n as (
  select doc_id, count(*) as n from s group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
), reach as (
  select doc_id as x, doc_id as y from n union select r.x, l.y from reach r join links l on l.x = r.y
), least as (
  select x, min(y) as component_id from reach group by x
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join least on least.x = d.doc_id
"""

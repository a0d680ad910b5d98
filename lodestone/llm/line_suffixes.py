"""Line dedup by a suffix array over the line sequences of all documents.

Every document is a sequence of line ids, and its suffixes are sorted by prefix doubling: the
ranks of the runs of k lines at a place and k lines further on give, sorted in pairs, the ranks of
the runs of 2k lines. Ranks follow the order of the runs, and the suffixes of one rank are an
interval of the suffix array whose longest common prefix is k or more. Suffixes that stand alone
at some depth leave, and are ordered no further; the rounds end when none is left, which is after
the logarithm of the longest repeated run.

The interval of any depth n is told by two ranks, those of the runs of a power of two that cover
n lines from its begin and up to its end. From every line forward, and up to every line backward,
the interval of the shortest run of ``min_words`` words is looked up that way; together these
cover exactly the maximal repeated runs of that size. An interval's first copy, by document id and
place, stays; lines of later copies go.

All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, width

WORD = r"[^\x20\x09-\x0D]+"


def _occurrences(src: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines that occur twice or more: g (a number that follows the order of id and place, with
    no gap inside a document's stretch of such lines), d, t, p, stretch, its last g, words, and
    the rank of the line."""
    line = src.select("d", "t", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    ids = line.select("d", "t", "p", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), F.expr(f"regexp_count(line, r'{WORD}')").alias("w"))
    # Written first, so that skew handling can split the join of a very common line; never
    # broadcast, as their number grows with the corpus.
    twice = scratch.write(ids.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "twice")
    some = ids.join(twice.hint("merge"), ["h", "h2"]).dropDuplicates(["d", "t", "p"])  # rows of equal id and text are one document
    # A document's lines stay in one partition, so that its numbers follow each other.
    ranged = some.repartitionByRange(width(src.sparkSession), "d", "t").sortWithinPartitions("d", "t", "p").withColumn("g", F.monotonically_increasing_id())
    numbered = scratch.write(ranged, "numbered")
    lines = _ordered(twice, ["h", "h2"], scratch, "lines")
    doc = Window.partitionBy("d", "t")
    out = numbered.join(lines.hint("merge"), ["h", "h2"]).withColumn("stretch", F.col("p") - F.row_number().over(doc.orderBy("p")))
    here = Window.partitionBy("d", "t", "stretch")
    out = out.withColumn("last", F.max("g").over(here)).withColumn("upto", F.sum("w").over(here.orderBy("p"))).select("g", "d", "t", "p", "stretch", "last", "w", "upto", "rank")
    out = scratch.write(out, "occurrences")
    scratch.drop(twice, numbered, lines)
    return out


def _ordered(runs: DataFrame, key: list[str], scratch: Scratch, tag: str) -> DataFrame:
    """A table of different keys, with ``rank``: a number that follows their order. The ranges
    are balanced, as no key comes twice; written, as other ranges would give other numbers."""
    ranged = runs.repartitionByRange(width(runs.sparkSession), *key).sortWithinPartitions(*key)
    return scratch.write(ranged.withColumn("rank", F.monotonically_increasing_id()), tag)


def _ranks(occ: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For k = 1, 2, 4, ... (k, g, rank, last): where each run of k lines that occurs twice
    begins, and its rank among all of them. The suffixes of one rank are an interval."""
    now = scratch.write(occ.select(F.lit(1).cast("long").alias("k"), "g", "rank", "last"), "ranks1")
    levels, k = [now], 1
    while True:
        left = now.select("g", F.col("rank").alias("a"), "last").where(F.col("g") + k <= F.col("last"))
        right = now.select((F.col("g") - k).alias("g"), F.col("rank").alias("b"))
        k *= 2
        halves = scratch.write(left.join(right, "g"), f"halves{k}")
        runs = scratch.write(halves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), f"runs{k}")
        if runs.isEmpty():
            scratch.drop(halves, runs)
            return levels
        order = _ordered(runs, ["a", "b"], scratch, f"order{k}")
        now = scratch.write(halves.join(order.hint("merge"), ["a", "b"]).select(F.lit(k).cast("long").alias("k"), "g", "rank", "last"), f"ranks{k}")
        levels.append(now)
        scratch.drop(halves, runs, order)


def _shortest(occ: DataFrame, min_words: int) -> DataFrame:
    """(g, n): where a run of n lines begins that is the shortest of ``min_words`` words from its
    first line on, or up to its last line."""
    at = Window.partitionBy("d", "t", "stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = ["d", "t", "stretch", "g"]
    before = F.col("upto") - F.col("w")
    ends = occ.select(*key, F.col("upto").alias("v"), F.lit(0).alias("ask"))
    ask = occ.select(*key, (before + min_words).alias("v"), F.lit(1).alias("ask"))
    stop = F.last(F.when(F.col("ask") == 0, F.col("g")), ignorenulls=True).over(at.orderBy(F.col("v").desc(), "ask", F.col("g").desc()))
    forward = ends.unionByName(ask).withColumn("stop", stop).where("ask = 1 and stop is not null").select("g", (F.greatest("stop", "g") - F.col("g") + 1).alias("n"))
    begins = occ.select(*key, before.alias("v"), F.lit(0).alias("ask"))
    ask = occ.select(*key, (F.col("upto") - min_words).alias("v"), F.lit(1).alias("ask"))
    start = F.last(F.when(F.col("ask") == 0, F.col("g")), ignorenulls=True).over(at.orderBy("v", "ask", "g"))
    backward = begins.unionByName(ask).withColumn("start", start).where("ask = 1 and start is not null")
    backward = backward.select(F.least("start", "g").alias("b"), "g").select(F.col("b").alias("g"), (F.col("g") - F.col("b") + 1).alias("n"))
    return forward.unionByName(backward).distinct()


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(d, t, removed): for each document that loses lines, their numbers from 0. A document is
    told by its id and a hash of its text (and of whether the id is null)."""
    scratch = scratch or Scratch(docs.sparkSession, "line-suffixes")
    src = _keyed(docs, id_col, text_col)
    occ = _occurrences(src, scratch)
    levels = _ranks(occ, scratch)
    ranks = reduce(DataFrame.unionByName, levels).drop("last")
    runs = _shortest(occ, min_words).withColumn("k", F.pow(F.lit(2.0), F.floor(F.log2("n") + 1e-9)).cast("long"))
    head = ranks.withColumnRenamed("rank", "a")
    tail = ranks.select("k", F.col("g").alias("end"), F.col("rank").alias("b"))
    told = runs.join(head, ["k", "g"]).withColumn("end", F.col("g") + F.col("n") - F.col("k")).join(tail, ["k", "end"]).select("g", "n", "a", "b")
    told = scratch.write(told, "runs")
    scratch.drop(*levels)
    # Intervals of depth n with two suffixes or more; the first copy has the least number.
    intervals = told.groupBy("n", "a", "b").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    intervals = scratch.write(intervals, "intervals")
    later = told.join(intervals.hint("merge"), ["n", "a", "b"]).where("g > first").groupBy("g").agg(F.max("n").alias("n"))
    reach = F.max(F.col("g") + F.col("n")).over(Window.partitionBy("d", "t", "stretch").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = occ.join(later, "g", "left").withColumn("reach", reach).where("reach > g")
    return gone.groupBy("d", "t").agg(F.collect_set("p").alias("removed"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs[id_col].cast("long")
    text = docs[text_col]
    return docs.select(F.coalesce(d, F.lit(0)).alias("d"), F.xxhash64(d.isNull(), text).alias("t"), text.alias("text")).where("text is not null")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """All columns of ``docs``, its text without later copies of repeated line runs, and
    ``n_lines``, ``n_removed``.

    A run is repeated if the same lines, ``min_words`` words or more in all, stand at two places;
    runs may overlap, and places of one document count. Lines are cut at line feeds and compared
    as they are. A text that is null stays null, without lines; one that loses every line becomes
    empty, and its row stays. Rows of equal id and text are one document and fare alike. A null
    id sorts as 0. Columns named like the new ones are replaced."""
    scratch = Scratch(docs.sparkSession, "line-suffixes")
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words, scratch=scratch)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs[id_col].cast("long")
    row = docs.select(F.coalesce(d, F.lit(0)).alias("_d"), F.xxhash64(d.isNull(), docs[text_col]).alias("_t"), *[docs[c].alias(f"c{k}") for k, c in enumerate(keep)])
    met = row.join(gone.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("removed").alias("_removed")), ["_d", "_t"], "left")
    text = F.col(f"c{keep.index(text_col)}")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(F.col("_removed"), k)), "\n")
    new = F.when(F.col("_removed").isNull(), text).otherwise(left)
    n = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("int")
    return met.select(*[(new if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(keep)], n.alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).alias("n_removed"))


def op6_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: By pairs of equal lines: stretches on the same diagonal whose words add up.
OP6_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as p
  from documents where text is not null
), n as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from l
), pairs as (
  select a.doc_id as d, a.p as p, b.doc_id as d2, a.p - b.p as diag, a.w as w
  from n a join n b on a.line = b.line and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.p < a.p))
), runs as (
  select *, p - row_number() over (partition by d, d2, diag order by p) as run from pairs
), sums as (
  select d, p, sum(w) over (partition by d, d2, diag, run) as words from runs
), gone as (
  select distinct d, p from sums where words >= 50
), kept as (
  select n.doc_id, string_agg(case when gone.d is null then line end, chr(10) order by n.p) as text, count(*) as n_lines, count(gone.d) as n_removed
  from n left join gone on gone.d = n.doc_id and gone.p = n.p group by n.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  cast(coalesce(k.n_lines, 0) as integer) as n_lines, cast(coalesce(k.n_removed, 0) as integer) as n_removed
from documents d left join kept k on k.doc_id = d.doc_id
"""

"""Mixing sources to target weights by hierarchical budgeting.

Leaves are sources, below languages, below domains. A token budget goes down the tree: each node
hands its budget to its children in proportion to their weights; a child that has less than its
share (its tokens times the number of epochs allowed) takes what it has, and the rest goes to its
siblings by weight. A node gets no more than its leaves hold together, so a shortage goes to
ancestors' other children only when no sibling can take it.

A leaf reads its documents in seeded epochs, each in an order of its own: whole epochs as long as
its budget lasts, then the longest prefix of the next one that the rest allows. The cut of that
prefix is found from sums over 4096 ranges of the order and a look into the one range where the
cut lies; so no task sorts a whole leaf, and texts don't move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of an epoch's order: values of the first three hexadecimal digits.
RANGES = 4096


@dataclass(frozen=True)
class Level:
    """A level of the tree: its name, the key of a row (SQL), and the children's weights."""

    name: str
    key: str
    weights: Mapping[str, int] = field(default_factory=dict)
    other: int = 1

    def weight(self) -> str:
        cases = " ".join(f"when '{k}' then {v}" for k, v in self.weights.items())
        return f"case {self.name} {cases} else {self.other} end" if cases else str(self.other)


#: Domains are told by a source's number here, as the tables have no column for them.
LEVELS = (
    Level("domain", "concat('domain', cast(coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)', 1), '') as int), 0) % 4 as string))", {"domain0": 4, "domain1": 3, "domain2": 2}),
    Level("lang", "coalesce(lang, '')", {"en": 6, "fr": 2, "de": 2}),
    Level("source", "coalesce(source, '')"),
)


def _allocate(tree: DataFrame, budget: Column, parents: Sequence[str], level: Level) -> DataFrame:
    """tree: one row a node of a level, with ``cap`` and, unless at the top, its parent's
    ``got``. Adds the node's own budget as ``got``."""
    t = tree.withColumn("_b", budget).withColumn("_w", F.expr(level.weight()).cast("long"))
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("_w").cast("double"), level.name)
    all_ = Window.partitionBy(*parents)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("_before", before).withColumn("_onward", onward)
    t = t.withColumn("_full", F.col("cap") * F.col("_onward") <= (F.col("_b") - F.col("_before")) * F.col("_w"))
    held = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(all_), F.lit(0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_)
    t = t.withColumn("_held", held).withColumn("_open", open_)
    got = F.when(F.col("_full"), F.col("cap")).otherwise(F.coalesce(F.expr("((_b - _held) * _w) div nullif(_open, 0)"), F.lit(0)))
    return t.withColumn("got", got.cast("long")).drop("_b", "_w", "_before", "_onward", "_full", "_held", "_open")


def mix(
    docs: DataFrame, *, levels: Sequence[Level] = LEVELS, numerator: int = 3, denominator: int = 4, epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and ``mix_epoch``, ``mix_tokens`` (words of the text), and
    ``mix_<level>``: one row for each document and epoch in which the mixture takes it.

    The budget is ``numerator`` / ``denominator`` of all tokens. A null text has no tokens; rows
    of a null id are ordered by their texts. Null keys are a child of the name ''. Documents without tokens
    come as their place in the order has it. Rows equal in id and tokens fare alike. Weights are
    whole numbers, 0 for children that get nothing; a leaf's share is rounded down. An empty
    table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names = [x.name for x in levels]
    keys = [F.expr(x.key).alias(f"mix_{x.name}") for x in levels]
    tokens = F.coalesce(F.expr(f"regexp_count({text_col}, r'{WORD}')"), F.lit(0)).cast("long").alias("mix_tokens")
    keyed = docs.select("*", *keys, tokens)
    lean = scratch.write(keyed.select(_key(F.col(id_col), F.col(text_col)).alias("id"), *[F.col(f"mix_{n}").alias(n) for n in names], F.col("mix_tokens").alias("tokens")), "keyed")
    leaves = scratch.write(lean.groupBy(*names).agg(F.sum("tokens").alias("have")), "leaves")
    total = leaves.agg(F.sum("have")).first()[0] or 0
    tree = None
    for k, level in enumerate(levels):
        here = leaves.groupBy(*names[: k + 1]).agg((F.sum("have") * epochs).alias("cap"))
        if tree is None:
            tree = _allocate(here, F.lit(total * numerator // denominator), [], level)
        else:
            up = tree.select(*names[:k], F.col("got").alias("up"))
            tree = _allocate(here.join(up, names[:k]), F.col("up"), names[:k], level).drop("up")
    plan = leaves.join(tree.select(*names, "got"), names).select(*names, F.expr("coalesce(got div nullif(have, 0), 0)").alias("whole"), "got", "have")
    plan = scratch.write(plan.withColumn("rest", F.col("got") - F.col("whole") * F.col("have")), "plan")
    placed = lean.join(plan.select(*names, "whole", "rest"), names).withColumn("h", _order(seed, F.col("whole") + 1, F.col("id")))
    placed = placed.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sums = placed.groupBy(*names, "rest", "range").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("range"))  # RANGES rows a leaf at most
    border = sums.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(F.min("range").alias("range"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "range").alias("left"))
    near = placed.join(border, [*names, "range"]).select(*names, "h", "id", "tokens", "left", "range")
    into = F.sum("tokens").over(Window.partitionBy(*names, "range").orderBy("h", "id", "tokens"))
    last = near.withColumn("into", into).where("into <= left").groupBy(*names).agg(F.max(F.struct("h", "id", "tokens")).alias("last"))
    cut = plan.select(*names, "whole").join(border.select(*names, "range"), names, "left").join(last, names, "left")
    cut = scratch.write(cut.select(*[F.col(n).alias(f"mix_{n}") for n in names], "whole", "range", "last"), "cut")
    n_doc = len(keyed.columns)
    plain = keyed.toDF(*[f"c{k}" for k in range(n_doc)])
    here = [f"c{n_doc - 1 - len(names) + k}" for k in range(len(names))]
    met = plain.join(cut.toDF(*here, "_whole", "_range", "_last"), here)
    id_ = _key(F.col(f"c{docs.columns.index(id_col)}"), F.col(f"c{docs.columns.index(text_col)}"))
    h = _order(seed, F.col("_whole") + 1, id_)
    mine = F.struct(h.alias("h"), id_.alias("id"), F.col(f"c{n_doc - 1}").alias("tokens"))
    # Without a border nothing of the next epoch is taken; before it every row is, in it up to the last.
    more = F.coalesce((F.conv(F.substring(h, 1, 3), 16, 10).cast("int") < F.col("_range")) | (mine <= F.col("_last")), F.lit(False))
    times = F.col("_whole") + more.cast("long")
    out = met.withColumn("_e", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keyed.columns)], F.col("_e").alias("mix_epoch"))


def _key(id_: Column, text: Column) -> Column:
    """What a row is ordered by: its id, or without one its text, so that rows without ids don't
    all fall in one range."""
    return F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def mix_sql(levels: Sequence[Level], numerator: int, denominator: int, epochs: int, seed: int, docs: str = "documents") -> str:
    """The same for DuckDB, by one window over each leaf."""
    names = [x.name for x in levels]
    keys = ", ".join(f"{x.key.replace('as string)', 'as varchar)')} as {x.name}" for x in levels)
    parts = [f"""base as (select doc_id, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as key, {keys}, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as tokens from {docs})""",
             f"leaves as (select {', '.join(names)}, sum(tokens) as have from base group by all)"]
    for k, x in enumerate(levels):
        own, up = ", ".join(names[: k + 1]), ", ".join(names[:k])
        by = f"partition by {up}" if up else ""
        source = f"(select {own}, cast(sum(have) * {epochs} as bigint) as cap from leaves group by all)"
        budget = f"(select cast(coalesce(sum(have), 0) as bigint) * {numerator} // {denominator} from leaves)" if not k else "up"
        joined = source if not k else f"{source} join (select {up}, got as up from t{k - 1}) using ({up})"
        parts.append(f"""a{k} as (select {own}, cap, {budget} as b, cast({x.weight()} as bigint) as w from {joined}),
b{k} as (select *, cast(coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as bigint) as before, cast(sum(w) over (o rows between current row and unbounded following) as bigint) as onward from a{k} window o as ({by} order by cap / cast(w as double), {x.name})),
c{k} as (select *, cap * onward <= (b - before) * w as is_full from b{k}),
t{k} as (select {own}, cast(case when is_full then cap else coalesce(((b - coalesce(sum(case when is_full then cap end) over p, 0)) * w) // nullif(sum(case when not is_full then w end) over p, 0), 0) end as bigint) as got from c{k} window p as ({by}))""")
    own = ", ".join(names)
    parts.append(f"plan as (select {own}, cast(coalesce(got // nullif(have, 0), 0) as bigint) as whole, cast(got - coalesce(got // nullif(have, 0), 0) * have as bigint) as rest, have from leaves join t{len(levels) - 1} using ({own}))")
    parts.append(f"placed as (select base.*, whole, rest, have, md5(concat('{seed}:', whole + 1, ':', key)) as h from base join plan using ({own}))")
    parts.append(f"summed as (select *, sum(tokens) over (partition by {own} order by h, key, tokens) as upto from placed)")
    parts.append("times as (select *, whole + case when upto <= rest and have > rest then 1 else 0 end as n from summed)")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, {', '.join(f'{n} as mix_{n}' for n in names)}, tokens as mix_tokens, e as mix_epoch from (select *, unnest(generate_series(1, n)) as e from times)"


def op9_budget_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")


OP9_SQL = mix_sql(LEVELS, 3, 4, 2, 17)

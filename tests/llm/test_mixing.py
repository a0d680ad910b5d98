"""Budgets against a plain recursion, and the whole against its SQL."""

import random

import duckdb
import pyarrow as pa

from lodestone.llm.mixing import LEVELS, OP9_SQL, mix


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = None if rng.random() < 0.03 else "plain" if rng.random() < 0.05 else "src0" if rng.random() < 0.4 else f"src{rng.randrange(12)}"
        text = None if rng.random() < 0.03 else " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 400])))
        out.append((k, text, rng.choice(["en", "en", "fr", "xx", None]), source))
    return out + [(None, f"a b c {k}", "en", "src1") for k in range(n // 10)] + [(None, "a b c", "en", "src1"), (3, "a b", "en", "src0"), (3, "a b", "en", "src0"), (9999, "w " * 50_000, "de", "src2")]


def test_matches_sql(spark):
    for seed, n in ((1, 400), (2, 20), (3, 0)):
        rows = rows_of(seed, n) if n else []
        docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, source string, tokens double")
        con = duckdb.connect()
        cols = list(zip(*rows)) or [[]] * 4
        con.register("documents", pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string())}))
        names = "doc_id, mix_domain, mix_lang, mix_source, mix_tokens, mix_epoch"
        want = con.sql(f"select {names} from ({OP9_SQL})").fetchall()
        got = [tuple(r) for r in mix(docs).select(*names.split(", ")).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def fill(budget, children):
    """children: (weight, cap, name); shares by weight, what one lacks handed to the others."""
    got, open_, left = {}, list(children), budget
    while open_:
        weight = sum(w for w, _, _ in open_)
        full = [c for c in open_ if c[1] * weight <= left * c[0]]
        if not full:
            return got | {name: left * w // weight for w, _, name in open_}
        for _, cap, name in full:
            got[name] = cap
            left -= cap
        open_ = [c for c in open_ if c not in full]
    return got


def test_budgets(spark):
    rows = [r for r in rows_of(7, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {}
    for r in mix(docs).collect():
        key = (r["mix_domain"], r["mix_lang"], r["mix_source"])
        taken[key] = taken.get(key, 0) + r["mix_tokens"]
    have = {}
    for _, text, lang, source in rows:
        number = "".join(c for c in source or "" if c.isdigit())
        key = (f"domain{int(number or 0) % 4}", lang or "", source or "")
        have[key] = have.get(key, 0) + len((text or "").split())

    def weight(level, name):
        return LEVELS[level].weights.get(name, LEVELS[level].other)

    def down(prefix, budget):
        if len(prefix) == 3:
            assert taken.get(prefix, 0) <= budget
            assert taken.get(prefix, 0) >= min(budget, 2 * have[prefix]) - 50_000
            return
        caps = {}
        for k, v in have.items():
            if k[: len(prefix)] == prefix:
                caps[k[len(prefix)]] = caps.get(k[len(prefix)], 0) + 2 * v
        for name, got in fill(budget, [(weight(len(prefix), n), c, n) for n, c in caps.items()]).items():
            down((*prefix, name), got)

    down((), sum(have.values()) * 3 // 4)

"""Line dedup against its SQL by pairs of lines, and planted passages."""

import random

import duckdb
import pyarrow as pa

from lodestone.llm.common import Scratch
from lodestone.llm.line_suffixes import OP6_SQL, _keyed, _occurrences, _ranks, dedup_lines


def line(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))


def test_matches_sql(spark):
    rng = random.Random(3)
    pool = [line(rng, n) for n in (0, 1, 5, 10, 20, 30, 49, 50, 60)] + ["", "  ", "x\ty"]
    rows = []
    for k in range(150):
        text = [rng.choice(pool) if rng.random() < 0.6 else line(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 25))]
        if rows and rng.random() < 0.3:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            at = rng.randrange(len(text))
            text[at:at] = other[a : a + rng.randrange(1, 9)]
        rows.append((k, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["same ten words in this very line and no more"] * 300)), (204, rows[3][1])]
    docs = spark.createDataFrame([(d, t, 9, "c") for d, t in rows], "doc_id long, text string, n_removed int, d string").repartition(4)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}))
    want = con.sql(f"select doc_id, text, n_lines, n_removed from ({OP6_SQL})").fetchall()
    out = dedup_lines(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_lines", "n_removed", "d"])
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect())) == sorted(want)


def test_passages_and_rows_that_share_an_id(spark):
    rng = random.Random(4)
    passage = "\n".join(line(rng, 20) for _ in range(3))
    rows = [(1, f"first\n{passage}\nend"), (2, f"second\n{passage}"), (2, f"other\n{passage}\nx"), (2, f"second\n{passage}"), (None, "nothing"), (None, "nothing")]
    got = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()), key=str)
    assert (1, f"first\n{passage}\nend") in got
    assert [t for d, t in got if d == 2] == ["other\nx", "second", "second"]  # equal rows fare alike
    assert [t for d, t in got if d is None] == ["nothing", "nothing"]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ranks_are_the_order_of_all_repeated_runs(spark):
    """At each depth: every run that occurs twice, at all its places, ranked as its lines are."""
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for k in range(12)] + [(20, "\n".join("ab" * 40)), (21, "x\ny")]
    scratch = Scratch(spark, "test-ranks")
    occ = _occurrences(_keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), scratch)
    line, last = {}, {}
    for r in occ.collect():
        line[r["g"]], last[r["g"]] = r["rank"], r["last"]
    levels = _ranks(occ, scratch)
    assert len(levels) == 7  # 78 of the 80 lines of document 20 come again two further on
    for level in levels:
        got = {r["g"]: (r["k"], r["rank"]) for r in level.collect()}
        k = 2 ** levels.index(level)
        places = {}
        for g in line:
            if g + k - 1 <= last[g]:
                places.setdefault(tuple(line[g + x] for x in range(k)), []).append(g)
        repeated = sorted(run for run, at in places.items() if len(at) > 1)
        assert sorted(got) == sorted(g for run in repeated for g in places[run])
        ranks = [{got[g] for g in places[run]} for run in repeated]
        assert all(len(x) == 1 for x in ranks)  # one rank a run
        flat = [x.pop() for x in ranks]
        assert flat == sorted(set(flat)) and {a for a, _ in flat} <= {k}

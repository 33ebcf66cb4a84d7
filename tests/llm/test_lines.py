"""Line deduplication against a plain version, over batches whose runs are merged and read again."""

import collections
import random
import re

import pytest

from tallyvane.llm import lines
from tallyvane.sources.staging import Scratch

SCHEMA = "doc_id long, text string, lang string, a long, b long, body string, keys string, n_docs double, newest string"


def make_rows():
    rng = random.Random(8)
    pool = [f"a common line of some length, number {k}" for k in range(25)] + ["short line", "ééééééééééééééééééé", "éééééééééééééééééééé", "x" * 20, "x" * 19, "東京" * 10, "東京" * 9 + "東"]
    dress = lambda s: rng.choice(["", " ", "\t", "\x0b "]) + rng.choice([s, s.upper(), s.title()]) + rng.choice(["", "  ", "\r", "\x0c"])
    texts = ["\n".join(dress(rng.choice(pool)) if rng.random() < 0.7 else f"line of its own {i} {j} {rng.random()}" for j in range(rng.randrange(1, 12))) for i in range(80)]
    texts += ["", None, "\n", "\n\n \n", "a common line of some length, number 1\n" * 500, "one more long line that repeats in here\n" * 3, "word " * 20_000, "\x1c" + pool[0], "\xa0" + pool[0]]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0]] * 2 + [(3, pool[0] + "\n" + pool[1]), (None, pool[0]), (None, None), (-7, pool[2] + "\nend")]
    return [(i, t, "en", 1, 2, "clash", "clash", 0.5, "clash") for i, t in rows]


def key_of(line):
    key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def plain(rows, least_docs, least_chars):
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(i)
    out = []
    for i, t, *_ in rows:
        split = (t or "").split("\n")
        gone = lambda x: i is not None and len(holders.get(key_of(x), ())) >= least_docs and i < max(holders[key_of(x)])
        kept = [x for x in split if not gone(x)]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept).encode()))
    return out


@pytest.mark.parametrize(("batches", "fan", "least_docs", "least_chars"), [(4, 2, 3, 20), (7, 3, 3, 20), (1, 2, 2, 5), (5, 2, 1, 20)])
def test_lines_equal_plain(spark, batches, fan, least_docs, least_chars):
    rows = make_rows()
    got = lines.dedupe_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), least_docs, least_chars, batches, fan)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got.collect()), key=key) == sorted(plain(rows, least_docs, least_chars), key=key)


def test_lines_of_nothing(spark):
    assert lines.dedupe_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merged_runs_are_read_by_later_batches(spark):
    """Seven batches and a fan of two: one run a power of two in the sum, the replaced ones gone from disk."""
    scratch = Scratch(spark)
    index = lines.LineIndex(scratch, 2)
    for k in range(7):
        rows = [(100 - k, 1, 1), (100 - k, 10 + k, 0)]
        fresh = index.add(scratch(spark.createDataFrame(rows, "doc_id long, a long, b long"), "batch"))
        assert sorted((r["a"], r["newest"]) for r in fresh.collect()) == ([(1, 100)] if k == 0 else []) + [(10 + k, 100 - k)]
        sizes = [run.agg({"n_docs": "max"}).first()[0] for run in index.runs]
        assert sizes == [1 << bit for bit in range(3, -1, -1) if (k + 1) >> bit & 1]
    assert sum(name.startswith("run-") for name in scratch.tables) == 3
    assert sorted((r["a"], r["n_docs"], r["newest"]) for r in lines.merged(index.runs).collect())[0] == (1, 7, 100)
    with scratch._settings():
        plan = index.runs[0].select("a", "b").join(index.runs[1].select("a", "b").hint("merge"), ["a", "b"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan
    scratch.close()

"""Staged tables: what replaces what, what is left behind, and joins of sorted runs."""

import os

from tallyvane.sources import staging


def folders(spark):
    root = staging.shared_dir(spark)
    return {x for x in os.listdir(root) if x.startswith("job-")}


def test_scratch_replaces_and_closes(spark):
    before = folders(spark)
    scratch = staging.Scratch(spark)
    first = scratch(spark.range(5), "table")
    second = scratch(first.selectExpr("id + 1 AS id"), "table")
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3, 4, 5]
    run = scratch.bucketed(spark.range(5), "run", ["id"])
    assert run.count() == 5 and len(os.listdir(scratch.folder)) == 2
    scratch.close()
    assert folders(spark) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_release_leaves_nothing(spark):
    staging.stage(spark.range(3), "one")
    staging.stage(spark.range(3), "two")
    staging.release(spark)
    assert not folders(spark)


def test_joins_of_runs_neither_shuffle_nor_sort(spark):
    scratch = staging.Scratch(spark)
    left, right = (scratch.bucketed(scratch(spark.range(0, 100, step).selectExpr("id AS a", "id * 2 AS b"), "rows").groupBy("a", "b").count(), f"run-{step}", ["a", "b"]) for step in (2, 3))
    with scratch._settings():
        joined = left.join(right.hint("merge"), ["a", "b"], "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert joined.count() == 50 - 17
    scratch.close()

"""Splits of stated sizes, retention, collapse, ensembles of scorers, bounded scans and streams of several files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import metrics, scorers, splits, trajectory
from tallyvane.sources.files import synthetic_samples
from tallyvane.sources.staging import Scratch
from tallyvane.streaming import cycles


def test_sized_split(spark):
    rows = spark.range(50).withColumnRenamed("id", "key")
    got = {r["pool"]: r["n"] for r in splits.sized_split(rows, "key", [("eval", 20), ("test", 10)]).groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert got == {"eval": 20, "test": 10}
    with pytest.raises(ValueError, match="too few"):
        splits.sized_split(rows, "key", [("eval", 40), ("test", 11)])
    clamped = splits.sized_split(rows, "key", [("eval", 40), ("test", 20)], clamp=True).groupBy("pool").count().collect()
    assert {r["pool"]: r["count"] for r in clamped} == {"eval": 40, "test": 10}
    assert {r["pool"] for r in splits.sized_split(rows, "key", [("eval", 60), ("test", 20)], clamp=True).collect()} == {"eval"}


def test_retention_without_a_base(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1e-6, 0.0), ("b", None, 0.1), ("c", 0.5, 0.48), ("d", 0.5, nan), ("e", nan, 0.2), ("f", 0.25, 0.24)], "p string, base double, now double")
    assert tuple(trajectory.retention(df, "p", "base", "now").first()) == (False, "c", 0.96)
    assert tuple(trajectory.retention(df.withColumn("now", F.when(F.col("p") == "f", 0.1).otherwise(F.col("now"))), "p", "base", "now").first()) == (True, "f", 0.4)
    assert tuple(trajectory.retention(df.filter("p in ('a', 'b', 'd', 'e')"), "p", "base", "now").first()) == (False, None, None)


def test_collapse(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", 5.0), ("c", 0.0), ("c", None), *[("d", 1.0)] * 20], "m string, s double")
    r = metrics.spectrum_collapse(df, "m", "s").first()
    assert r["n"] == 3 and r["collapse"] == pytest.approx((0.75 + 1 + 1 / 8) / 3)
    assert metrics.spectrum_collapse(df.limit(0), "m", "s").first()["collapse"] is None


def made(name, values):
    table = dict(zip("abcd", values, strict=True))
    return scorers.Scorer(name, lambda p, h: {"entail": pa.array([table[x] for x in h.to_pylist()], pa.float64())})


def test_ensembles():
    one, two, three = made("one", [0.1, 0.9, 0.5, None]), made("two", [0.4, 0.6, 0.4, 0.2]), made("three", [0.8, 0.4, 0.6, 0.9])
    texts = pa.array(["a", "b", "c", "d"])
    run = lambda how: scorers.ensemble(how, [one, two, three], how).function(texts, texts)["entail"].to_pylist()
    assert run("min") == [0.1, 0.4, 0.4, 0.2] and run("max") == [0.8, 0.9, 0.6, 0.9] and run("majority") == [0.0, 1.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        scorers.ensemble("mean", [one], "mean")
    split = scorers.by_length("split", one, two, 3)
    premises = pa.array(["x y", "x y z", "", "x y z w"])
    assert split.function(premises, texts)["entail"].to_pylist() == [0.1, 0.6, 0.5, 0.2]


def test_synthetic_samples_by_seed(spark):
    first, again, other = (sorted(r["question"] for r in synthetic_samples(spark, "fever", 9, seed).collect()) for seed in (1, 1, 2))
    assert first == again != other and len(set(first)) == 9


def test_scan_stops_at_max_passages(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(10 * k + i, f"title {i}", f"word{i} " * 400) for i in range(5)], "id long, title string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    schema = "id long, title string, text string"
    whole = cycles.scan_corpus(spark, str(tmp_path / "in"), schema, lambda b, n: seen.append(b.count()), str(tmp_path / "c1"), files=1)
    whole.awaitTermination()
    total, seen[:] = sum(seen), []
    wanted = total // 2 + 1
    cycles.scan_corpus(spark, str(tmp_path / "in"), schema, lambda b, n: seen.append(b.count()), str(tmp_path / "c2"), files=1, max_passages=wanted).awaitTermination()
    assert sum(seen) == wanted < total


def test_windows_of_a_stream_of_files(spark, tmp_path):
    rows = spark.range(400).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))").alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    for k in range(3):
        rows.filter(F.col("value") % 3 == k).write.mode("append").parquet(str(tmp_path / "events"))
    scratch = Scratch(spark)
    got = cycles.windows_now(spark, str(tmp_path / "events"), "ts timestamp_ntz, event_type string, value double", scratch)
    wanted = rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(*got.columns).collect())) and got.count() == 51
    scratch.close()

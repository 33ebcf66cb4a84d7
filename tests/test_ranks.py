"""Ranks, running sums and quantiles by pieces against plain ones, with pieces of a few rows, heavy ties and null groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import metrics, ranks, stats


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(ranks, "PIECE_ROWS", 7)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    values = [rng.choice([0.0, 0.5, 0.5, 0.5, 1.0, rng.random(), -rng.random() * 1e6, None]) for _ in range(600)]
    return [(i, rng.choice(["a", "b", "b", None]), v, float(rng.random() < 0.4), -1, "clash") for i, v in enumerate(values)]


SCHEMA = "id long, g string, v double, y double, _piece int, p string"


@pytest.mark.parametrize("descending", [False, True])
def test_numbered_equals_sorting(spark, rows, small_pieces, descending):
    df = spark.createDataFrame(rows, SCHEMA)
    got = ranks.numbered(df, ["g"], "v", "id", descending, sums={"hits": F.col("y").cast("long")}, keep_null_groups=True)
    assert got.columns == [*df.columns, "rank", "group_n", "hits"]
    wanted = set()
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g and r[2] is not None), key=lambda r: (-r[2] if descending else r[2], r[0]))
        wanted |= {(*r, k, len(mine), int(sum(x[3] for x in mine[:k]))) for k, r in enumerate(mine, 1)}
    assert {tuple(r) for r in got.collect()} == wanted


def test_no_piece_holds_a_heavy_value(spark, small_pieces):
    """A thousand rows of one value meet in pieces of the tie, not in one."""
    df = spark.range(1000).select(F.col("id"), F.lit(1.0).alias("v"))
    edges = ranks.edges_of(df, "v", "id")
    place = ranks._place(F.col("v"), edges[0])
    parts = df.groupBy(place, F.when(place % 2 == 1, ranks._below(F.col("id"), edges[1]))).count().agg(F.max("count")).first()[0]
    assert edges[0] == [1.0] and parts < 60
    assert [r["rank"] for r in ranks.numbered(df, [], "v", "id").orderBy("id").collect()] == list(range(1, 1001))


def test_names_that_rows_have_are_refused(spark):
    with pytest.raises(ValueError, match="rank"):
        ranks.numbered(spark.createDataFrame([(1, 2.0, 3)], "id long, v double, rank int"), [], "v", "id")


def test_quantiles_equal_sorting(spark, rows, small_pieces):
    df = spark.createDataFrame(rows + [(9999, "empty", None, 0.0, 0, "")], SCHEMA)
    got = ranks.exact_quantiles(df, ["g"], ["v", "y"], {"median": (0.5, True), "p95": (0.95, False), "low": (0.0, False)})
    found = {r["g"]: r for r in got.collect()}
    assert set(found) == {"a", "b", None, "empty"} and found["empty"]["v_median"] is None
    for g in ("a", "b", None):
        for k, c in ((2, "v"), (3, "y")):
            mine = sorted(r[k] for r in rows if r[1] == g and r[k] is not None)
            n = len(mine)
            assert found[g][f"{c}_median"] == pytest.approx((mine[(n - 1) // 2] + mine[n // 2]) / 2)
            assert found[g][f"{c}_p95"] == mine[math.ceil(0.95 * n) - 1] and found[g][f"{c}_low"] == mine[0]


def test_auroc_and_spearman_in_pieces(spark, rows, small_pieces):
    df = spark.createDataFrame(rows, SCHEMA)
    for r in metrics.auroc(df, "v", "y", ["g"]).collect():
        mine = [x for x in rows if x[1] == r["g"] and x[2] is not None]
        pos, neg = [x[2] for x in mine if x[3] == 1], [x[2] for x in mine if x[3] != 1]
        assert r["auroc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    import pandas as pd

    frame = pd.DataFrame([(x[1], x[2], x[0] % 50) for x in rows if x[2] is not None], columns=["g", "v", "w"])
    for r in stats.spearman(df.withColumn("w", (F.col("id") % 50).cast("double")).filter("g is not null"), "v", "w", ["g"]).collect():
        own = frame[frame["g"] == r["g"]]
        assert r["rho"] == pytest.approx(own["v"].rank().corr(own["w"].rank()))


def test_paired_intervals_cover_the_difference(spark):
    """Of 200 simulated pairs of systems about 95 in 100 intervals hold the true difference; the two sides share weights."""
    rng = random.Random(6)
    rows = []
    for trial in range(200):
        for i in range(120):
            hard = rng.random()
            rows.append((f"{trial}", trial * 1000 + i, float(rng.random() < hard), float(rng.random() < hard * 0.8)))
    df = spark.createDataFrame([*rows, ("0", None, 1.0, 0.0), ("0", 5, None, 0.0), (None, 6, 1.0, 0.0)], "g string, id long, a double, b double")
    found = {r["g"]: r for r in stats.paired_bootstrap(df, "id", "a", "b", ["g"], draws=400).collect()}
    assert len(found) == 201 and found[None]["lo"] == found[None]["hi"] == 1.0 and found["0"]["n"] == 120
    inside = [r["lo"] <= 0.1 <= r["hi"] for g, r in found.items() if g is not None]
    assert 0.90 <= sum(inside) / len(inside) <= 0.99
    same = stats.paired_bootstrap(df.withColumn("b", F.col("a")), "id", "a", "b", ["g"], draws=50)
    assert same.filter("lo != 0 or hi != 0").count() == 0
    assert stats.paired_bootstrap(df.limit(0), "id", "a", "b", ["g"]).count() == 0


def test_poisson_weights_are_exact():
    w = stats.poisson_weights(np.arange(2000), 500, 3)
    share = [(w == k).mean() for k in range(5)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08


def test_signal_matrix_of_few_rows_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("x", 1.0, 2.0, nan), ("x", 2.0, 1.0, 5.0), ("x", 3.0, 7.0, 6.0), ("x", nan, 9.0, 7.0), ("y", 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0)], "g string, a double, b double, c double")
    got = {(r["a"], r["b"]): r for r in stats.signal_matrix(df.filter("g = 'x'"), ["a", "b", "c"]).collect()}
    assert got["a", "b"]["rho"] == pytest.approx(0.5) and got["a", "c"]["rho"] is None and got["a", "c"]["n"] == 2 and got["b", "c"]["rho"] == pytest.approx(1.0)
    grouped = {(r["g"], r["a"], r["b"]): r["rho"] for r in stats.signal_matrix(df, ["a", "b"], ["g"]).collect()}
    assert grouped == {("x", "a", "b"): pytest.approx(0.5), ("y", "a", "b"): None, (None, "a", "b"): None}

"""Ranks, correlations and tests, over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tallyvane.operators.ranks import upto


def average_rank(column: str, by: list[str]):
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks per group; 0 where a side is constant.

    Ranks come from counts of distinct values by partial sums, so a value shared by many rows is sorted once, and from pieces
    of their order, so that no task has all values of a group.
    """
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_w"))

    def ranked(side: str, name: str) -> DataFrame:
        counts = known.groupBy(*by, side).agg(F.sum("_w").alias("_c"))
        return upto(counts, by, side, {"_before": "_c"}).select(*by, side, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name))

    both = known.join(ranked(x, "_rx"), [*by, x]).join(ranked(y, "_ry"), [*by, y])
    w = F.col("_w")
    sums = both.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("_rx")).alias("sx"), F.sum(w * F.col("_ry")).alias("sy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("yy"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("xy"),
    )
    top = F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("yy") - F.col("sy") * F.col("sy")
    return sums.select(*by, F.when((vx <= 0) | (vy <= 0), 0.0).otherwise(top / F.sqrt(vx) / F.sqrt(vy)).alias("rho"))


def signal_matrix(rows: DataFrame, signals: list[str], by: list[str] | None = None) -> DataFrame:
    """by, a, b, n, rho for each pair of signals: rank correlation over the rows that have both; null below three of them and
    where a side is constant. NaN counts as missing. One scan serves all pairs.
    """
    by = by or []
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), known(a).alias("x"), known(b).alias("y")) for a, b in pairs))
    long = rows.select(*by, F.explode(each).alias("e")).select(*by, "e.*")
    keys = [*by, "a", "b"]
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    facts = long.groupBy(*keys).agg(F.count(F.when(both, 1)).alias("n"), *(f(F.when(both, F.col(c))).alias(f"{c}_{f.__name__}") for c in ("x", "y") for f in (F.min, F.max)))
    found = spearman(long, "x", "y", keys)
    varied = (F.col("n") >= 3) & (F.col("x_min") != F.col("x_max")) & (F.col("y_min") != F.col("y_max"))
    joined = facts.join(found, keys, "left") if not by else facts.alias("f").join(found.alias("r"), [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left").select("f.*", "r.rho")
    return joined.select(*keys, "n", F.when(varied, F.col("rho")).alias("rho"))


def signal_clusters(matrix: DataFrame, signals: list[str], limit: float) -> DataFrame:
    """signal, cluster: signals that pairs of correlation from `limit`, either way, hold together; the cluster is its first.

    The matrix has a row a pair of signals, so it is read on the driver.
    """
    root = {s: s for s in signals}
    for r in matrix.filter(F.abs("rho") >= limit).select("a", "b").collect():
        low, high = sorted((root[r["a"]], root[r["b"]]), key=signals.index)
        root = {s: low if c == high else c for s, c in root.items()}
    return matrix.sparkSession.createDataFrame(list(root.items()), "signal string, cluster string")


def wilcoxon(pairs: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """by, n, w, z of the signed-rank test: differences of 0 are dropped, ties share ranks, w is the smaller rank sum, z its
    normal approximation with the ties' correction. Without a difference n is 0, w 0 and z 0. wilcoxon_p adds p.

    Sizes of differences are counted first, so ranks come from one row a distinct size.
    """
    d = F.col(difference)
    sizes = pairs.filter(d != 0).groupBy(*by, F.abs(d).alias("size")).agg(F.count(F.when(d > 0, 1)).alias("up"), F.count(F.when(d < 0, 1)).alias("down"))
    t = F.col("up") + F.col("down")
    ranked = upto(sizes.withColumn("t", t), by, "size", {"below": "t"}).withColumn("rank", F.col("below") + (t + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum(t).alias("n"), F.sum(F.col("rank") * F.col("up")).alias("r_up"), F.sum(F.col("rank") * F.col("down")).alias("r_down"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    tested = sums.select(*by, "n", F.least("r_up", "r_down").alias("w"), ((F.least("r_up", "r_down") - n * (n + 1) / 4) / spread).alias("z"))
    every = pairs.filter(d.isNotNull()).select(*by).distinct()
    return every.join(tested, by, "left").na.fill(0, ["n"]).na.fill(0.0, ["w", "z"])


def wilcoxon_p(tested: DataFrame) -> DataFrame:
    """tested with the two-sided p of its z; 1 without a difference."""
    return tested.withColumn("p", F.when(F.col("n") == 0, 1.0).otherwise(chi2_p(F.col("z") * F.col("z"))))


def mcnemar(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Discordant counts and the chi-square with continuity correction; 0 without disagreement."""
    n10 = F.count(F.when((F.col(a) == 1) & (F.col(b) == 0), 1))
    n01 = F.count(F.when((F.col(a) == 0) & (F.col(b) == 1), 1))
    counted = pairs.groupBy(*by).agg(F.count("*").alias("n"), n10.alias("n10"), n01.alias("n01"))
    gap = F.greatest(F.abs(F.col("n10") - F.col("n01")) - 1, F.lit(0))
    return counted.withColumn("chi2", F.when(F.col("n10") + F.col("n01") == 0, 0.0).otherwise(F.pow(gap, 2) / (F.col("n10") + F.col("n01"))))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


def mcnemar_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", chi2_p("chi2"))


def holm(rows: DataFrame, p: str, by: list[str], tie: str) -> DataFrame:
    """rows with Holm's adjusted p in p_holm, within groups; one row a test, so groups are small."""
    order = Window.partitionBy(*by).orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(*by))
    stepped = rows.withColumn("_rn", F.row_number().over(order)).withColumn("_step", F.least(F.lit(1.0), F.col(p) * (m - F.col("_rn") + 1)))
    return stepped.withColumn("p_holm", F.max("_step").over(Window.partitionBy(*by).orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_rn", "_step")


def bootstrap_mean(rows: DataFrame, value: str, by: list[str], draws: int = 200, seed: int = 7) -> DataFrame:
    """mean, lo and hi of the mean's 95 % interval by Poisson bootstrap.

    Rows are counted by value first. In a draw, n rows of Poisson(1) weights weigh Poisson(n) together, taken here as its
    normal approximation from a hash of group, value and draw: what is multiplied out is one row a group and value.
    """
    counted = rows.groupBy(*by, F.coalesce(F.col(value), F.lit(0.0)).alias("v")).agg(F.count("*").alias("n"))
    drawn = counted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *by, "v", "draw"), F.lit(1 << 40)) + 1) / float(1 << 40)
    z = F.sqrt(-2.0 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))
    weighed = drawn.withColumn("w", F.greatest(F.lit(0.0), F.rint(F.col("n") + F.sqrt("n") * z)))
    means = weighed.groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    bounds = means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))
    return counted.groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).join(bounds, by)


def poisson_weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Exact Poisson(1) weights, a row a key and a column a draw, by inverse distribution from a hash of both."""
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed * draws + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    uniform = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    # beyond 20 the distribution is 1 in doubles
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(steps, uniform, side="right").astype(np.float64)


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, by: list[str], draws: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """by, n, mean_a, mean_b, delta and the interval lo to hi of delta = mean of a - b, by Poisson bootstrap.

    A pair has one weight in a draw, the same for both systems, from a hash of its key, so pairs are drawn together; a task
    adds up the draws of its rows as they stream by, and what is shuffled is a row a group, task and draw. Pairs that lack a
    side or a key are left out; repeated keys share their weights; null groups are groups.
    """
    groups = [f"g{i}" for i in range(len(by))]
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(key).isNotNull())
    rows = known.select(F.struct(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.lit(0).alias("one")).alias("g"), F.xxhash64(key).alias("k"), (F.col(a) - F.col(b)).cast("double").alias("d"))
    group_type = rows.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            values = batch.column("g").to_pylist()
            ids = {}
            code = np.array([ids.setdefault(tuple(v.values()), len(ids)) for v in values])
            keys, d = batch.column("k").to_numpy(), batch.column("d").to_numpy()
            for group, c in ids.items():
                at = code == c
                w = poisson_weights(keys[at], draws, seed)
                kept = held.setdefault(group, [batch.column("g")[int(np.flatnonzero(at)[0])], np.zeros(draws), np.zeros(draws)])
                kept[1] += w.sum(axis=0)
                kept[2] += d[at] @ w
        for value, n, total in held.values():
            arrays = [pa.repeat(value, draws), pa.array(np.arange(draws)), pa.array(n), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["g", "draw", "w", "t"])

    drawn = rows.mapInArrow(run, f"g {group_type}, draw long, w double, t double").groupBy("g", "draw").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    bounds = drawn.groupBy("g").agg(F.expr(f"percentile(m, {tail})").alias("lo"), F.expr(f"percentile(m, {1 - tail})").alias("hi"))  # `draws` values a group
    means = known.groupBy(F.struct(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.lit(0).alias("one")).alias("g")).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(F.col(a) - F.col(b)).alias("delta"))
    return means.join(bounds, "g").select(*(F.col(f"g.{g}").alias(c) for c, g in zip(by, groups, strict=True)), "n", "mean_a", "mean_b", "delta", "lo", "hi")

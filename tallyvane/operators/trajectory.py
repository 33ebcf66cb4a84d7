"""Decisions over the cycles of a run: when to halt, when to stop, and in which batches to work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLLAPSE, ZERO_CYCLES = 0.95, 2
CES_EPS, STORAGE, RETENTION, SIGNALS = 0.002, 0.05, 0.93, 2
#: Ordinals that are ranked together.
STRETCH = 100_000


def halt(rates: DataFrame, scores: DataFrame, window: int = ZERO_CYCLES, limit: float = COLLAPSE) -> DataFrame:
    """scores (cycle, collapse) with action and relax: "halt" from the limit of the collapse score; else "relax_alpha" with the
    benchmarks whose admission rate was 0 in each of the last `window` cycles; else "continue".

    rates: cycle, benchmark, rate, a row a cycle and benchmark; a null rate is inactive and excuses its benchmark.
    """
    last = rates.select("cycle").distinct().orderBy(F.desc("cycle")).limit(window)
    zero = rates.join(F.broadcast(last), "cycle").groupBy("benchmark").agg(F.count("rate").alias("n"), F.max("rate").alias("top")).filter((F.col("n") == window) & (F.col("top") == 0.0))
    listed = zero.agg(F.array_sort(F.collect_list("benchmark")).alias("zero"))  # one row, a name a benchmark
    halts = F.coalesce((F.col("collapse") >= limit) & ~F.isnan("collapse"), F.lit(False))
    nothing = F.array().cast("array<string>")
    return scores.crossJoin(F.broadcast(listed)).select(
        *scores.columns, F.when(halts, "halt").when(F.size("zero") > 0, "relax_alpha").otherwise("continue").alias("action"), F.when(halts, nothing).otherwise(F.col("zero")).alias("relax")
    )


def early_stop(cycles: DataFrame, eps: float = CES_EPS, storage: float = STORAGE, floor: float = RETENTION, required: int = SIGNALS) -> DataFrame:
    """cycles (cycle, ces, storage_rate, retention; one row each) with flat (two small moves of ces in a row), saturated (little
    is stored), retained (two cycles at or under the floor of retention) and should_stop (so many signals as required)."""
    w = Window.orderBy("cycle")
    small = lambda a, b: F.abs(a - b) < eps
    one, two = F.lag("ces").over(w), F.lag("ces", 2).over(w)
    no = lambda c: F.coalesce(c, F.lit(False))
    out = cycles.withColumns(
        {
            "flat": no(small(F.col("ces"), one) & small(one, two)), "saturated": no(F.col("storage_rate") < storage),
            "retained": no((F.col("retention") <= floor) & (F.lag("retention").over(w) <= floor)),
        }
    )
    return out.withColumn("should_stop", F.col("flat").cast("int") + F.col("saturated").cast("int") + F.col("retained").cast("int") >= required)


def tier_batches(rows: DataFrame, size: int) -> DataFrame:
    """rows (ordinal, tier, ...) with batch and slot: a tier's rows in the order of their ordinals, `size` at a time.

    Ranks are made within stretches of ordinals and moved by the counts of the stretches before, so no task has a whole tier.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col("ordinal") / STRETCH))
    counts = cut.groupBy("tier", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tier").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tier", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("tier", "_stretch").orderBy("ordinal")) - 1
    ranked = cut.withColumn("_k", within).join(starts, ["tier", "_stretch"]).withColumn("_k", F.col("_k") + F.col("_start"))
    return ranked.withColumns({"batch": F.floor(F.col("_k") / size), "slot": (F.col("_k") % size).cast("int")}).select(*rows.columns, "batch", "slot")


def retention(scores: DataFrame, probe: str, base: str, now: str, floor: float = RETENTION, tiny: float = 1e-6) -> DataFrame:
    """abort, worst, worst_ratio: whether a probe keeps less than `floor` of what it had, and the one that keeps least.

    A probe whose base is missing or at most `tiny`, or that has no score now, has no ratio and stops nothing; without any
    ratio nothing is worst. Ties go to the first name.
    """
    known = F.col(base).isNotNull() & ~F.isnan(F.col(base)) & (F.col(base) > tiny) & F.col(now).isNotNull() & ~F.isnan(F.col(now))
    ratios = scores.select(F.col(probe).alias("p"), F.when(known, F.col(now) / F.col(base)).alias("r"))
    worst = F.min(F.when(F.col("r").isNotNull(), F.struct("r", "p")))
    return ratios.agg(F.coalesce(F.bool_or(F.col("r") < floor), F.lit(False)).alias("abort"), worst.alias("w")).select("abort", F.col("w.p").alias("worst"), F.col("w.r").alias("worst_ratio"))

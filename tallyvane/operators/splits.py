"""Seeded samples and disjoint splits by order of a hash, the same on every run and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42
#: Ranges of the hash that are ranked apart when all rows are put in one order.
RANGES = 256


def seeded_key(key: str, seed: int = SEED) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 16)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(seeded_key(key, seed), key).limit(n)


def seeded_position(rows: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """rows with their position from 0 in hash order and the number of all rows, without sorting all in one task.

    The hash's first two digits cut rows into ranges, which are ranked apart; what stands before a range is a sum over a
    table of RANGES counts.
    """
    hashed = rows.withColumn("_h", seeded_key(key, seed)).withColumn("_r", F.substring("_h", 1, 2))
    counts = hashed.groupBy("_r").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("n_rows"))
    within = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key))
    return hashed.withColumn("_k", within).join(F.broadcast(starts), "_r").withColumn("position", F.col("_start") + F.col("_k") - 1).drop("_h", "_r", "_k", "_start")  # RANGES rows


def disjoint_split(rows: DataFrame, key: str, shares: Sequence[tuple[str, float]], seed: int = SEED) -> DataFrame:
    """rows with the pool that their position in hash order falls into; shares that do not sum to one are refused."""
    if abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("shares must sum to one")
    placed = seeded_position(rows, key, seed)
    at = F.col("position") / F.col("n_rows")
    pool, edge, edges = F.lit(shares[-1][0]), 0.0, []
    for name, share in shares[:-1]:
        edge += share
        edges.append((name, round(edge, 12)))
    for name, top in reversed(edges):
        pool = F.when(at < top, name).otherwise(pool)
    return placed.withColumn("pool", pool).drop("position", "n_rows")


def sized_split(rows: DataFrame, key: str, sizes: Sequence[tuple[str, int]], clamp: bool = False, seed: int = SEED) -> DataFrame:
    """rows with the pool that their position in hash order falls into, pools of stated sizes one after the other; what is left
    over is in none.

    Too few rows are an error; with `clamp`, as for benchmarks that are only transferred to, the first pools are filled as far
    as rows go and the last ones are smaller or empty.
    """
    wanted, there = sum(n for _, n in sizes), rows.count()
    if there < wanted and not clamp:
        raise ValueError(f"{there} rows are too few for {' + '.join(f'{name}={n}' for name, n in sizes)}")
    placed, pool, upto = seeded_position(rows, key, seed), F.lit(None).cast("string"), wanted
    for name, n in reversed(sizes):
        pool = F.when(F.col("position") < upto, name).otherwise(pool)
        upto -= n
    return placed.withColumn("pool", pool).filter("pool is not null").drop("position", "n_rows")

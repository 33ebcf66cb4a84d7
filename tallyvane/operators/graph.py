"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps after which the loop gives up; each at least halves the depth of the trees, so this is never met in practice.
MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return pairs.filter("u <> v").distinct()


def connected_components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, component) for every node on an edge (u, v) of comparable keys; the component is the least node in it.

    `write` stores a table and reads it back, which cuts lineage between steps. Loops, repeated edges and nulls are ignored;
    no edges give no rows. Only counts reach the driver.
    """
    now = write(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(MAX_STEPS):
        now = write(_star(_star(now, True), False), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

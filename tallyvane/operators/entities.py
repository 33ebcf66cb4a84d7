"""Entities that answers and passages share, by their own names or by aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias_table(pairs: DataFrame) -> DataFrame:
    """(name, other) in lower case from (surface, alias): a surface and its aliases all stand for each other.

    Null names are left out; a table of aliases per surface is expected to be short. An empty table gives no rows.
    """
    known = pairs.filter("surface is not null and alias is not null")
    members = known.select("surface", F.explode(F.array("surface", "alias")).alias("x")).distinct()
    return members.withColumnRenamed("x", "a").join(members.withColumnRenamed("x", "b"), "surface").select(F.lower("a").alias("name"), F.lower("b").alias("other")).distinct()


def alias_overlap(rows: DataFrame, keys: list[str], said: str, found: str, aliases: DataFrame) -> DataFrame:
    """rows with alias_overlap: the share of the entities in array `said` that array `found` names too, case aside, by
    themselves or by an alias of either side. One half where either has no entity; keys name a row."""

    def with_aliases(names: DataFrame) -> DataFrame:
        return names.union(names.join(aliases, F.col("s") == F.col("name")).select(*names.columns[:-1], F.col("other"))).distinct()

    there = with_aliases(rows.select(*keys, F.explode(found).alias("s")).withColumn("s", F.lower("s")).distinct())
    asked = with_aliases(rows.select(*keys, F.posexplode(said).alias("i", "s")).withColumn("s", F.lower("s")))
    covered = asked.join(there, [*keys, "s"]).select(*keys, "i").distinct().groupBy(*keys).agg(F.count("*").alias("covered"))
    neither = (F.coalesce(F.size(said), F.lit(0)) <= 0) | (F.coalesce(F.size(found), F.lit(0)) <= 0)
    share = F.when(neither, 0.5).otherwise(F.coalesce("covered", F.lit(0)) / F.size(said))
    return rows.join(covered, keys, "left").withColumn("alias_overlap", share).drop("covered")

"""Joins with a rule of their own: labels that must be there, pairs within a list, demonstrations apart from what is evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlay(rows: DataFrame, labels: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """rows with `value` replaced by the label of their key and kept as `value`_stored. A row whose key has no label raises an
    error when it is read; a null label is a label. Keys of labels are expected to be unique."""
    marked = labels.select(F.col(key), F.col(label).alias("_label"), F.lit(True).alias("_there"))
    joined = rows.withColumnRenamed(value, f"{value}_stored").join(marked, key, "left")
    missing = F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.when(F.col("_there"), F.col("_label")).otherwise(missing.cast(labels.schema[label].dataType))).drop("_label", "_there")


def pairs_within(rows: DataFrame, key: str, items: str) -> DataFrame:
    """key, i, j, left, right for every two items i < j of an array: the few chains or passages of one query. Null and short
    arrays have no pairs."""
    n = F.size(items)
    firsts = rows.filter(n > 1).select(key, items, F.explode(F.sequence(F.lit(0), n - 2)).alias("i"))
    both = firsts.select(key, items, "i", F.explode(F.sequence(F.col("i") + 1, n - 1)).alias("j"))
    return both.select(key, "i", "j", F.get(items, F.col("i")).alias("left"), F.get(items, F.col("j")).alias("right"))


def demonstrations(pool: DataFrame, evaluated: DataFrame, by: str, key: str, shots: int, seed: str) -> DataFrame:
    """by, key, question, gold, shot: so many rows of each group with a question and a gold, first by a seeded hash of their
    key, none of them evaluated."""
    clean = pool.withColumns({"question": F.trim("question"), "gold": F.trim("gold")}).filter("question <> '' and gold <> ''")
    free = clean.join(evaluated.select(key), key, "left_anti")
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return free.withColumn("shot", F.row_number().over(order)).filter(F.col("shot") <= shots).select(by, key, "question", "gold", "shot")

"""What the operators of this subpackage share: word patterns, joins and null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as Java and RE2 both read it: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_bounded(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str, rows: int, limit: int = 100_000) -> DataFrame:
    """Join where `small` has `rows` rows: broadcast up to `limit`, beyond it a plain join that AQE may split at hot keys."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inline_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a DataFrame, by SQL functions alone."""
    import json

    text = json.dumps(rows, separators=(",", ":"))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet: name, with as many underscores added as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

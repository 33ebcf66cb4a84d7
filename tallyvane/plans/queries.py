"""A registry: a query is a function of (spark, sf_dir), with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def over(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over DataFrames by name, as they stand after FROM; no view is left in the session."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **tables)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register

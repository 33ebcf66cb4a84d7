"""Mixing sources to target weights: words per source give each source a repetition rate, and each document is emitted
floor(rate) times plus once more with the rate's fraction as probability, drawn from a hash of its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.llm.common import WORD, join_bounded, n_words, table, unused
from tallyvane.sources.staging import stage

#: No source may be repeated more often than this.
MAX_RATE = 3
#: Weights that sources take in turn, in code point order of their names, null last.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and key alone: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Shares of all words follow the weights; a target stops at MAX_RATE times its source, and what it leaves is shared anew
    among the others. With sources sorted by cap/weight, the level of the others, if all before it have stopped, rises up to
    the last that does and falls after it, so the final level is the largest of these.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * MAX_RATE)
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left_words").cast("double") / F.col("left_weight")).over(everything))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def plan_mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies.

    A null text has size 0 and is emitted like any other document of its source; a null source is a source of its own, last
    in order; a source without words has rate 0. Repeated rows of one doc_id share a draw. Columns of docs that have the
    names of the new ones are replaced, others are kept; an empty table gives no rows. Sources are ranked in one task, a row
    a source: they are expected to be named collections, not hosts or pages.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(F.col("text")))
    sums = stage(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources, name = sums.count(), unused(docs, "target_source")
    right = source_targets(sums).withColumnRenamed("source", name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        join_bounded(docs, right, docs["source"].eqNullSafe(right[name]), "inner", n_sources)
        .drop(name)
        .withColumn("copies", (F.floor(rate) + (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long"))
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of docs as often as its source's rate says, with the columns of docs as they are.

    Nulls, repeated rows and empty tables are treated as by plan_mix; each row travels as a struct, so that none of its
    columns meets one of the plan's.
    """
    planned = plan_mix(docs.select("doc_id", "source", "text", F.struct("*").alias("row")), seed).filter("copies > 0")
    of = F.col("row").getField
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(of(c).alias(c) for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM s
), l AS (
    SELECT *, (sum(source_size) OVER () - COALESCE(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - COALESCE(sum(weight) OVER b, 0))::DOUBLE AS lv
    FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(cap::DOUBLE, (max(lv) OVER ()) * weight::DOUBLE) AS target FROM l
), r AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0e0 END AS rate,
           ('0x' || substr(md5('{SEED}:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 AS u
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
    SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

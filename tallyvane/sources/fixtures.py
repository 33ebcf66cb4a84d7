"""The driver's tables in the shapes that the analytics expect, each also as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Answer records made from lineitem; expressions that Spark and DuckDB both read.
SAMPLE_COLUMNS = {
    "okey": "l_orderkey",
    "cycle": "CAST(l_partkey % 6 AS INT)",
    "benchmark": "CASE l_suppkey % 5 WHEN 0 THEN 'fever' WHEN 1 THEN 'triviaqa' WHEN 2 THEN 'commonsense_qa' WHEN 3 THEN 'truthfulqa' ELSE 'strategyqa' END",
    "tier": "CAST(CASE l_linenumber % 4 WHEN 0 THEN -1 ELSE l_linenumber % 4 END AS INT)",
    "em": "CASE WHEN l_returnflag = 'A' THEN 1e0 WHEN l_returnflag = 'N' AND l_partkey % 11 = 0 THEN NULL ELSE 0e0 END",
    "u_stored": "l_discount * 10e0",
    "p_ground_max": "l_tax * 12.5e0",
    "p_entail": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity / 50e0 END",
    "p_ground_atomic": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_partkey % 20) / 20e0 END",
    "p_contra": "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE (l_suppkey % 8) / 16e0 END",
    "q_a_relevance": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE (l_orderkey % 16) / 16e0 END",
    "u_internal": "(l_orderkey % 8) / 8e0",
    "latency_ms": "l_extendedprice",
    "prediction": "CASE WHEN l_partkey % 17 = 0 THEN '<concise factual answer>' WHEN l_partkey % 13 = 0 THEN 'The context does not mention it' WHEN l_partkey % 19 = 0 THEN repeat('long ', 130) ELSE concat('answer ', l_linestatus) END",
}
SAMPLES_SQL = "SELECT *, CASE WHEN u_stored >= 0.6e0 THEN 'STORE' WHEN u_stored >= 0.45e0 THEN 'DEFERRED' WHEN p_ground_max < 0.2e0 THEN 'ABSTAIN' ELSE 'DISCARD' END AS decision FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SAMPLE_COLUMNS.items()) + " FROM lineitem) raw_samples"


def decision(u_stored: str = "u_stored", p_ground_max: str = "p_ground_max"):
    """STORE from 0.60, DEFERRED from 0.45, else ABSTAIN below 0.20 of grounding, else DISCARD."""
    u = F.col(u_stored)
    return F.when(u >= 0.60, "STORE").when(u >= 0.45, "DEFERRED").when(F.col(p_ground_max) < 0.20, "ABSTAIN").otherwise("DISCARD")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records; only the columns a query uses reach the scan."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in SAMPLE_COLUMNS.items()))
    return raw.withColumn("decision", decision())


#: Memory entries made from embeddings.
MEMORY_COLUMNS = {
    "entry_id": "vec_id",
    "embedding": "embedding",
    "pool": "CASE label % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'transfer' ELSE 'untagged' END",
    "answer": "concat('answer ', CAST(label AS STRING))",
    "u_stored": "(vec_id % 20) / 20e0",
    "storage_cycle": "CAST(vec_id % 6 AS INT)",
    "retrieval_count": "vec_id % 12",
    "success_rate": "(vec_id % 5) / 4e0",
    "hit_counter": "vec_id % 15",
    "age_s": "(vec_id % 50) * 1e0",
    "retroverified": "vec_id % 4 = 0",
    "source_benchmark": "CASE label % 3 WHEN 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'fever' ELSE 'triviaqa' END WHEN 1 THEN 'truthfulqa' END",
    "merged_names": "CASE WHEN label % 3 = 0 AND vec_id % 5 = 0 THEN 'commonsense_qa,fever' WHEN label % 3 = 1 AND vec_id % 7 = 0 THEN 'strategyqa' ELSE '' END",
}
MEMORY_SQL = "SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in MEMORY_COLUMNS.items()) + " FROM embeddings"


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("merged_names") == "", F.array().cast("array<string>")).otherwise(F.split("merged_names", ","))
    return table(spark, sf_dir, "embeddings").selectExpr(*(f"{e} AS {n}" for n, e in MEMORY_COLUMNS.items())).withColumn("merged_benchmarks", listed)

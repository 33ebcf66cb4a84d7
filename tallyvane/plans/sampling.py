"""Splits, pools and deduplicated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.functions.text import content_id
from tallyvane.operators import pools, splits
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import SAMPLES_SQL, samples, table

_CID = "substr(sha256(substr(trim(text), 1, 500)), 1, 16)"
_HASH = "substr(sha256(concat('42:', doc_id::VARCHAR)), 1, 16)"


@query("d1_w5_dedupe_first", f"WITH c AS (SELECT doc_id, {_CID} AS cid, row_number() OVER (PARTITION BY {_CID} ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, cid FROM c WHERE rn = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content id: a partial aggregate instead of a window, so copies shrink before the shuffle."""
    return table(spark, d, "documents").groupBy(content_id(F.col("text")).alias("cid")).agg(F.min("doc_id").alias("doc_id"))


@query("s5_seeded_sample", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS rn FROM documents) WHERE rn <= 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents without replacement, by order of a hash: a top-k, not a sort of everything."""
    return splits.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("d2_w6_disjoint_split", f"WITH k AS (SELECT min(doc_id) AS doc_id, {_CID} AS cid FROM documents GROUP BY cid), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS rn, count(*) OVER () AS n FROM k) SELECT doc_id, CASE WHEN (rn - 1)::DOUBLE / n < 0.1e0 THEN 'calibration' WHEN (rn - 1)::DOUBLE / n < 0.3e0 THEN 'evaluation' ELSE 'training' END AS pool FROM r")
def disjoint_split(spark: SparkSession, d: str) -> DataFrame:
    kept = dedupe_first(spark, d).select("doc_id")
    return splits.disjoint_split(kept, "doc_id", (("calibration", 0.1), ("evaluation", 0.2), ("training", 0.7)))


@query("d4_union_sets", f"SELECT {_CID} AS cid, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def union_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each content id."""
    return table(spark, d, "documents").groupBy(content_id(F.col("text")).alias("cid")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("d5_set_operations", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both_n, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_n")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    both = docs.intersect(labels).agg(F.count("*").alias("both_n"))
    return both.crossJoin(docs.subtract(labels).agg(F.count("*").alias("only_n")))  # one row each


@query("d6_temperature_targets", f"WITH s AS ({SAMPLES_SQL}), c AS (SELECT benchmark, count(*) AS n FROM s WHERE decision = 'STORE' GROUP BY 1), p AS (SELECT benchmark, n, pow(n::DOUBLE / sum(n) OVER (), 0.5e0) AS w FROM c) SELECT benchmark, n, round_even(1000 * w / sum(w) OVER (), 0)::BIGINT AS target FROM p")
def temperature_targets(spark: SparkSession, d: str) -> DataFrame:
    counts = samples(spark, d).filter("decision = 'STORE'").groupBy("benchmark").agg(F.count("*").alias("n"))
    return pools.temperature_targets(counts, 1000, 2.0)


@query("d6_d8_reweighted_pool")
def reweighted_pool(spark: SparkSession, d: str) -> DataFrame:
    """Rows a benchmark gives to a pool of 1000 after temperature, floor, share cap and resizing."""
    rows = samples(spark, d).filter("decision = 'STORE'").withColumn("key", F.concat_ws(":", "okey", "latency_ms", "u_stored"))
    return pools.reweight(rows, "benchmark", "key", 1000).groupBy("benchmark").agg(F.count("*").alias("n"), F.max("copy_no").alias("most_copies"))


@query("d9_balanced_sample", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY substr(sha256(concat('42:', doc_id::VARCHAR)), 1, 16), doc_id) AS rn FROM labels) SELECT doc_id, quality FROM r WHERE rn <= 20")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("quality").orderBy(splits.seeded_key("doc_id"), "doc_id")
    return table(spark, d, "labels").select("doc_id", "quality").withColumn("rn", F.row_number().over(by)).filter("rn <= 20").drop("rn")


@query("p3_training_gate", f"WITH s AS ({SAMPLES_SQL}) SELECT benchmark, count(*) AS n FROM s WHERE u_stored >= 0.7e0 AND benchmark IN ('fever', 'triviaqa', 'commonsense_qa') GROUP BY 1")
def training_gate(spark: SparkSession, d: str) -> DataFrame:
    named = samples(spark, d).withColumn("named", F.array("benchmark"))
    inside = F.size(F.array_except("named", F.array(*map(F.lit, ("fever", "triviaqa", "commonsense_qa"))))) == 0
    return named.filter((F.col("u_stored") >= 0.7) & inside).groupBy("benchmark").agg(F.count("*").alias("n"))


@query("a41_histograms", "SELECT event_type, CAST(value / 20 AS INT) AS bucket, count(*) AS n FROM (SELECT event_type, floor(value / 20) * 20 AS value FROM events) GROUP BY ALL")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 20).cast("int").alias("bucket")).agg(F.count("*").alias("n"))

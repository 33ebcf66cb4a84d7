"""Queries over what models put out: objects in free text, lenient scores, and verification with a scorer of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import capability as K
from tallyvane.functions import jsons as J
from tallyvane.operators import scorers
from tallyvane.plans.answers import asked
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import SAMPLE_COLUMNS, table


@query(
    "f42_annotations",
    "WITH t AS (SELECT doc_id, text || ' {\"a\": \"}\"} \\ ' AS answer, doc_id % 11 = 0 AS cut FROM documents) "
    "SELECT doc_id, NOT cut AS found, CASE WHEN NOT cut THEN md5(answer) END AS answer, NOT cut AND answer IS NOT NULL AND doc_id % 5 <> 0 AND doc_id % 3 = 2 AND doc_id % 7 BETWEEN 1 AND 5 AS valid FROM t",
)
def annotations(spark: SparkSession, d: str) -> DataFrame:
    """An annotation amid prose for each document, whole text and all: found, read and checked; some are broken off."""
    answer = F.concat("text", F.lit(' {"a": "}"} \\ '))
    made = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 5 == 0, "[Maybe]").otherwise("[Retrieve]").alias("retrieve_decision"),
            F.array_repeat(F.lit("[Relevant]"), (F.col("doc_id") % 3).cast("int")).alias("passage_decisions"),
            F.lit("[Supported]").alias("support_decision"),
            F.concat(F.lit("[Useful:"), F.col("doc_id") % 7, F.lit("]")).alias("useful_score"),
            answer.alias("annotated_answer"),
        )
    )
    said = F.when(F.col("doc_id") % 11 == 0, F.expr("substring(j, 1, length(j) - 1)")).otherwise(F.concat(F.lit("Here it is: "), "j", F.lit(" Hope {this} \"helps }")))
    rows = table(spark, d, "documents").withColumn("j", made).select("doc_id", J.json_object(said).alias("v"))
    found = F.try_variant_get("v", "$.annotated_answer", "string")
    return rows.select("doc_id", F.col("v").isNotNull().alias("found"), F.md5(found).alias("answer"), J.valid_annotation(F.col("v"), F.lit(2)).alias("valid"))


_SAID = (
    "CASE l_partkey % 10 WHEN 0 THEN 'I think. Answer: (B) because A' WHEN 1 THEN 'A rug is C' WHEN 2 THEN 'Answer - yes, No' WHEN 3 THEN 'true or False' WHEN 4 THEN 'It REFUTES; answer: Supports' "
    "WHEN 5 THEN 'supports? not-enough info' WHEN 6 THEN '' WHEN 7 THEN 'Answer: nothing' WHEN 8 THEN 'Answer: A. Then answer: D. E' END"
)
_GOLD = "CASE l_orderkey % 8 WHEN 0 THEN ' b' WHEN 1 THEN 'C' WHEN 2 THEN 'True' WHEN 3 THEN '0' WHEN 4 THEN 'supports' WHEN 5 THEN 'Not_Enough-Info' WHEN 6 THEN '' END"
_LINE = r"trim(regexp_extract_all(said, '(?i)answer\s*[:\-]\s*([^\n\r.]+)', 1)[-1])"
_OF = lambda p: f"COALESCE(nullif(regexp_extract(COALESCE({_LINE}, ''), '{p}', 1), ''), regexp_extract_all(said, '{p}', 1)[-1])"
_YES = lambda x: f"CASE WHEN {x} IN ('yes', 'true', '1') THEN 'yes' WHEN {x} IN ('no', 'false', '0') THEN 'no' ELSE {x} END"
_VERDICT = lambda x: f"CASE WHEN upper({x}) = 'NEI' THEN 'NOT ENOUGH INFO' ELSE trim(replace(replace(upper({x}), '-', ' '), '_', ' ')) END"


@query(
    "f35_capability",
    f"WITH s AS (SELECT {SAMPLE_COLUMNS['benchmark']} AS benchmark, COALESCE({_SAID}, '') AS said, {_GOLD} AS gold FROM lineitem), "
    f"e AS (SELECT benchmark, gold, {_OF(K.CHOICE.replace('(?U)', ''))} AS choice, lower({_OF(K.YES_NO.replace('U', '', 1))}) AS yes_no, {_OF(K.VERDICT.replace('U', '', 1))} AS verdict FROM s), "
    f"c AS (SELECT benchmark, CASE WHEN COALESCE(gold, '') = '' THEN NULL WHEN benchmark = 'commonsense_qa' THEN COALESCE(choice = upper(trim(gold)), FALSE)::INT::DOUBLE WHEN benchmark = 'strategyqa' THEN COALESCE({_YES('yes_no')} = {_YES('lower(gold)')}, FALSE)::INT::DOUBLE WHEN benchmark = 'fever' THEN COALESCE({_VERDICT('verdict')} = {_VERDICT('gold')}, FALSE)::INT::DOUBLE END AS em FROM e) "
    "SELECT benchmark, count(*) AS n, count(em) AS scored, sum(em) AS right FROM c GROUP BY benchmark".replace("AS right", 'AS "right"'),
)
def capability(spark: SparkSession, d: str) -> DataFrame:
    """Lenient scores of made answers of every form, by benchmark."""
    rows = table(spark, d, "lineitem").selectExpr(f"{SAMPLE_COLUMNS['benchmark']} AS benchmark", f"{_SAID} AS said", f"{_GOLD} AS gold")
    em = K.capability_em(F.col("said"), F.col("gold"), F.col("benchmark"))
    return rows.select("benchmark", em.alias("em")).groupBy("benchmark").agg(F.count("*").alias("n"), F.count("em").alias("scored"), F.sum("em").alias("right"))


#: Knots of two signals, as a calibration would give them.
KNOTS = {"u_internal": [(0.0, 0.1), (1.0, 0.9)], "p_ground_max": [(0.0, 0.05), (0.5, 0.5), (1.0, 0.95)]}


@query("v1_v8_verify")
def verified(spark: SparkSession, d: str) -> DataFrame:
    """From signals to decisions: each document's question is answered, its whole text and another line are the passages."""
    rows = asked(spark, d).select(
        "doc_id", "query", "answer", F.array("text", F.concat("lang", F.lit(" the answer is "), "source")).alias("passages"),
        ((F.col("doc_id") % 10) / 10).alias("u_token"), ((F.col("doc_id") % 7) / 10).alias("u_dropout"),
    )
    done = scorers.verify(rows, "doc_id", "word_overlap", KNOTS)
    return done.select("doc_id", "kind", *(F.round(c, 9).alias(c) for c in ("p_ground_max", "p_ground_mean", "u_internal", "u_stored")), "early", "decision")

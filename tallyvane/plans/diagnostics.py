"""Diagnostics of the memory, of training pools and of chains, and windows over a real stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import confidence as C
from tallyvane.operators import loops, metrics, scorers, splits
from tallyvane.plans.queries import over, query
from tallyvane.sources.fixtures import MEMORY_SQL, SAMPLES_SQL, samples, table
from tallyvane.sources.fixtures import memory as entries_of
from tallyvane.sources.staging import Scratch
from tallyvane.streaming import cycles

S = f"WITH s AS ({SAMPLES_SQL})"
TRAINING = ("fever", "triviaqa", "commonsense_qa")
#: The cycle that ages are counted from.
NOW = 5


@query("a41_buffer_histograms", f"WITH m AS ({MEMORY_SQL}), k AS (SELECT unnest(['age', 'push_cycle', 'benchmark']) AS kind, unnest([({NOW} - storage_cycle)::VARCHAR, storage_cycle::VARCHAR, COALESCE(source_benchmark, 'unknown')]) AS bucket FROM m) SELECT kind, bucket, count(*) AS n FROM k GROUP BY ALL")
def buffer_histograms(spark: SparkSession, d: str) -> DataFrame:
    """How old what waits in the buffer is, when it came, and from where: one scan."""
    one = lambda kind, bucket: F.struct(F.lit(kind).alias("kind"), bucket.cast("string").alias("bucket"))
    rows = entries_of(spark, d).select(F.explode(F.array(one("age", NOW - F.col("storage_cycle")), one("push_cycle", F.col("storage_cycle")), one("benchmark", F.coalesce("source_benchmark", F.lit("unknown"))))).alias("x"))
    return rows.groupBy("x.kind", "x.bucket").agg(F.count("*").alias("n"))


@query("a42_safety_overrides", f"{S}, u AS (SELECT benchmark, 0.5e0 * u_internal + 0.5e0 * p_entail AS u_pre FROM s) SELECT benchmark, count(*) AS n, count(*) FILTER (u_pre < 0.38e0) AS overrides, min(u_pre) AS least_u_pre FROM u GROUP BY benchmark")
def safety_overrides(spark: SparkSession, d: str) -> DataFrame:
    """How often the safety floor sends a query to full retrieval; without a confidence it never does, but the query counts."""
    u = samples(spark, d).select("benchmark", (0.5 * F.col("u_internal") + 0.5 * F.col("p_entail")).alias("u_pre"))
    return u.groupBy("benchmark").agg(F.count("*").alias("n"), F.count(F.when(F.col("u_pre") < 0.38, 1)).alias("overrides"), F.min("u_pre").alias("least_u_pre"))


_SCOPES = {"all5": "TRUE", "without_judge": "benchmark <> 'truthfulqa'", "training3": "benchmark IN ('fever', 'triviaqa', 'commonsense_qa')"}


@query(
    "a43_headline_deltas",
    f"{S}, b AS (SELECT cycle, benchmark, avg(em) AS em FROM s WHERE cycle <> 3 OR benchmark <> 'fever' GROUP BY ALL), g AS (SELECT benchmark, unnest(range(0, 6)) AS cycle FROM (SELECT DISTINCT benchmark FROM s)), "
    f"m AS (SELECT g.cycle, {', '.join(f'CASE WHEN count(*) FILTER ({c}) = count(em) FILTER ({c}) THEN avg(em) FILTER ({c}) END AS {n}' for n, c in _SCOPES.items())} FROM g LEFT JOIN b USING (cycle, benchmark) GROUP BY g.cycle) "
    f"SELECT m.cycle::INT AS cycle, {', '.join(f'round(m.{n}, 9) AS {n}, round(m.{n} - z.{n}, 9) AS delta_{n}' for n in _SCOPES)} FROM m, m z WHERE z.cycle = 0",
)
def headline_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Macro means over three scopes and what they gain over the first cycle; a benchmark that a cycle lacks, as one does in
    cycle 3 here, makes its scopes null, and so their gains."""
    rows = samples(spark, d)
    b = rows.filter((F.col("cycle") != 3) | (F.col("benchmark") != "fever")).groupBy("cycle", "benchmark").agg(F.avg("em").alias("em"))
    every = rows.select("benchmark").distinct().withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(5))))
    grid = every.join(b, ["cycle", "benchmark"], "left")

    def macro(scope: str):
        inside, has = F.expr(scope), F.col("em").isNotNull()
        return F.when(F.count(F.when(inside, 1)) == F.count(F.when(inside & has, 1)), F.avg(F.when(inside, F.col("em"))))

    m = grid.groupBy("cycle").agg(*(macro(c).alias(n) for n, c in _SCOPES.items()))
    first = m.filter("cycle = 0").select(*(F.col(n).alias(f"first_{n}") for n in _SCOPES))
    return m.crossJoin(F.broadcast(first)).select("cycle", *(x for n in _SCOPES for x in (F.round(n, 9).alias(n), F.round(F.col(n) - F.col(f"first_{n}"), 9).alias(f"delta_{n}"))))  # one row


_CHAINS = "SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN '' WHEN conv_id % 7 = 0 AND turn = 1 THEN ' short ' WHEN conv_id % 5 = 0 AND turn = 1 THEN repeat('again and again ', 60) ELSE text END AS chain, text FROM conversations WHERE role = 'assistant'"


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains with why they cannot be trained on: empty, short or looping; null where they can."""
    rows = over(spark, _CHAINS, conversations=table(spark, d, "conversations"))
    flagged = loops.flag_loops(rows.withColumnRenamed("text", "answer").withColumn("text", F.col("chain")))
    bare = F.trim(F.coalesce("chain", F.lit("")))
    return flagged.withColumn("reason", F.when(bare == "", "empty").when(F.length(bare) < 10, "short").when(F.col("is_loop"), "loop"))


@query(
    "a44_chain_diagnostics",
    f"WITH c AS (SELECT *, trim(COALESCE(chain, '')) AS bare FROM ({_CHAINS}) z), r AS (SELECT *, CASE WHEN bare = '' THEN 'empty' WHEN length(bare) < 10 THEN 'short' WHEN bare LIKE 'again and again again and again%' THEN 'loop' ELSE 'kept' END AS reason FROM c) "
    "SELECT reason, count(*) AS n, min(length(chain)) AS lo, max(length(chain)) AS hi, round(avg(length(chain)), 6) AS mean FROM r WHERE reason <> 'kept' GROUP BY reason",
)
def chain_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """How many chains are not trained on, why, and how long they are."""
    n = F.length("chain").cast("long")
    return _chains(spark, d).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 6).alias("mean"))


@query(
    "p3_training_pool",
    f"WITH m AS ({MEMORY_SQL}), e AS (SELECT *, list_filter(list_concat([source_benchmark], string_split(merged_names, ',')), lambda x: x IS NOT NULL AND x <> '') AS bms FROM m) "
    f"SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN answer ELSE concat('a chain of some length for ', answer) END AS target FROM e WHERE u_stored >= 0.7e0 AND len(bms) > 0 AND len(list_filter(bms, lambda x: x NOT IN {TRAINING})) = 0",
)
def training_pool(spark: SparkSession, d: str) -> DataFrame:
    """Entries that may be trained on: trusted, and from training benchmarks alone, those of merged entries too. An entry whose
    chain is empty, short or a loop is trained on its answer."""
    e = entries_of(spark, d)
    named = F.filter(F.concat(F.array("source_benchmark"), "merged_benchmarks"), lambda b: b.isNotNull() & (b != ""))
    inside = (F.size(named) > 0) & (F.size(F.array_except(named, F.array(*map(F.lit, TRAINING)))) == 0)
    chain = F.when(F.col("entry_id") % 8 == 0, "").when(F.col("entry_id") % 8 == 4, F.repeat(F.lit("round and round "), 50)).otherwise(F.concat(F.lit("a chain of some length for "), "answer"))
    flagged = loops.flag_loops(e.filter((F.col("u_stored") >= 0.7) & inside).select("entry_id", "answer", chain.alias("text"), chain.alias("chain")))
    bad = (F.length(F.trim("chain")) < 10) | F.col("is_loop")
    return flagged.select("entry_id", F.when(bad, F.col("answer")).otherwise(F.col("chain")).alias("target"))


@query("ml15_collapse", "WITH v AS (SELECT vec_id AS m, abs(unnest(embedding)::DOUBLE) AS s FROM embeddings), r AS (SELECT m, s, row_number() OVER (PARTITION BY m ORDER BY s DESC) AS k FROM v), c AS (SELECT m, max(s) / sum(s) AS r FROM r WHERE k <= 8 GROUP BY m) SELECT count(r) AS n, round(avg(r), 9) AS collapse FROM c")
def collapse(spark: SparkSession, d: str) -> DataFrame:
    """How far matrices rest on their largest singular value; a vector's components stand in for a spectrum."""
    spectra = table(spark, d, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("s")).withColumn("s", F.abs("s"))
    return metrics.spectrum_collapse(spectra, "vec_id", "s").withColumn("collapse", F.round("collapse", 9))


_ANSWERED = "SELECT l_orderkey AS okey, max(l_tax) * 12.5e0 AS p_ground_mean, CASE WHEN l_orderkey % 3 = 0 THEN 'one two three four five six seven eight nine ten eleven' ELSE 'one two three four five six seven eight nine ten eleven twelve' END AS answer FROM lineitem GROUP BY l_orderkey"
_FACTS = "SELECT l_orderkey AS okey, l_linenumber % 3 AS fact, l_quantity / 50e0 AS score FROM lineitem WHERE l_orderkey % 5 <> 0"


@query("v5_atomic_grounding", f"WITH a AS ({_ANSWERED}), f AS (SELECT okey, fact, max(score) AS best FROM ({_FACTS}) z GROUP BY ALL), g AS (SELECT okey, min(best) AS least FROM f GROUP BY okey) SELECT okey, CASE WHEN okey % 3 = 0 THEN p_ground_mean ELSE COALESCE(least, p_ground_mean) END AS p_ground_atomic FROM a LEFT JOIN g USING (okey)")
def atomic_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Grounding by facts; short answers and those without facts have the mean."""
    lines = table(spark, d, "lineitem")
    return scorers.atomic_grounding(over(spark, _ANSWERED, lineitem=lines), over(spark, _FACTS, lineitem=lines), "okey")


@query("d2_sized_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY substr(sha256('42:' || doc_id::VARCHAR), 1, 16), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k < 100 THEN 'eval' ELSE 'test' END AS pool FROM r")
def sized_split(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark that is only transferred to: the evaluation pool whole, the test pool with what is left of its size."""
    return splits.sized_split(table(spark, d, "documents").select("doc_id"), "doc_id", [("eval", 100), ("test", 1 << 40)], clamp=True).select("doc_id", "pool")


@query("v2_u_internal", f"{S} SELECT benchmark, round(avg(0.5e0 * u_stored + 0.5e0 * (1e0 - u_internal)), 9) AS u_internal FROM s GROUP BY benchmark")
def u_internal(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("benchmark").agg(F.round(F.avg(C.u_internal(F.col("u_stored"), F.col("u_internal"))), 9).alias("u_internal"))


@query("stream_windows_now", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows_now(spark: SparkSession, d: str) -> DataFrame:
    """The windows of stream_event_windows from a stream of the events' files, by micro-batches until none is left."""
    schema = table(spark, d, "events").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return cycles.windows_now(spark, f"{d}/event[s].parquet", fields, Scratch(spark))

"""Aggregate queries over answer records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.operators import metrics as M
from tallyvane.operators.ranks import exact_quantiles
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import SAMPLES_SQL, samples, table

S = f"WITH s AS ({SAMPLES_SQL})"
WRONG, RIGHT = "COALESCE(em, 0e0) = 0e0", "COALESCE(em, 0e0) = 1e0"
_FLAGS = {
    "confident_confabulation": f"{WRONG} AND COALESCE(u_stored, 0e0) >= 0.5e0",
    "factual_fabrication": f"{WRONG} AND p_ground_atomic IS NOT NULL AND p_ground_atomic < 0.3e0",
    "factual_contradiction": f"{WRONG} AND COALESCE(p_contra, 0e0) > 0.3e0",
    "logical_fabrication": f"{WRONG} AND p_entail IS NOT NULL AND p_entail < 0.3e0",
    "off_topic": f"{WRONG} AND q_a_relevance IS NOT NULL AND q_a_relevance < 0.5e0",
    "defensive_evasion": f"{WRONG} AND regexp_matches(prediction, '(?i)the\\s+context\\s+(does\\s*not|doesn''?t)\\s+(mention|provide|contain|discuss)|no\\s+information\\s+(is\\s+)?(provided|given|available|mentioned)|information\\s+(is\\s+)?not\\s+provided|cannot\\s+(determine|verify|be\\s+determined)')",
    "template_leak": "regexp_matches(prediction, '(?i)<(concise|factual|your|scaffold|answer)[a-z_ ]*>|\\[(your\\s+answer|answer\\s+here)\\]')",
    "false_refusal": f"{RIGHT} AND decision IN ('ABSTAIN', 'DISCARD')",
    "over_long": f"{WRONG} AND length(prediction) > 600",
}
_HITS = ", ".join(f"count(*) FILTER ({c})::DOUBLE AS {n}_hits" for n, c in _FLAGS.items())
_CHM = "(" + " + ".join(f"{n}_hits" for n in M.MEASURED) + ") / (n * 8e0)"
_ANY = " OR ".join(f"({c})" for c in _FLAGS.values())


def _chm_sql(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"{S}, h AS (SELECT {lead}count(*) AS n, {_HITS}, count(*) FILTER ({_ANY}) AS any_hits FROM s {group}) SELECT {lead}n, " + ", ".join(f"{n}_hits / n AS {n}_rate" for n in M.SUBTYPES) + f", {_CHM} AS chm, any_hits::DOUBLE / n AS union_rate FROM h"


@query("a4_a5_hallucination_chm", _chm_sql("cycle, benchmark"))
def hallucination_chm(spark: SparkSession, d: str) -> DataFrame:
    return M.hallucination_table(samples(spark, d), ["cycle", "benchmark"])


_SUM8 = " + ".join(f"CASE WHEN {_FLAGS[n]} THEN 1 ELSE 0 END" for n in M.MEASURED)


@query("a6_sample_chm", f"{S} SELECT okey, ({_SUM8}) / 8e0 AS chm, count(*) AS n FROM s GROUP BY 1, 2")
def sample_chm(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("okey", M.sample_chm().alias("chm")).groupBy("okey", "chm").agg(F.count("*").alias("n"))


@query("a7_pooled_chm", f"{S}, b AS (SELECT 'all' AS bucket, * FROM s UNION ALL SELECT CASE WHEN benchmark IN ('fever', 'triviaqa', 'commonsense_qa') THEN 'id' ELSE 'ood' END, * FROM s), h AS (SELECT bucket, count(*) AS n, {_HITS} FROM b GROUP BY bucket) SELECT bucket, n, {_CHM} AS chm FROM h")
def pooled_chm(spark: SparkSession, d: str) -> DataFrame:
    """All rows, those of training benchmarks, and the others: one scan, a row exploded into its two buckets."""
    own = F.when(F.col("benchmark").isin("fever", "triviaqa", "commonsense_qa"), "id").otherwise("ood")
    return M.hallucination_table(samples(spark, d).withColumn("bucket", F.explode(F.array(F.lit("all"), own))), ["bucket"]).select("bucket", "n", "chm")


@query("a8_chm_reduction", f"{S}, h AS (SELECT benchmark, cycle, count(*) AS n, {_HITS} FROM s GROUP BY ALL), c AS (SELECT benchmark, cycle, {_CHM} AS chm FROM h) SELECT b.benchmark, b.chm AS first_chm, f.chm AS last_chm, greatest(0e0, (b.chm - f.chm) / b.chm) AS reduction, CASE WHEN (b.chm - f.chm) / b.chm >= 0.3e0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c b JOIN c f USING (benchmark) WHERE b.cycle = 0 AND f.cycle = 5")
def chm_reduction(spark: SparkSession, d: str) -> DataFrame:
    chm = M.hallucination_table(samples(spark, d).filter("cycle in (0, 5)"), ["benchmark", "cycle"])
    ends = chm.groupBy("benchmark").agg(F.max(F.when(F.col("cycle") == 0, F.col("chm"))).alias("first_chm"), F.max(F.when(F.col("cycle") == 5, F.col("chm"))).alias("last_chm"))
    cut = (F.col("first_chm") - F.col("last_chm")) / F.nullif("first_chm", F.lit(0.0))
    return ends.withColumn("reduction", F.greatest(F.lit(0.0), cut)).withColumn("verdict", F.when(cut >= 0.3, "PASS").otherwise("FAIL"))


@query("a1_run_summary", f"{S} SELECT cycle, benchmark, count(*) AS n, sum(COALESCE(em, 0e0)) / count(*) AS mean_em, count(*) FILTER (decision = 'STORE')::DOUBLE / count(*) AS storage_rate, round(avg(u_stored), 6) AS mean_u_stored, round(avg(latency_ms), 2) AS mean_latency FROM s GROUP BY ALL")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("cycle", "benchmark").agg(
        F.count("*").alias("n"), (F.sum(F.coalesce("em", F.lit(0.0))) / F.count("*")).alias("mean_em"),
        M.rate(F.col("decision") == "STORE").alias("storage_rate"), F.round(F.avg("u_stored"), 6).alias("mean_u_stored"), F.round(F.avg("latency_ms"), 2).alias("mean_latency"),
    )


@query("a2_routing_distribution", f"{S} SELECT cycle, count(*) FILTER (tier = 1)::DOUBLE / count(*) FILTER (tier IN (1, 2, 3)) AS tier1_frac, count(*) FILTER (tier = 2)::DOUBLE / count(*) FILTER (tier IN (1, 2, 3)) AS tier2_frac, count(*) FILTER (tier = 3)::DOUBLE / count(*) FILTER (tier IN (1, 2, 3)) AS tier3_frac, count(*) FILTER (tier IN (1, 2, 3)) AS n_valid, count(*) FILTER (tier NOT IN (1, 2, 3))::DOUBLE / count(*) AS crash_frac FROM s GROUP BY cycle")
def routing_distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.routing_distribution(samples(spark, d), ["cycle"])


@query("a3_tier_em_latency", f"{S}, t AS (SELECT unnest([1, 2, 3]) AS tier) SELECT t.tier, COALESCE(sum(COALESCE(s.em, 0e0)) / nullif(count(s.okey), 0), 0e0) AS em, count(s.okey) AS n, round(COALESCE(avg(s.latency_ms), 0e0), 2) AS latency FROM t LEFT JOIN s ON s.tier = t.tier GROUP BY t.tier")
def tier_em_latency(spark: SparkSession, d: str) -> DataFrame:
    by = samples(spark, d).filter("tier in (1, 2, 3)").groupBy("tier").agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("em"), F.count("*").alias("n"), F.avg("latency_ms").alias("latency"))
    tiers = spark.range(1, 4).select(F.col("id").cast("int").alias("tier"))
    return tiers.join(F.broadcast(by), "tier", "left").select("tier", F.coalesce("em", F.lit(0.0)).alias("em"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("latency", F.lit(0.0)), 2).alias("latency"))  # three rows


@query("a9_confabulation_rate", f"{S} SELECT benchmark, count(*) FILTER ({WRONG} AND u_stored >= 0.5e0)::DOUBLE / count(*) AS above_rate, count(*) FILTER ({WRONG} AND p_ground_max <= 0.3e0)::DOUBLE / count(*) AS below_rate FROM s GROUP BY benchmark")
def confabulation_rate(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("benchmark").agg(M.rate(M.is_wrong() & (F.col("u_stored") >= 0.5)).alias("above_rate"), M.rate(M.is_wrong() & (F.col("p_ground_max") <= 0.3)).alias("below_rate"))


@query("a10_brier", f"{S} SELECT cycle, round(avg(pow(u_stored - COALESCE(em, 0e0), 2)), 9) AS brier FROM s GROUP BY cycle")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("cycle").agg(F.round(F.avg(F.pow(F.col("u_stored") - F.coalesce("em", F.lit(0.0)), 2)), 9).alias("brier"))


@query("a11_auroc", f"{S}, c AS (SELECT benchmark, u_stored, count(*) FILTER (em = 1) AS pos, count(*) FILTER (em IS DISTINCT FROM 1) AS neg FROM s GROUP BY ALL), r AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY benchmark ORDER BY u_stored ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT benchmark, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, COALESCE(sum(pos * (below * 2 + neg))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE * 2, 0), 0.5e0) AS auroc FROM r GROUP BY benchmark")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return M.auroc(samples(spark, d), "u_stored", "em", ["benchmark"])


_BINS = f"{S}, f AS (SELECT least(floor(greatest(0e0, least(1e0, u_stored)) / 0.1e0), 9)::INT AS bin, count(*) AS n, avg(u_stored) AS conf, avg(COALESCE(em, 0e0)) AS acc FROM s GROUP BY 1), b AS (SELECT r::INT AS bin, COALESCE(n, 0) AS n, COALESCE(conf, (r + 0.5e0) * 0.1e0) AS conf, COALESCE(acc, 0e0) AS acc FROM range(10) t(r) LEFT JOIN f ON f.bin = r)"


@query("a12_reliability_bins", f"{_BINS} SELECT bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc FROM b")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return M.reliability_bins(samples(spark, d), "u_stored", "em").withColumns({"conf": F.round("conf", 9), "acc": F.round("acc", 9)})


@query("a13_ece", f"{_BINS} SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return M.expected_calibration_error(samples(spark, d), "u_stored", "em").withColumn("ece", F.round("ece", 9))


@query("a14_a19_decision_matrix", f"{S} SELECT benchmark, decision, count(*) FILTER ({RIGHT}) AS correct, count(*) FILTER ({WRONG}) AS wrong, count(*) AS n FROM s GROUP BY ALL")
def decision_matrix(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("benchmark", "decision").agg(F.count(F.when(M.is_correct(), 1)).alias("correct"), F.count(F.when(M.is_wrong(), 1)).alias("wrong"), F.count("*").alias("n"))


@query("a15_unsupported_ungrounded", f"{S} SELECT cycle, count(*) FILTER ({RIGHT} AND p_ground_max < 0.3e0)::DOUBLE / nullif(count(*) FILTER ({RIGHT}), 0) AS unsupported_correct, count(*) FILTER (p_ground_max <= 0.3e0 AND u_stored >= 0.5e0)::DOUBLE / count(*) AS ungrounded FROM s GROUP BY cycle")
def unsupported(spark: SparkSession, d: str) -> DataFrame:
    right = F.count(F.when(M.is_correct(), 1))
    return samples(spark, d).groupBy("cycle").agg(
        (F.count(F.when(M.is_correct() & (F.col("p_ground_max") < 0.3), 1)) / F.nullif(right, F.lit(0))).alias("unsupported_correct"),
        M.rate((F.col("p_ground_max") <= 0.3) & (F.col("u_stored") >= 0.5)).alias("ungrounded"),
    )


_BI = "CASE benchmark WHEN 'fever' THEN 0 WHEN 'triviaqa' THEN 1 WHEN 'commonsense_qa' THEN 2 WHEN 'truthfulqa' THEN 3 ELSE 4 END"


@query("a16_transfer", f"{S}, r AS (SELECT cycle AS t, {_BI} AS i, avg(COALESCE(em, 0e0)) AS a FROM s WHERE cycle < 5 GROUP BY ALL), b AS (SELECT {_BI} AS i, avg(COALESCE(em, 0e0)) AS a FROM s WHERE cycle = 5 GROUP BY ALL) SELECT (SELECT round(avg(l.a - o.a), 9) FROM r l JOIN r o ON l.i = o.i AND l.t = 4 AND o.t = o.i WHERE l.i < 4) AS backward, (SELECT round(avg(p.a - b.a), 9) FROM r p JOIN b ON p.i = b.i AND p.t = p.i - 1 WHERE p.i >= 1) AS forward")
def transfer(spark: SparkSession, d: str) -> DataFrame:
    """Backward and forward transfer: tasks are benchmarks in order, stages are cycles 0-4, cycle 5 the untrained baseline."""
    i = F.expr(_BI)
    acc = samples(spark, d).groupBy("cycle", i.alias("i")).agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("a"))
    at = lambda stage: F.max(F.when(F.col("cycle") == stage, F.col("a")))
    per = acc.groupBy("i").agg(at(4).alias("last"), at(F.col("i")).alias("own"), at(F.col("i") - 1).alias("before"), at(5).alias("base"))
    return per.agg(
        F.round(F.avg(F.when(F.col("i") < 4, F.col("last") - F.col("own"))), 9).alias("backward"), F.round(F.avg(F.when(F.col("i") >= 1, F.col("before") - F.col("base"))), 9).alias("forward")
    )


@query("a17_ces", f"{S}, a AS (SELECT benchmark, avg(COALESCE(em, 0e0)) AS acc, 1 - count(*) FILTER ({WRONG} AND u_stored >= 0.5e0)::DOUBLE / count(*) AS epi, count(*) FILTER (tier = 1)::DOUBLE / count(*) AS ret, 1 - avg(pow(u_stored - COALESCE(em, 0e0), 2)) AS cal, count(*) FILTER (decision = 'STORE')::DOUBLE / count(*) AS ver FROM s GROUP BY benchmark) SELECT benchmark, round(pow(least(greatest(acc, 0.01e0), 1e0) * least(greatest(epi, 0.01e0), 1e0) * least(greatest(ret, 0.01e0), 1e0) * least(greatest(cal, 0.01e0), 1e0) * least(greatest(ver, 0.01e0), 1e0), 0.2e0), 9) AS ces FROM a")
def ces(spark: SparkSession, d: str) -> DataFrame:
    axes = samples(spark, d).groupBy("benchmark").agg(
        F.avg(F.coalesce("em", F.lit(0.0))).alias("acc"), (1 - M.rate(M.is_wrong() & (F.col("u_stored") >= 0.5))).alias("epi"), M.rate(F.col("tier") == 1).alias("ret"),
        (1 - F.avg(F.pow(F.col("u_stored") - F.coalesce("em", F.lit(0.0)), 2))).alias("cal"), M.rate(F.col("decision") == "STORE").alias("ver"),
    )
    return axes.select("benchmark", F.round(M.geometric_score(*map(F.col, ("acc", "epi", "ret", "cal", "ver"))), 9).alias("ces"))


@query("a20_grounding_exceedance", f"{S}, t AS (SELECT unnest([0.2e0, 0.4e0, 0.6e0, 0.8e0]) AS threshold) SELECT threshold, count(*) FILTER (p_ground_max >= threshold)::DOUBLE / count(*) AS share FROM s, t WHERE {RIGHT} GROUP BY threshold")
def grounding_exceedance(spark: SparkSession, d: str) -> DataFrame:
    """One scan: a count per threshold, unpivoted at the end."""
    ts = (0.2, 0.4, 0.6, 0.8)
    one = samples(spark, d).filter(M.is_correct()).agg(*(M.rate(F.col("p_ground_max") >= t).alias(f"t{k}") for k, t in enumerate(ts)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("share")) for k, t in enumerate(ts)))).alias("x")).select("x.*")


@query("a21_signal_medians", f"{S} SELECT benchmark, median(u_stored) AS u_stored, median(p_ground_max) AS p_ground_max, median(p_entail) AS p_entail FROM s WHERE decision = 'STORE' AND {RIGHT} GROUP BY benchmark")
def signal_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians by counting pieces of each signal's order: no task has a benchmark's rows."""
    right, signals = samples(spark, d).filter((F.col("decision") == "STORE") & M.is_correct()), ("u_stored", "p_ground_max", "p_entail")
    return exact_quantiles(right, ["benchmark"], signals, {"median": (0.5, True)}).select("benchmark", *(F.col(f"{c}_median").alias(c) for c in signals))


@query("a22_u_buckets", f"{S} SELECT CASE WHEN u_stored < 0.2e0 THEN 0 WHEN u_stored < 0.45e0 THEN 1 WHEN u_stored < 0.6e0 THEN 2 WHEN u_stored < 0.8e0 THEN 3 WHEN u_stored < 1e0 THEN 4 END AS bucket, count(*) AS n, count(*) FILTER ({RIGHT}) AS correct FROM s WHERE u_stored < 1e0 GROUP BY 1")
def u_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Half-open buckets; 1.0 itself is in none."""
    u, bucket = F.col("u_stored"), F.lit(None)
    for k, top in reversed(list(enumerate((0.2, 0.45, 0.6, 0.8, 1.0)))):
        bucket = F.when(u < top, k).otherwise(bucket)
    return samples(spark, d).filter(u < 1.0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(M.is_correct(), 1)).alias("correct"))


@query("a23_cohens_d", f"{S}, a AS (SELECT benchmark, count(*) FILTER (em = 1) AS n1, count(*) FILTER (em = 0) AS n0, avg(latency_ms) FILTER (em = 1) AS m1, avg(latency_ms) FILTER (em = 0) AS m0, var_samp(latency_ms) FILTER (em = 1) AS v1, var_samp(latency_ms) FILTER (em = 0) AS v0 FROM s GROUP BY benchmark) SELECT benchmark, n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM a")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return M.cohens_d(samples(spark, d), "latency_ms", "em", ["benchmark"]).withColumn("d", F.round("d", 6))


@query("a24_poison_rate", f"{S} SELECT cycle, benchmark, count(*) FILTER (decision = 'STORE' AND {WRONG})::DOUBLE / nullif(count(*) FILTER (decision = 'STORE'), 0) AS poison, count(*) FILTER (decision = 'STORE' AND {RIGHT})::DOUBLE / nullif(count(*) FILTER (decision = 'STORE'), 0) AS purity FROM s GROUP BY ALL")
def poison_rate(spark: SparkSession, d: str) -> DataFrame:
    stored = F.col("decision") == "STORE"
    n = F.nullif(F.count(F.when(stored, 1)), F.lit(0))
    return samples(spark, d).groupBy("cycle", "benchmark").agg((F.count(F.when(stored & M.is_wrong(), 1)) / n).alias("poison"), (F.count(F.when(stored & M.is_correct(), 1)) / n).alias("purity"))


@query("a25_a26_purity", f"{S}, c AS (SELECT count(*) FILTER ({RIGHT} AND decision = 'STORE')::DOUBLE / nullif(count(*) FILTER ({RIGHT}), 0) AS tpr, count(*) FILTER ({WRONG} AND decision <> 'STORE')::DOUBLE / nullif(count(*) FILTER ({WRONG}), 0) AS tnr, count(*) FILTER ({RIGHT})::DOUBLE / count(*) AS p FROM s), a AS (SELECT *, (tpr + tnr) / 2 AS alpha FROM c) SELECT tpr, tnr, alpha, p * alpha / (p * alpha + (1 - p) * (1 - alpha)) AS purity FROM a")
def purity(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy of storing and the purity that it predicts."""
    right, wrong, stored = M.is_correct(), M.is_wrong(), F.col("decision") == "STORE"
    share = lambda c, of: F.coalesce(F.count(F.when(c & of, 1)) / F.nullif(F.count(F.when(of, 1)), F.lit(0)), F.lit(0.0))
    got = samples(spark, d).agg(share(stored, right).alias("tpr"), share(~stored, wrong).alias("tnr"), M.rate(right).alias("p")).withColumn("alpha", (F.col("tpr") + F.col("tnr")) / 2)
    p, a = F.col("p"), F.col("alpha")
    return got.select("tpr", "tnr", "alpha", (p * a / (p * a + (1 - p) * (1 - a))).alias("purity"))


@query("a27_admission_entropy", f"{S}, c AS (SELECT cycle, benchmark, count(*) AS candidates, count(*) FILTER (decision = 'STORE') AS admitted FROM s GROUP BY ALL), p AS (SELECT *, admitted::DOUBLE / sum(admitted) OVER (PARTITION BY cycle) AS share FROM c) SELECT cycle, sum(admitted)::BIGINT AS admitted, sum(candidates)::BIGINT AS candidates, round(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END), 9) AS entropy FROM p GROUP BY cycle")
def admission_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = samples(spark, d).groupBy("cycle", "benchmark").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("decision") == "STORE", 1)).alias("admitted"))
    share = F.col("admitted") / F.nullif(F.sum("admitted").over(Window.partitionBy("cycle")), F.lit(0))
    return c.withColumn("share", share).groupBy("cycle").agg(
        F.sum("admitted").alias("admitted"), F.sum("candidates").alias("candidates"),
        F.round(-F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0)), 9).alias("entropy"),
    )


@query("a30_tier_rollup", f"{S} SELECT cycle, CASE WHEN grouping(tier) = 1 THEN 'POOLED' ELSE tier::VARCHAR END AS tier, count(*) AS n, sum(COALESCE(em, 0e0)) / count(*) AS em FROM s GROUP BY GROUPING SETS ((cycle, tier), (cycle))")
def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = samples(spark, d).groupingSets([["cycle", "tier"], ["cycle"]], "cycle", "tier").agg(F.grouping("tier").alias("g"), F.count("*").alias("n"), F.avg(F.coalesce("em", F.lit(0.0))).alias("em"))
    return rolled.select("cycle", F.when(F.col("g") == 1, "POOLED").otherwise(F.col("tier").cast("string")).alias("tier"), "n", "em")


@query("a31_macro_micro", f"{S}, b AS (SELECT cycle, benchmark, avg(COALESCE(em, 0e0)) AS em, sum(COALESCE(em, 0e0)) AS hits, count(*) AS n FROM s GROUP BY ALL) SELECT cycle, round(avg(em), 9) AS macro_em, sum(hits) / sum(n) AS micro_em FROM b GROUP BY cycle")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    b = samples(spark, d).groupBy("cycle", "benchmark").agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("em"), F.sum(F.coalesce("em", F.lit(0.0))).alias("hits"), F.count("*").alias("n"))
    return b.groupBy("cycle").agg(F.round(F.avg("em"), 9).alias("macro_em"), (F.sum("hits") / F.sum("n")).alias("micro_em"))


@query("a32_seed_aggregate", f"{S}, b AS (SELECT benchmark, cycle, avg(COALESCE(em, 0e0)) AS em FROM s GROUP BY ALL), g AS (SELECT benchmark, avg(em) AS m, COALESCE(stddev_samp(em), 0e0) AS sd FROM b GROUP BY benchmark), f AS (SELECT m, sd FROM g WHERE benchmark = 'fever') SELECT g.benchmark, round(g.m, 9) AS mean_em, round(g.sd, 9) AS std_em, round(g.m - f.m, 9) AS delta, round(sqrt(g.sd * g.sd + f.sd * f.sd), 9) AS delta_std FROM g, f")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over seeds (here cycles), and the difference from a reference with its propagated deviation."""
    b = samples(spark, d).groupBy("benchmark", "cycle").agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("em"))
    g = b.groupBy("benchmark").agg(F.avg("em").alias("m"), F.coalesce(F.stddev_samp("em"), F.lit(0.0)).alias("sd"))
    everything = Window.partitionBy()
    ref = lambda c: F.max(F.when(F.col("benchmark") == "fever", F.col(c))).over(everything)
    return g.withColumns({"rm": ref("m"), "rs": ref("sd")}).select(
        "benchmark", F.round("m", 9).alias("mean_em"), F.round("sd", 9).alias("std_em"), F.round(F.col("m") - F.col("rm"), 9).alias("delta"), F.round(F.sqrt(F.pow("sd", 2) + F.pow("rs", 2)), 9).alias("delta_std")
    )


@query("a33_a34_delivered", f"{S} SELECT benchmark, count(*) FILTER (decision <> 'ABSTAIN') AS answered, count(*) FILTER (decision = 'ABSTAIN')::DOUBLE / count(*) AS refusal, count(*) FILTER (decision <> 'ABSTAIN' AND {WRONG})::DOUBLE / nullif(count(*) FILTER (decision <> 'ABSTAIN'), 0) AS wrong_answered, count(*) FILTER (decision = 'ABSTAIN' AND {RIGHT}) AS withheld_correct FROM s GROUP BY benchmark")
def delivered(spark: SparkSession, d: str) -> DataFrame:
    withheld = F.col("decision") == "ABSTAIN"
    n = F.count(F.when(~withheld, 1))
    return samples(spark, d).groupBy("benchmark").agg(
        n.alias("answered"), M.rate(withheld).alias("refusal"), (F.count(F.when(~withheld & M.is_wrong(), 1)) / F.nullif(n, F.lit(0))).alias("wrong_answered"),
        F.count(F.when(withheld & M.is_correct(), 1)).alias("withheld_correct"),
    )


@query("a35_latency", f"{S} SELECT tier, round(avg(latency_ms), 2) AS mean, median(latency_ms) AS median, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, min(latency_ms) AS lo, max(latency_ms) AS hi, round(stddev_pop(latency_ms), 4) AS sd FROM s GROUP BY tier")
def latency(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles are exact, by counting pieces of the order; the rest are plain aggregates."""
    rows, wanted = samples(spark, d), {"median": (0.5, True), "p95": (0.95, False), "p99": (0.99, False)}
    found = exact_quantiles(rows, ["tier"], ["latency_ms"], wanted).select("tier", *(F.col(f"latency_ms_{name}").alias(name) for name in wanted))
    plain = rows.groupBy("tier").agg(F.round(F.avg("latency_ms"), 2).alias("mean"), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi"), F.round(F.stddev_pop("latency_ms"), 4).alias("sd"))
    return plain.alias("a").join(found.alias("b"), F.col("a.tier").eqNullSafe(F.col("b.tier"))).select("a.*", *(F.col(f"b.{name}") for name in wanted))


@query("a36_signal_profile", f"{S}, m AS (SELECT q_a_relevance, count(*) AS c FROM s WHERE q_a_relevance IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FILTER (q_a_relevance IS NULL) FROM s) AS missing, (SELECT count(DISTINCT q_a_relevance) FROM s) AS n_distinct, (SELECT max(c)::DOUBLE / sum(c) FROM m) AS modal_share")
def signal_profile(spark: SparkSession, d: str) -> DataFrame:
    c = samples(spark, d).groupBy("q_a_relevance").agg(F.count("*").alias("c"))
    known = F.col("q_a_relevance").isNotNull()
    return c.agg(
        F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("missing"), F.count(F.when(known, 1)).alias("n_distinct"), (F.max(F.when(known, F.col("c"))) / F.sum(F.when(known, F.col("c")))).alias("modal_share")
    )


@query("a38_gate_fnr", f"{S}, g AS (SELECT benchmark, count(*) FILTER ({RIGHT} AND u_internal >= 0.7e0 AND p_ground_max <= 0.2e0)::DOUBLE / nullif(count(*) FILTER ({RIGHT}), 0) AS fnr_exit, count(*) FILTER ({RIGHT} AND NOT (u_internal >= 0.7e0 AND p_ground_max <= 0.2e0) AND decision <> 'STORE')::DOUBLE / nullif(count(*) FILTER ({RIGHT} AND NOT (u_internal >= 0.7e0 AND p_ground_max <= 0.2e0)), 0) AS fnr_store FROM s GROUP BY benchmark) SELECT benchmark, fnr_exit, fnr_store, 1 - (1 - fnr_exit) * (1 - fnr_store) AS eps_arch FROM g")
def gate_fnr(spark: SparkSession, d: str) -> DataFrame:
    """False negatives of the gates in their order of precedence, and of the cascade."""
    out = (F.col("u_internal") >= 0.7) & (F.col("p_ground_max") <= 0.2)
    share = lambda c, of: F.count(F.when(c & of, 1)) / F.nullif(F.count(F.when(of, 1)), F.lit(0))
    g = samples(spark, d).groupBy("benchmark").agg(share(out, M.is_correct()).alias("fnr_exit"), share(F.col("decision") != "STORE", M.is_correct() & ~out).alias("fnr_store"))
    return g.withColumn("eps_arch", 1 - (1 - F.col("fnr_exit")) * (1 - F.col("fnr_store")))


@query("a39_a40_threshold_sweep", f"{S}, g AS (SELECT r / 20e0 AS tau FROM range(21) t(r)), v AS (SELECT benchmark, u_stored, count(*) AS n, count(*) FILTER ({RIGHT}) AS hits FROM s GROUP BY ALL), k AS (SELECT benchmark, tau, sum(n) AS kept, sum(hits) AS hits FROM v, g WHERE u_stored >= tau GROUP BY ALL) SELECT benchmark, tau, kept::BIGINT AS kept, hits::DOUBLE / kept AS precision FROM k")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision of keeping scores from tau on. Rows are counted per distinct score before the grid is laid over them."""
    v = samples(spark, d).groupBy("benchmark", "u_stored").agg(F.count("*").alias("n"), F.count(F.when(M.is_correct(), 1)).alias("hits"))
    grid = v.withColumn("tau", F.explode(F.array(*(F.lit(k / 20) for k in range(21))))).filter("u_stored >= tau")
    return grid.groupBy("benchmark", "tau").agg(F.sum("n").alias("kept"), (F.sum("hits") / F.sum("n")).alias("precision"))


@query("a43_macro_by_scope", f"{S}, b AS (SELECT cycle, benchmark, avg(COALESCE(em, 0e0)) AS em FROM s GROUP BY ALL) SELECT cycle, round(avg(em), 9) AS all5, round(avg(em) FILTER (benchmark <> 'truthfulqa'), 9) AS without_judge, round(avg(em) FILTER (benchmark IN ('fever', 'triviaqa', 'commonsense_qa')), 9) AS training3 FROM b GROUP BY cycle")
def macro_by_scope(spark: SparkSession, d: str) -> DataFrame:
    b = samples(spark, d).groupBy("cycle", "benchmark").agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("em"))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("em"))), 9)
    return b.groupBy("cycle").agg(
        mean(F.lit(True)).alias("all5"), mean(F.col("benchmark") != "truthfulqa").alias("without_judge"), mean(F.col("benchmark").isin("fever", "triviaqa", "commonsense_qa")).alias("training3")
    )


@query("a44_text_diagnostics", "SELECT source, min(length(text)) AS lo, max(length(text)) AS hi, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) < 100) AS short_n FROM documents GROUP BY source")
def text_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("source").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 6).alias("mean"), F.count(F.when(n < 100, 1)).alias("short_n"))


_AXES = f"""{S}, h AS (SELECT cycle, benchmark, count(*) AS n, count(em) AS n_samples, count(u_stored) AS n_conf, avg(em) AS acc, {_HITS} FROM s GROUP BY ALL),
 b AS (SELECT cycle, benchmark, least(floor(greatest(0e0, least(1e0, u_stored)) / 0.1e0), 9) AS bin, count(*) AS k, avg(u_stored) AS conf, avg(em) AS hit FROM s WHERE em IS NOT NULL AND u_stored IS NOT NULL GROUP BY ALL),
 c AS (SELECT cycle, benchmark, 1 - 2 * least(sum(k * abs(conf - hit)) / sum(k), 0.5e0) AS cal FROM b GROUP BY ALL),
 r AS (SELECT cycle, avg(em) FILTER (benchmark = 'commonsense_qa') AS mmlu FROM s GROUP BY cycle), z AS (SELECT mmlu AS base FROM r WHERE cycle = 0),
 a AS (SELECT cycle, benchmark, n_samples, n_conf, acc, 1 - {_CHM} AS epi, cal, CASE WHEN base > 0 THEN least(mmlu / base, 1e0) END AS ret, 0.5e0 AS ver FROM h LEFT JOIN c USING (cycle, benchmark) LEFT JOIN r USING (cycle), z)"""
_CES = "round(pow(" + " * ".join(f"least(greatest(COALESCE({x}, 0.01e0), 0.01e0), 1e0)" for x in ("acc", "epi", "ret", "cal", "ver")) + ", 1 / 5e0), 9)"
_WMEAN = lambda x, w: f"sum({x} * CASE WHEN {x} IS NOT NULL AND {w} > 0 THEN {w} END) / sum(CASE WHEN {x} IS NOT NULL AND {w} > 0 THEN {w} END) AS {x}"


@query(
    "a18_ces_axes",
    f"{_AXES}, w AS (SELECT cycle, {', '.join(_WMEAN(x, 'n_conf' if x == 'cal' else 'n_samples') for x in ('acc', 'epi', 'ret', 'cal', 'ver'))}, sum(n_samples)::BIGINT AS n_samples, sum(n_conf)::BIGINT AS n_conf FROM a GROUP BY cycle) "
    f"SELECT cycle, {', '.join(f'round({x}, 9) AS {x}' for x in ('acc', 'epi', 'ret', 'cal', 'ver'))}, n_samples, n_conf, {_CES} AS ces FROM w",
)
def ces_axes(spark: SparkSession, d: str) -> DataFrame:
    """The five axes of each cycle over all benchmarks and their score; one benchmark stands in for the retention probe."""
    s = samples(spark, d)
    probe = s.groupBy("cycle").agg(F.avg(F.when(F.col("benchmark") == "commonsense_qa", F.col("em"))).alias("mmlu"))
    base = probe.filter("cycle = 0").select(F.col("mmlu").alias("base"))
    ret = probe.crossJoin(F.broadcast(base)).select("cycle", F.when(F.col("base") > 0, F.least(F.col("mmlu") / F.col("base"), F.lit(1.0))).alias("ret"))  # one row
    axes = M.ces_axes(s, ["cycle", "benchmark"]).join(ret, "cycle", "left").withColumn("ver", F.lit(0.5))
    rolled = M.roll_up_axes(axes, ["cycle"])
    return rolled.select("cycle", *(F.round(c, 9).alias(c) for c in ("acc", "epi", "ret", "cal", "ver")), "n_samples", "n_conf", F.round("ces", 9).alias("ces"))


@query("t6_ablation_ranking", f"{_AXES}, e AS (SELECT benchmark, cycle, {_CES} AS ces FROM a WHERE NOT (benchmark = 'strategyqa' AND cycle = 3)), f AS (SELECT benchmark, cycle, ces FROM e UNION ALL SELECT 'strategyqa', 3, NULL), d AS (SELECT f.cycle AS variant, avg(f.ces) AS ces, avg(f.ces) - (SELECT avg(ces) FROM f WHERE cycle = 0) AS delta, bool_or(f.ces IS NULL) AS partial FROM f GROUP BY f.cycle), n AS (SELECT variant, CASE WHEN partial THEN NULL ELSE round(delta, 9) END AS delta FROM d) SELECT variant, delta, row_number() OVER (ORDER BY delta DESC NULLS LAST, variant)::INT AS rank FROM n")
def ablation_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Variants, here cycles, by their score's difference from the full one; one that lacks a measurement comes last."""
    s = samples(spark, d)
    probe = s.groupBy("cycle").agg(F.avg(F.when(F.col("benchmark") == "commonsense_qa", F.col("em"))).alias("mmlu"))
    base = probe.filter("cycle = 0").select(F.col("mmlu").alias("base"))
    ret = probe.crossJoin(F.broadcast(base)).select("cycle", F.when(F.col("base") > 0, F.least(F.col("mmlu") / F.col("base"), F.lit(1.0))).alias("ret"))  # one row
    axes = M.ces_axes(s, ["cycle", "benchmark"]).join(ret, "cycle", "left").withColumn("ver", F.lit(0.5))
    each = M.roll_up_axes(axes, ["cycle", "benchmark"]).select("cycle", F.when((F.col("benchmark") == "strategyqa") & (F.col("cycle") == 3), None).otherwise(F.round("ces", 9)).alias("ces"))
    per = each.groupBy(F.col("cycle").alias("variant")).agg(F.avg("ces").alias("ces"), F.bool_or(F.col("ces").isNull()).alias("partial"))
    full = per.filter("variant = 0").select(F.col("ces").alias("full"))
    deltas = per.crossJoin(F.broadcast(full)).select("variant", F.when(~F.col("partial"), F.round(F.col("ces") - F.col("full"), 9)).alias("delta"))
    return deltas.withColumn("rank", F.row_number().over(Window.orderBy(F.col("delta").desc_nulls_last(), "variant")))  # a row a variant


@query("a11b_auroc_one_class", f"{S}, c AS (SELECT benchmark, decision, tier, u_stored, count(*) FILTER (em = 1) AS pos, count(*) FILTER (em IS DISTINCT FROM 1) AS neg FROM s WHERE tier <> 2 OR em = 1 GROUP BY ALL), r AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY benchmark, decision, tier ORDER BY u_stored ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT benchmark, decision, tier, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(pos * (below * 2 + neg)) / nullif(sum(pos) * sum(neg) * 2e0, 0), 9) AS auroc FROM r GROUP BY ALL")
def auroc_one_class(spark: SparkSession, d: str) -> DataFrame:
    """Areas of small groups, null where all rows are right or none is; at one tier all are."""
    rows = samples(spark, d).filter("tier <> 2 or em = 1")
    return M.auroc(rows, "u_stored", "em", ["benchmark", "decision", "tier"], one_class=None).withColumn("auroc", F.round("auroc", 9))


_EDGE = " + ".join(f"CASE WHEN c >= {i}e0 / 15 THEN 1 ELSE 0 END" for i in range(1, 15))


@query("a13b_edge_ece", f"{S}, k AS (SELECT benchmark, u_stored * 1.05e0 - 0.02e0 AS c, em FROM s WHERE em IS NOT NULL), b AS (SELECT benchmark, CASE WHEN c >= 0 AND c <= 1 THEN {_EDGE} END AS bin, count(*) AS n, avg(c) AS conf, avg(em) AS acc FROM k GROUP BY ALL) SELECT benchmark, sum(n)::BIGINT AS n, round(sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(acc - conf) END) / sum(n), 9) AS ece FROM b GROUP BY benchmark")
def edge_ece(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error over fifteen half-open bins; some scores lie beyond them."""
    rows = samples(spark, d).withColumn("c", F.expr("u_stored * 1.05e0 - 0.02e0"))
    return M.edge_calibration_error(rows, "c", "em", ["benchmark"]).withColumn("ece", F.round("ece", 9))


@query("a23b_concatenated_d", f"{S} SELECT benchmark, tier, round(COALESCE((avg(latency_ms) FILTER (em = 1) - avg(latency_ms) FILTER (em = 0)) / greatest(COALESCE(stddev_samp(latency_ms) FILTER (em IN (0, 1)), 0e0), 1e-6), 0e0), 6) AS d FROM s WHERE tier <> 3 OR em = 1 GROUP BY ALL")
def concatenated_d(spark: SparkSession, d: str) -> DataFrame:
    return M.concatenated_d(samples(spark, d).filter("tier <> 3 or em = 1"), "latency_ms", "em", ["benchmark", "tier"]).withColumn("d", F.round("d", 6))


@query("a40_floor_fit", f"{S}, k AS (SELECT concat(benchmark, '/', cycle) AS b, u_stored AS u, em FROM s WHERE em IS NOT NULL AND (cycle <> 4 OR okey % 97 = 0)), g AS (SELECT r AS i, r * 0.01e0 AS t FROM range(101) x(r)), p AS (SELECT b, i, t, count(*) FILTER (u >= t) AS kept, count(*) FILTER (u >= t AND em <> 0) AS hits FROM k, g GROUP BY ALL), f AS (SELECT b, min(CASE WHEN kept < 10 THEN i END) AS thin, min(CASE WHEN kept > 0 AND hits::DOUBLE / kept >= 0.4e0 THEN i END) AS good FROM p GROUP BY b), n AS (SELECT b, count(*) AS n FROM k GROUP BY b) SELECT b AS key, CASE WHEN n >= 20 AND good IS NOT NULL AND (thin IS NULL OR good < thin) THEN good * 0.01e0 ELSE 0.38e0 END AS floor FROM f JOIN n USING (b)")
def floor_fit(spark: SparkSession, d: str) -> DataFrame:
    """The safety floor of each benchmark and cycle for a precision of 0.4; the records of one cycle are thin."""
    rows = samples(spark, d).filter("cycle <> 4 or okey % 97 = 0").withColumn("key", F.concat("benchmark", F.lit("/"), "cycle"))
    return M.floor_fit(rows, "u_stored", "em", "key", target=0.4)


@query("k8_wide_summary", f"{S}, b AS (SELECT cycle, benchmark, avg(COALESCE(em, 0e0)) AS em, count(*) FILTER (tier = 1)::DOUBLE / count(*) AS t1, count(*) FILTER (decision = 'STORE')::DOUBLE / count(*) AS sr, avg(u_stored) AS u, avg(latency_ms) AS l, avg(em) FILTER (benchmark = 'commonsense_qa') AS x FROM s GROUP BY ALL), m AS (SELECT cycle, max(x) AS mmlu FROM b GROUP BY cycle), z AS (SELECT mmlu AS base FROM m WHERE cycle = 0) SELECT cycle, benchmark, round(em, 4) AS em, round(t1 * 100, 2) AS tier1_frac_pct, round(sr * 100, 2) AS storage_rate_pct, round(u, 4) AS mean_u_stored, round(l, 1) AS mean_latency_ms, CASE WHEN row_number() OVER (PARTITION BY cycle ORDER BY benchmark) = 1 THEN round(mmlu * 100, 2) END AS mmlu_retention_pct, CASE WHEN row_number() OVER (PARTITION BY cycle ORDER BY benchmark) = 1 AND base > 0 THEN round(mmlu / base * 100, 2) END AS mmlu_retention_ratio_pct FROM b JOIN m USING (cycle), z")
def wide_summary(spark: SparkSession, d: str) -> DataFrame:
    """A row a cycle and benchmark; what is measured once a cycle stands on the first benchmark's row alone."""
    s = samples(spark, d)
    probe = F.avg(F.when(F.col("benchmark") == "commonsense_qa", F.col("em")))
    b = s.groupBy("cycle", "benchmark").agg(F.avg(F.coalesce("em", F.lit(0.0))).alias("em"), M.rate(F.col("tier") == 1).alias("t1"), M.rate(F.col("decision") == "STORE").alias("sr"), F.avg("u_stored").alias("u"), F.avg("latency_ms").alias("l"), probe.alias("x"))
    per = Window.partitionBy("cycle")
    rows = b.withColumns({"mmlu": F.max("x").over(per), "first": F.row_number().over(per.orderBy("benchmark")) == 1})
    base = b.filter("cycle = 0").agg(F.max("x").alias("base"))
    pct = lambda c: F.round(c * 100, 2)
    return rows.crossJoin(F.broadcast(base)).select(  # one row
        "cycle", "benchmark", F.round("em", 4).alias("em"), pct(F.col("t1")).alias("tier1_frac_pct"), pct(F.col("sr")).alias("storage_rate_pct"), F.round("u", 4).alias("mean_u_stored"), F.round("l", 1).alias("mean_latency_ms"),
        F.when(F.col("first"), pct(F.col("mmlu"))).alias("mmlu_retention_pct"), F.when(F.col("first") & (F.col("base") > 0), pct(F.col("mmlu") / F.col("base"))).alias("mmlu_retention_ratio_pct"),
    )

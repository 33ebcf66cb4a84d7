"""Routing, verification and calibration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import confidence as C
from tallyvane.functions.text import is_unstorable
from tallyvane.operators import calibration, trajectory, validation
from tallyvane.operators import metrics as M
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import SAMPLE_COLUMNS, SAMPLES_SQL, samples, table

S = f"WITH s AS ({SAMPLES_SQL})"
_CLIP = lambda x: f"greatest(0e0, least(1e0, {x}))"


@query("r1_r2_route", f"{S}, r AS (SELECT benchmark, p_ground_max AS sim, u_stored AS u, {_CLIP('0.6e0 * u_internal + 0.4e0 / (1e0 + u_stored)')} AS u_pre FROM s) SELECT benchmark, CASE WHEN u_pre < 0.38e0 THEN 3 WHEN 0.7e0 * sim + 0.30000000000000004e0 * u >= 0.9e0 THEN 1 WHEN sim > 0.75e0 THEN 2 ELSE 3 END AS tier, count(*) AS n, count(*) FILTER (u_pre < 0.38e0) AS overrides FROM r GROUP BY ALL")
def route(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).withColumn("u_pre", C.pre_confidence(F.col("u_internal"), F.col("u_stored")))
    tier = C.route(F.col("p_ground_max"), F.col("u_stored"), F.col("u_pre"), F.lit(0.38))
    return rows.groupBy("benchmark", tier.alias("tier")).agg(F.count("*").alias("n"), F.count(F.when(F.col("u_pre") < 0.38, 1)).alias("overrides"))


@query("r3_ml10_consult", f"{S}, r AS (SELECT benchmark, CASE WHEN p_ground_max > 0.75e0 THEN 2 ELSE 3 END AS tier, 1e0 / (1e0 + exp(-(-0.5e0 + COALESCE(p_entail, 0e0) * 1.5e0 + COALESCE(q_a_relevance, 0e0) * -0.75e0))) AS p FROM s) SELECT benchmark, CASE WHEN tier = 3 AND p < 0.5e0 THEN 2 ELSE tier END AS final_tier, count(*) AS n, round(avg(p), 9) AS mean_p FROM r GROUP BY ALL")
def consult(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d)
    p = C.linear_probability({c: F.col(c) for c in ("p_entail", "q_a_relevance")}, {"p_entail": 1.5, "q_a_relevance": -0.75}, -0.5)
    tiered = rows.select("benchmark", F.when(F.col("p_ground_max") > 0.75, 2).otherwise(3).alias("tier"), p.alias("p"))
    return tiered.groupBy("benchmark", C.consult(F.col("tier"), F.col("p")).alias("final_tier")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"))


@query("v10_v11_decide", f"{S}, e AS (SELECT *, u_internal >= 0.7e0 AND p_ground_max <= 0.2e0 AS early FROM s) SELECT cycle, CASE WHEN early THEN 'DISCARD' ELSE decision END AS final_decision, count(*) AS n, count(*) FILTER (early) AS early_n, round(avg(CASE WHEN early THEN 0e0 ELSE u_stored END), 9) AS mean_u FROM e GROUP BY ALL")
def decide(spark: SparkSession, d: str) -> DataFrame:
    """The early-exit gate comes before the thresholds, and zeroes the score."""
    early = C.early_exit(F.col("u_internal"), F.col("p_ground_max"))
    rows = samples(spark, d).withColumn("early", early)
    final = F.when(F.col("early"), "DISCARD").otherwise(C.decide(F.col("u_stored"), F.col("p_ground_max")))
    return rows.groupBy("cycle", final.alias("final_decision")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("early"), 1)).alias("early_n"), F.round(F.avg(F.when(F.col("early"), 0.0).otherwise(F.col("u_stored"))), 9).alias("mean_u")
    )


_STORE = "CASE WHEN benchmark IN ('truthfulqa', 'strategyqa') THEN 'transfer' WHEN decision = 'DEFERRED' THEN 'deferred' WHEN decision <> 'STORE' THEN 'rejected' WHEN p_ground_max > 0.95e0 THEN 'duplicate' WHEN regexp_matches(prediction, '(?i)<(concise|factual|your|scaffold|answer)[a-z_ ]*>|the\\s+context\\s+does\\s*not\\s+mention') THEN 'unstorable' ELSE 'stored' END"


@query("p1_storage_gate", f"{S} SELECT {_STORE} AS outcome, count(*) AS n FROM s GROUP BY 1")
def storage_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gates in their order; what the similarity stands for here is grounding."""
    outcome = (
        F.when(F.col("benchmark").isin("truthfulqa", "strategyqa"), "transfer").when(F.col("decision") == "DEFERRED", "deferred").when(F.col("decision") != "STORE", "rejected")
        .when(F.col("p_ground_max") > 0.95, "duplicate").when(is_unstorable(F.col("prediction")), "unstorable").otherwise("stored")
    )
    return samples(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("p6_withheld", f"{S} SELECT benchmark, count(*) FILTER (decision = 'ABSTAIN' OR contains(prediction, '<abstain>')) AS withheld FROM s GROUP BY benchmark")
def withheld(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("benchmark").agg(F.count(F.when((F.col("decision") == "ABSTAIN") | F.contains("prediction", F.lit("<abstain>")), 1)).alias("withheld"))


_PICK = lambda k: "CASE decision " + " ".join(f"WHEN '{d}' THEN '{e[k]}'" for d, e in C.ENVELOPES.items()) + " END"
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_ETA = "CASE WHEN cycle = 1 THEN '6am tomorrow' END"
_CADENCE = "CASE cycle WHEN 2 THEN 'nightly' WHEN 3 THEN 'shortly' WHEN 4 THEN 'weekly' END"
_PHRASE = "CASE cadence " + " ".join(f"WHEN '{k}' THEN {_Q(v)}" for k, v in C.CADENCES.items()) + " ELSE concat('in my ', cadence, ' learning cycle. Please check back soon') END"
_CAVEAT = f"CASE decision WHEN 'DISCARD' THEN {_Q(C.DISCARD_CAVEAT)} WHEN 'DEFERRED' THEN CASE WHEN eta IS NOT NULL THEN concat('I''ll reconsider this around ', eta, '. Please ask again then.') WHEN cadence IS NOT NULL THEN concat('I''ll reconsider this ', {_PHRASE}, '.') ELSE {_Q(C.DEFERRED_CAVEAT)} END END"


@query("f39_envelope", f"{S}, k AS (SELECT *, {_ETA} AS eta, {_CADENCE} AS cadence FROM s) SELECT {_PICK(0)} AS tag, {_PICK(1)} AS label, {_PICK(2)} AS icon, decision <> 'ABSTAIN' AS show_answer, {_CAVEAT} AS caveat, count(*) AS n, count(CASE WHEN decision <> 'ABSTAIN' THEN prediction END) AS answers, round(avg(greatest(0e0, least(1e0, u_stored))), 9) AS confidence FROM k GROUP BY ALL")
def envelope(spark: SparkSession, d: str) -> DataFrame:
    """What users get of each answer, with every kind of caveat."""
    e = samples(spark, d).select(C.envelope(F.col("prediction"), F.col("u_stored"), F.col("decision"), F.expr(_ETA), F.expr(_CADENCE)).alias("e")).select("e.*")
    return e.groupBy("tag", "label", "icon", "show_answer", "caveat").agg(F.count("*").alias("n"), F.count("answer").alias("answers"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("f43_drift", f"{S}, b AS (SELECT benchmark, cycle, max(abs(u_stored - p_ground_max)) / 100 AS worst FROM s GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('edge', 0, 0.001e0), ('edge', 1, 0.01e0), ('none', 0, 0e0)) v) SELECT benchmark, cycle, round(worst, 9) AS worst, CASE WHEN worst > 0.01e0 THEN 'UNSAFE' WHEN worst > 0.001e0 THEN 'WARN' ELSE 'SAFE' END AS gate FROM b")
def drift(spark: SparkSession, d: str) -> DataFrame:
    """The gate of the largest differences, and of differences at its very bounds."""
    b = samples(spark, d).groupBy("benchmark", "cycle").agg((F.max(F.abs(F.col("u_stored") - F.col("p_ground_max"))) / 100).alias("worst"))
    edges = spark.createDataFrame([("edge", 0, 0.001), ("edge", 1, 0.01), ("none", 0, 0.0)], "benchmark string, cycle int, worst double")
    return b.union(edges).select("benchmark", "cycle", F.round("worst", 9).alias("worst"), C.drift(F.col("worst")).alias("gate"))


#: Signals that the records lack, made from their keys.
_MORE = {"p_ground_mean": "p_ground_max * 0.8e0", "s_avg": "(okey % 9) / 8e0", "h_norm": "(okey % 5) / 4e0"}
_TERMS = " + ".join(f"{'(1e0 - ' if n == 'h_norm' else ''}COALESCE({_MORE.get(n, n)}, 0.5e0){')' if n == 'h_norm' else ''} * {w}e0" for n, w in C.FALLBACK.items())


@query("ml7_weighted_composite", f"{S} SELECT cycle, round(avg(greatest(0e0, least(1e0, {_TERMS}))), 9) AS mean_u FROM s GROUP BY cycle")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    u = C.weighted_composite({c: F.expr(_MORE.get(c, c)) for c in C.FALLBACK})
    return samples(spark, d).groupBy("cycle").agg(F.round(F.avg(u), 9).alias("mean_u"))


_LOGIT = "CASE WHEN okey % 17 = 0 THEN NULL ELSE (u_stored - 0.5e0) * (okey % 90) END"


@query("v6_relevance", f"{S}, l AS (SELECT cycle, {_LOGIT} AS z FROM s) SELECT cycle, round(avg(CASE WHEN z IS NULL THEN 0.5e0 ELSE 1e0 / (1e0 + exp(-greatest(-30e0, least(30e0, z)))) END), 9) AS relevance FROM l GROUP BY cycle")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("cycle").agg(F.round(F.avg(C.relevance(F.expr(_LOGIT))), 9).alias("relevance"))


_F4 = lambda x: f"printf('%.4f', {x})"
_SC = "(0.7e0 * p_ground_max + (1e0 - 0.7e0) * u_stored)"
_HEAD = f"concat('u_pre=', {_F4('u_internal')}, ' is safe (floor 0.38). Score 0.70 x ', {_F4('p_ground_max')}, ' + 0.30 x ', {_F4('u_stored')}, ' = ', {_F4(_SC)})"


@query("r4_explain_route", f"{S} SELECT CASE WHEN u_internal < 0.38e0 THEN concat('u_pre=', {_F4('u_internal')}, ' is below the safety floor 0.38: tier 3 whatever the match.') WHEN {_SC} >= 0.9e0 THEN concat({_HEAD}, ' reaches 0.90: tier 1, direct retrieval.') WHEN p_ground_max > 0.75e0 THEN concat({_HEAD}, ' misses 0.90, similarity exceeds 0.75: tier 2, guided generation.') ELSE concat({_HEAD}, ' misses 0.90, similarity does not exceed 0.75: tier 3, full retrieval.') END AS reason, count(*) AS n FROM s GROUP BY 1")
def explain_route(spark: SparkSession, d: str) -> DataFrame:
    """Why each record would go to its tier, counted by reason."""
    return samples(spark, d).groupBy(C.explain_route(F.col("u_internal"), F.col("p_ground_max"), F.col("u_stored")).alias("reason")).agg(F.count("*").alias("n"))


_KNOT = lambda x: f"CASE WHEN {x} <= 0.1e0 THEN 0.2e0 WHEN {x} < 0.5e0 THEN 0.2e0 + ({x} - 0.1e0) * ((0.4e0 - 0.2e0) / (0.5e0 - 0.1e0)) WHEN {x} < 0.9e0 THEN 0.4e0 + ({x} - 0.5e0) * ((0.9e0 - 0.4e0) / (0.9e0 - 0.5e0)) ELSE 0.9e0 END"
KNOTS = {c: ((0.1, 0.2), (0.5, 0.4), (0.9, 0.9)) for c in ("p_ground_max", "p_entail")}


@query("ml4_composite", f"{S}, k AS (SELECT benchmark, CASE WHEN p_entail IS NULL THEN NULL ELSE {_KNOT('p_entail')} END AS e, {_KNOT('p_ground_max')} AS g FROM s), l AS (SELECT benchmark, (ln(g / (1e0 - g)) + COALESCE(ln(e / (1e0 - e)), 0e0)) / (CASE WHEN e IS NULL THEN 1 ELSE 2 END) AS z FROM k) SELECT benchmark, round(avg(1e0 / (1e0 + exp(-z))), 9) AS mean_p FROM l GROUP BY benchmark")
def composite(spark: SparkSession, d: str) -> DataFrame:
    p = C.composite({c: F.col(c) for c in KNOTS}, KNOTS)
    return samples(spark, d).groupBy("benchmark").agg(F.round(F.avg(p), 9).alias("mean_p"))


@query("ml9_temperature", f"{S}, p AS (SELECT cycle, greatest(1e-6, least(1 - 1e-6, u_stored)) AS p FROM s) SELECT cycle, round(avg(1e0 / (1e0 + exp(-(ln(p / (1e0 - p)) / 1.5e0)))), 9) AS mean_p FROM p GROUP BY cycle")
def temperature(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("cycle").agg(F.round(F.avg(C.apply_temperature(F.col("u_stored"), 1.5)), 9).alias("mean_p"))


@query("ml8_fit_temperature")
def fit_temperature(spark: SparkSession, d: str) -> DataFrame:
    return calibration.fit_temperatures(samples(spark, d), "u_stored", "em", "benchmark")


@query("ml3_isotonic")
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Knots of each signal's isotonic fit, its direction by the sign of the correlation with em."""
    return calibration.isotonic_knots(samples(spark, d), ["u_stored", "p_ground_max", "p_entail"], "em")


@query("ml5_logistic")
def logistic(spark: SparkSession, d: str) -> DataFrame:
    return calibration.fit_logistic(samples(spark, d), ["u_stored", "p_ground_max", "u_internal"], "em")


#: Answer records with a key of their own.
_KEYED = "l_orderkey * 8 + l_linenumber"
_FEATURES = ["u_stored", "p_ground_max", "u_internal"]


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(f"{_KEYED} AS id", *(f"{SAMPLE_COLUMNS[c]} AS {c}" for c in ("benchmark", "em", *_FEATURES)))


@query("ml11_folds", f"WITH s AS (SELECT {_KEYED} AS id, COALESCE({SAMPLE_COLUMNS['em']}, 0e0) AS em FROM lineitem), r AS (SELECT id, em, row_number() OVER (PARTITION BY em ORDER BY substr(sha256('42:' || id::VARCHAR), 1, 15), id) - 1 AS k FROM s) SELECT id, (k % 5)::INT AS outer, ((k // 5) % 5)::INT AS inner FROM r".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def folds(spark: SparkSession, d: str) -> DataFrame:
    """Outer and inner folds, even within each label."""
    return validation.hash_folds(_keyed(spark, d).withColumn("em", F.coalesce("em", F.lit(0.0))), "id", "em").select("id", "outer", "inner")


@query("ml11_nested_cv")
def nested_cv(spark: SparkSession, d: str) -> DataFrame:
    """Nested cross-validation: each outer fold's best c and area, the grid behind it, and areas by benchmark."""
    folds, grid, areas = validation.nested_cv(_keyed(spark, d), _FEATURES, "em", "id", "benchmark")
    null = lambda kind: F.lit(None).cast(kind)
    return (
        folds.select(F.lit("fold").alias("kind"), F.col("outer").cast("string").alias("name"), F.col("best_c").alias("c"), null("long").alias("n"), F.round("auroc", 6).alias("auroc"))
        .unionByName(grid.select(F.lit("grid").alias("kind"), F.col("outer").cast("string").alias("name"), "c", null("long").alias("n"), F.round("auroc", 6).alias("auroc")))
        .unionByName(areas.select(F.when(F.col("pooled"), "pooled").otherwise("benchmark").alias("kind"), F.col("benchmark").alias("name"), null("double").alias("c"), "n", F.round("auroc", 6).alias("auroc")))
    )


@query("ml12_leave_one_out")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark under a model of all others."""
    found = validation.leave_one_out(_keyed(spark, d), _FEATURES, "em", "benchmark")
    return found.select("benchmark", "pooled", "n_test", *(F.round(c, 6).alias(c) for c in ("auroc", "accuracy", "pos_rate")))


@query("ml12_held_out_sizes", f"{S}, k AS (SELECT benchmark, avg(CASE WHEN em >= 1 THEN 1e0 ELSE 0e0 END) AS pos_rate, count(*) AS n_test FROM s GROUP BY benchmark) SELECT benchmark, FALSE AS pooled, n_test, round(pos_rate, 6) AS pos_rate FROM k UNION ALL SELECT NULL, TRUE, sum(n_test)::BIGINT, round(sum(n_test * pos_rate) / sum(n_test), 6) FROM k")
def held_out_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What each model is judged on."""
    return validation.leave_one_out(_keyed(spark, d), _FEATURES, "em", "benchmark").select("benchmark", "pooled", "n_test", F.round("pos_rate", 6).alias("pos_rate"))


@query("ml14_saturation", f"{S}, k AS (SELECT benchmark, count(DISTINCT cycle) AS n_cycles, 0.6e0 + length(benchmark) / 100e0 AS c_inf FROM s GROUP BY benchmark) SELECT benchmark, n_cycles, round(c_inf, 6) AS c_inf, 0.5e0 AS a, 0.4e0 AS k, 1e0 AS r2, round(ln(0.5e0 / (0.01e0 * c_inf)) / 0.4e0, 4) AS c_star FROM k")
def saturation(spark: SparkSession, d: str) -> DataFrame:
    """The curve that each benchmark's records follow, found again from them."""
    value = 0.6 + F.length("benchmark") / 100 - 0.5 * F.exp(-0.4 * F.col("cycle"))
    found = calibration.fit_saturation(samples(spark, d).select("benchmark", "cycle", value.alias("ces")), "benchmark", "cycle", "ces")
    return found.select("benchmark", "n_cycles", *(F.round(c, 6).alias(c) for c in ("c_inf", "a", "k", "r2")), F.round("c_star", 4).alias("c_star"))


_HALT = f"{S}, a AS (SELECT cycle, benchmark, avg(CASE WHEN decision = 'STORE' AND benchmark <> 'fever' THEN 1e0 ELSE 0e0 END) AS rate FROM s GROUP BY ALL), w AS (SELECT DISTINCT cycle FROM s ORDER BY cycle DESC LIMIT 2), z AS (SELECT benchmark FROM a JOIN w USING (cycle) GROUP BY benchmark HAVING count(rate) = 2 AND max(rate) = 0)"


@query("p7_halt_triggers", f"{_HALT}, k AS (SELECT unnest([0.5e0, 0.95e0, NULL]) AS collapse) SELECT collapse, CASE WHEN collapse >= 0.95e0 THEN 'halt' WHEN (SELECT count(*) FROM z) > 0 THEN 'relax_alpha' ELSE 'continue' END AS action, CASE WHEN collapse >= 0.95e0 THEN '' ELSE (SELECT string_agg(benchmark, ',' ORDER BY benchmark) FROM z) END AS relax FROM k")
def halt_triggers(spark: SparkSession, d: str) -> DataFrame:
    """What to do after the last cycle, for three scores of collapse; one benchmark admits nothing here."""
    stored = ((F.col("decision") == "STORE") & (F.col("benchmark") != "fever")).cast("double")
    rates = samples(spark, d).groupBy("cycle", "benchmark").agg(F.avg(stored).alias("rate"))
    scores = spark.createDataFrame([(5, 0.5), (5, 0.95), (5, None)], "cycle int, collapse double")
    return trajectory.halt(rates, scores).select("collapse", "action", F.array_join("relax", ",").alias("relax"))


@query("p8_early_stop", f"{S}, c AS (SELECT cycle, round(avg(u_stored), 4) AS ces, avg(CASE WHEN decision = 'STORE' THEN 1e0 ELSE 0e0 END) - 0.35e0 AS rate, avg(COALESCE(em, 0e0)) + 0.6e0 AS retention FROM s GROUP BY cycle), d AS (SELECT *, abs(ces - lag(ces) OVER w) AS g, abs(lag(ces) OVER w - lag(ces, 2) OVER w) AS h, lag(retention) OVER w AS r FROM c WINDOW w AS (ORDER BY cycle)), f AS (SELECT cycle, COALESCE(g < 0.002e0 AND h < 0.002e0, FALSE) AS flat, COALESCE(rate < 0.05e0, FALSE) AS saturated, COALESCE(retention <= 0.93e0 AND r <= 0.93e0, FALSE) AS retained FROM d) SELECT *, flat::INT + saturated::INT + retained::INT >= 2 AS should_stop FROM f")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The three signals after each cycle and whether two of them agree; scores stand in for the measured series."""
    c = samples(spark, d).groupBy("cycle").agg(F.round(F.avg("u_stored"), 4).alias("ces"), (M.rate(F.col("decision") == "STORE") - 0.35).alias("storage_rate"), (F.avg(F.coalesce("em", F.lit(0.0))) + 0.6).alias("retention"))
    return trajectory.early_stop(c).select("cycle", "flat", "saturated", "retained", "should_stop")


@query("ml6_shrunk_knots")
def shrunk(spark: SparkSession, d: str) -> DataFrame:
    """Isotonic knots of each benchmark, drawn towards those of all; one benchmark leaves a signal out."""
    return calibration.shrunk_knots(samples(spark, d), ["u_stored", "p_entail"], "em", "benchmark", masks={"fever": ("p_entail",)})


@query("ml13_platt", f"{S}, k AS (SELECT benchmark, p_ground_max AS t, ln(greatest(1e-6, least(1 - 1e-6, p_entail)) / (1e0 - greatest(1e-6, least(1 - 1e-6, p_entail)))) AS x, ln(greatest(1e-6, least(1 - 1e-6, p_ground_max)) / (1e0 - greatest(1e-6, least(1 - 1e-6, p_ground_max)))) AS y FROM s WHERE p_entail IS NOT NULL AND p_ground_max IS NOT NULL), l AS (SELECT benchmark, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, corr(x, y) AS rho FROM k GROUP BY benchmark) SELECT benchmark, count(*) AS n, round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(any_value(rho), 6) AS rho, round(avg(abs(a * x + b - y)), 6) AS mae_logit, round(avg(abs(1e0 / (1e0 + exp(-(a * x + b))) - t)), 6) AS mae_probability FROM k JOIN l USING (benchmark) GROUP BY benchmark")
def platt(spark: SparkSession, d: str) -> DataFrame:
    fitted = calibration.fit_platt(samples(spark, d), "p_entail", "p_ground_max", ["benchmark"])
    return fitted.select("benchmark", "n", *(F.round(c, 6).alias(c) for c in ("a", "b", "rho", "mae_logit", "mae_probability")))


@query("r5_tier_batches", "WITH k AS (SELECT event_id AS ordinal, CASE WHEN value > 60 THEN 1 WHEN value > 20 THEN 2 ELSE 3 END AS tier FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ordinal) - 1 AS k FROM k) SELECT ordinal, tier, k // 64 AS batch, (k % 64)::INT AS slot FROM r")
def tier_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batch and place of each query, in the order in which they came."""
    tier = F.when(F.col("value") > 60, 1).when(F.col("value") > 20, 2).otherwise(3)
    return trajectory.tier_batches(table(spark, d, "events").select(F.col("event_id").alias("ordinal"), tier.alias("tier")), 64)


@query("p9_retention", f"{S}, r AS (SELECT benchmark, avg(COALESCE(em, 0e0)) FILTER (cycle = 5) / nullif(avg(COALESCE(em, 0e0)) FILTER (cycle = 0), 0) AS ratio FROM s GROUP BY benchmark) SELECT count(*) FILTER (ratio < 0.93e0) > 0 AS abort, min_by(benchmark, ratio) AS worst, round(min(ratio), 9) AS worst_ratio FROM r")
def retention(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.avg(F.when(F.col("cycle") == c, F.coalesce("em", F.lit(0.0))))
    scores = samples(spark, d).groupBy("benchmark").agg(at(0).alias("base"), at(5).alias("now"))
    return trajectory.retention(scores, "benchmark", "base", "now").withColumn("worst_ratio", F.round("worst_ratio", 9))


@query("v4_v5_grounding", "WITH f AS (SELECT l_orderkey AS okey, l_linenumber AS fact, l_quantity / 50e0 AS score FROM lineitem), m AS (SELECT okey, fact, max(score) AS best FROM f GROUP BY ALL) SELECT m.okey, min(best) AS atomic, (SELECT NULL) AS unused, max(best) AS top FROM m GROUP BY m.okey".replace("(SELECT NULL) AS unused, ", ""))
def grounding(spark: SparkSession, d: str) -> DataFrame:
    """Atomic grounding: least over facts of the most over passages. Both levels aggregate on the answer's key."""
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("fact"), (F.col("l_quantity") / 50).alias("score"))
    return facts.groupBy("okey", "fact").agg(F.max("score").alias("best")).groupBy("okey").agg(F.min("best").alias("atomic"), F.max("best").alias("top"))


@query("v12_ensemble", f"{S} SELECT benchmark, round(avg(least(COALESCE(p_entail, 0.5e0), p_ground_max)), 9) AS strict, round(avg(greatest(COALESCE(p_entail, 0.5e0), p_ground_max)), 9) AS loose, count(*) FILTER ((CASE WHEN p_entail >= 0.5e0 THEN 1 ELSE 0 END) + (CASE WHEN p_ground_max >= 0.5e0 THEN 1 ELSE 0 END) + (CASE WHEN u_internal >= 0.5e0 THEN 1 ELSE 0 END) >= 2) AS majority FROM s GROUP BY benchmark")
def ensemble(spark: SparkSession, d: str) -> DataFrame:
    e, g = F.coalesce("p_entail", F.lit(0.5)), F.col("p_ground_max")
    votes = F.coalesce((F.col("p_entail") >= 0.5).cast("int"), F.lit(0)) + (g >= 0.5).cast("int") + (F.col("u_internal") >= 0.5).cast("int")
    return samples(spark, d).groupBy("benchmark").agg(F.round(F.avg(F.least(e, g)), 9).alias("strict"), F.round(F.avg(F.greatest(e, g)), 9).alias("loose"), F.count(F.when(votes >= 2, 1)).alias("majority"))

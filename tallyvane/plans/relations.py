"""Joins, windows, ranks and tests of significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.operators import joins, stats
from tallyvane.operators import metrics as M
from tallyvane.operators.ranks import numbered
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import SAMPLES_SQL, samples, table

S = f"WITH s AS ({SAMPLES_SQL})"
_PAIR = "SELECT event_id AS id, event_type AS family, CASE WHEN value > 50e0 THEN 1e0 ELSE 0e0 END AS em_a, CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS em_b FROM events"


def systems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return (
        e.select(F.col("event_id").alias("id"), F.col("event_type").alias("family"), (F.col("value") > 50).cast("double").alias("em_a")),
        e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).cast("double").alias("em_b")),
    )


@query("j1_ml1_mcnemar", f"WITH p AS ({_PAIR}), c AS (SELECT family, count(*) AS n, count(*) FILTER (em_a = 1 AND em_b = 0) AS n10, count(*) FILTER (em_a = 0 AND em_b = 1) AS n01 FROM p GROUP BY family) SELECT family, n, n10, n01, CASE WHEN n10 + n01 = 0 THEN 0e0 ELSE pow(greatest(abs(n10 - n01) - 1, 0), 2) / (n10 + n01) END AS chi2 FROM c")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    a, b = systems(spark, d)
    return stats.mcnemar(a.join(b, "id"), "em_a", "em_b", ["family"]).select("family", "n", "n10", "n01", "chi2")


@query("ml1_w4_mcnemar_holm")
def mcnemar_holm(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the paired tests, with Holm's step-down over the families."""
    a, b = systems(spark, d)
    return stats.holm(stats.mcnemar_p(stats.mcnemar(a.join(b, "id"), "em_a", "em_b", ["family"])), "p", [], "family")


@query("j2_j6_gold_left_join", "SELECT d.doc_id, l.quality::DOUBLE AS em, l.doc_id IS NULL AS unverified FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 0")
def gold_left_join(spark: SparkSession, d: str) -> DataFrame:
    """The purge: documents without a label are kept as unverified, those labelled wrong go."""
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("em"), F.lit(True).alias("known"))
    joined = table(spark, d, "documents").select("doc_id").join(gold, "doc_id", "left")
    return joined.filter(F.col("em").isNull() | (F.col("em") != 0)).select("doc_id", "em", F.col("known").isNull().alias("unverified"))


@query("j3_signal_label", "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS positive, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY lang")
def signal_label(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").dropna(subset=["n_chars", "quality"])
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("positive"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("j4_pair_utility", f"WITH p AS ({_PAIR}) SELECT id, CASE WHEN em_a > em_b THEN 1 ELSE 0 END AS label, em_a - em_b AS utility, greatest(abs(em_a - em_b), 0.1e0) AS weight FROM p WHERE em_a <> em_b")
def pair_utility(spark: SparkSession, d: str) -> DataFrame:
    a, b = systems(spark, d)
    delta = F.col("em_a") - F.col("em_b")
    return a.join(b, "id").filter("em_a <> em_b").select("id", (delta > 0).cast("int").alias("label"), delta.alias("utility"), F.greatest(F.abs(delta), F.lit(0.1)).alias("weight"))


@query("j7_d3_duplicates_within", "WITH c AS (SELECT source, substr(sha256(substr(trim(text), 1, 500)), 1, 16) AS cid FROM documents) SELECT source, cid, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1")
def duplicates_within(spark: SparkSession, d: str) -> DataFrame:
    from tallyvane.functions.text import content_id

    return table(spark, d, "documents").groupBy("source", content_id(F.col("text")).alias("cid")).agg(F.count("*").alias("n")).filter("n > 1")


@query("j8_leakage_across", "WITH c AS (SELECT source, substr(sha256(substr(trim(text), 1, 500)), 1, 16) AS cid FROM documents) SELECT cid, count(DISTINCT source) AS n_sources, min(source) AS first_source FROM c GROUP BY cid HAVING count(DISTINCT source) > 1")
def leakage_across(spark: SparkSession, d: str) -> DataFrame:
    from tallyvane.functions.text import content_id

    cid = content_id(F.col("text")).alias("cid")
    return table(spark, d, "documents").groupBy(cid).agg(F.count_distinct("source").alias("n_sources"), F.min("source").alias("first_source")).filter("n_sources > 1")


@query("j9_j10_semi_anti", "SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS seen, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unseen")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    seen = docs.join(labels, "doc_id", "left_semi").agg(F.count("*").alias("seen"))
    return seen.crossJoin(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("unseen")))  # one row each


@query("j13_parameter_fallback", f"{S}, t AS (SELECT * FROM (VALUES ('fever', 0.5e0), ('triviaqa', 0.7e0)) v(benchmark, floor_)) SELECT s.benchmark, COALESCE(t.floor_, 0.38e0) AS floor, count(*) FILTER (u_stored < COALESCE(t.floor_, 0.38e0)) AS below FROM s LEFT JOIN t USING (benchmark) GROUP BY ALL")
def parameter_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A per-benchmark parameter with a global default, folded into the scan as a literal map."""
    floors = F.create_map(F.lit("fever"), F.lit(0.5), F.lit("triviaqa"), F.lit(0.7))
    rows = samples(spark, d).withColumn("floor", F.coalesce(F.element_at(floors, F.col("benchmark")), F.lit(0.38)))
    return rows.groupBy("benchmark", "floor").agg(F.count(F.when(F.col("u_stored") < F.col("floor"), 1)).alias("below"))


@query("w1_w2_spearman", f"{S}, v AS (SELECT benchmark, latency_ms AS x, u_stored AS y FROM s), r AS (SELECT benchmark, rank() OVER (PARTITION BY benchmark ORDER BY x) + (count(*) OVER (PARTITION BY benchmark, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY benchmark ORDER BY y) + (count(*) OVER (PARTITION BY benchmark, y) - 1) / 2e0 AS ry FROM v) SELECT benchmark, round(corr(rx, ry), 9) AS rho FROM r GROUP BY benchmark")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(samples(spark, d), "latency_ms", "u_stored", ["benchmark"]).withColumn("rho", F.round("rho", 9))


_SIGNALS = ["u_stored", "p_ground_max", "p_entail", "u_internal", "p_twin"]
_TWIN = "p_ground_max * 0.5e0 + (okey % 2) / 50e0"
_RHO = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN round(corr(ra, rb), 9) END AS rho FROM (SELECT {a}, {b}, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2e0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2e0 AS rb FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"
    for i, a in enumerate(_SIGNALS) for b in _SIGNALS[i + 1 :]
)
_MATRIX = f"{S}, t AS (SELECT *, {_TWIN} AS p_twin FROM s), m AS ({_RHO})"


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.signal_matrix(samples(spark, d).withColumn("p_twin", F.expr(_TWIN)), _SIGNALS)


@query("w3_signal_correlation", f"{_MATRIX} SELECT a, b, rho, COALESCE(abs(rho) >= 0.5e0, FALSE) AS over FROM m")
def signal_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of each pair of signals and whether it reaches one half."""
    return _matrix(spark, d).select("a", "b", F.round("rho", 9).alias("rho"), F.coalesce(F.abs("rho") >= 0.5, F.lit(False)).alias("over"))


@query("w3_signal_clusters", f"{_MATRIX.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT a AS u, b AS v FROM m WHERE abs(rho) >= 0.5e0 UNION SELECT b, a FROM m WHERE abs(rho) >= 0.5e0), n AS (SELECT unnest([{', '.join(repr(x) for x in _SIGNALS)}]) AS signal, unnest(range({len(_SIGNALS)})) AS i), r AS (SELECT signal, signal AS root FROM n UNION SELECT e.v, r.root FROM r JOIN e ON r.signal = e.u) SELECT r.signal, arg_min(r.root, n.i) AS cluster FROM r JOIN n ON n.signal = r.root GROUP BY r.signal")
def signal_clusters(spark: SparkSession, d: str) -> DataFrame:
    return stats.signal_clusters(_matrix(spark, d), _SIGNALS, 0.5)


@query("ml2_wilcoxon", "WITH p AS (SELECT event_type, round(value - 40, 0) AS d FROM events), z AS (SELECT event_type, abs(d) AS s, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM p WHERE d <> 0 GROUP BY ALL), r AS (SELECT *, up + down AS t, COALESCE(sum(up + down) OVER (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (up + down + 1) / 2e0 AS rk FROM z), g AS (SELECT event_type, sum(t)::BIGINT AS n, sum(rk * up) AS u, sum(rk * down) AS v, sum((t * t * t - t)::DOUBLE) AS ties FROM r GROUP BY event_type) SELECT event_type, n, least(u, v)::DOUBLE AS w, round((least(u, v) - n * (n + 1) / 4e0) / sqrt((n * (n + 1) * (2e0 * n + 1) - ties / 2) / 24), 9) AS z FROM g")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    """The signed-rank test of whole differences from 40, by kind of event."""
    pairs = table(spark, d, "events").select("event_type", F.round(F.col("value") - 40, 0).alias("d"))
    return stats.wilcoxon(pairs, "d", ["event_type"]).select("event_type", "n", "w", F.round("z", 9).alias("z"))


@query("j5_label_overlay", "SELECT e.event_id, e.event_type, CASE WHEN e.value > 50 THEN 1e0 ELSE 0e0 END AS em_stored, CASE WHEN e.value * 2 > 70 THEN 1e0 ELSE 0e0 END AS em FROM events e")
def label_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Records under their final labels; a record without one would raise an error."""
    e = table(spark, d, "events")
    rows = e.select("event_id", "event_type", (F.col("value") > 50).cast("double").alias("em"))
    return joins.overlay(rows, e.select("event_id", (F.col("value") * 2 > 70).cast("double").alias("label")), "event_id", "em", "label")


@query("j14_chain_pairs", "WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, x, unnest(range(1, len(x) + 1)) AS i FROM t), p AS (SELECT conv_id, x, i, unnest(range(i + 1, len(x) + 1)) AS j FROM i) SELECT conv_id, (i - 1)::INT AS i, (j - 1)::INT AS j, md5(concat(x[i], '|', x[j])) AS pair FROM p")
def chain_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two turns of a conversation, as chains of one query meet for entailment."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    pairs = joins.pairs_within(turns, "conv_id", "x")
    return pairs.select("conv_id", "i", "j", F.md5(F.concat("left", F.lit("|"), "right")).alias("pair"))


@query("d12_demonstrations", "WITH p AS (SELECT source, doc_id, trim(text) AS q, md5(concat('demo|', doc_id::VARCHAR)) AS h FROM documents WHERE trim(text) <> '' AND trim(lang) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS shot FROM p) SELECT source, doc_id, shot::INT AS shot, md5(q) AS question FROM r WHERE shot <= 5")
def demonstrations(spark: SparkSession, d: str) -> DataFrame:
    """Five demonstrations of each source, chosen by a hash, among what is not evaluated, here the labelled documents."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("question"), F.col("lang").alias("gold"))
    shots = joins.demonstrations(docs, table(spark, d, "labels").select("doc_id"), "source", "doc_id", 5, "demo")
    return shots.select("source", "doc_id", "shot", F.md5("question").alias("question"))


@query("w4_holm", "WITH p AS (SELECT n_nationkey AS k, n_regionkey AS family, (n_nationkey % 7 + 1) / 100e0 AS p FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rn, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT k, family, max(least(1e0, p * (m - rn + 1))) OVER (PARTITION BY family ORDER BY rn) AS p_holm FROM r")
def holm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("family"), ((F.col("n_nationkey") % 7 + 1) / 100).alias("p"))
    return stats.holm(p, "p", ["family"], "k").select("k", "family", "p_holm")


@query("w7_cycle_deltas", f"{S}, c AS (SELECT benchmark, cycle, count(*) FILTER (decision = 'STORE') AS stored FROM s GROUP BY ALL) SELECT benchmark, cycle, stored, stored - lag(stored) OVER (PARTITION BY benchmark ORDER BY cycle) AS delta FROM c")
def cycle_deltas(spark: SparkSession, d: str) -> DataFrame:
    c = samples(spark, d).groupBy("benchmark", "cycle").agg(F.count(F.when(F.col("decision") == "STORE", 1)).alias("stored"))
    return c.withColumn("delta", F.col("stored") - F.lag("stored").over(Window.partitionBy("benchmark").orderBy("cycle")))


@query("w8_carry_forward", f"{S}, c AS (SELECT benchmark, cycle, CASE WHEN cycle % 2 = 0 THEN count(*) END AS floor FROM s GROUP BY benchmark, cycle) SELECT benchmark, cycle, last_value(floor IGNORE NULLS) OVER (PARTITION BY benchmark ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor FROM c")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    c = samples(spark, d).groupBy("benchmark", "cycle").agg(F.count("*").alias("n")).withColumn("floor", F.when(F.col("cycle") % 2 == 0, F.col("n")))
    upto = Window.partitionBy("benchmark").orderBy("cycle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("benchmark", "cycle", F.last("floor", ignorenulls=True).over(upto).alias("floor"))


@query("w9_selective_accuracy", "WITH v AS (SELECT event_type, value, event_id, CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS em, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS kept, sum(em) / count(*) AS accuracy FROM v WHERE rn <= greatest(1, round_even(n * 0.5e0, 0)) GROUP BY event_type")
def selective_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value", (F.col("event_id") % 3 == 0).cast("double").alias("em"))
    ranked = numbered(e, ["event_type"], "value", "event_id", descending=True)
    kept = ranked.filter(F.col("rank") <= F.greatest(F.lit(1.0), F.rint(F.col("group_n") * 0.5)))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"), F.avg("em").alias("accuracy"))


@query("w10_precision_cliff", "WITH v AS (SELECT event_type, row_number() OVER w AS k, avg(CASE WHEN event_id % 3 = 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prec FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)), f AS (SELECT event_type, k, min(CASE WHEN k >= 10 AND prec < 0.3e0 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY k) AS ok FROM v) SELECT event_type, max(CASE WHEN ok = 1 AND k >= 10 THEN k END) AS cliff FROM f GROUP BY event_type")
def precision_cliff(spark: SparkSession, d: str) -> DataFrame:
    """The last rank of at least 10 before running precision first falls below 0.3."""
    e = table(spark, d, "events").select("event_type", "value", "event_id")
    ranked = numbered(e, ["event_type"], "value", "event_id", descending=True, sums={"hits": (F.col("event_id") % 3 == 0).cast("long")})
    falls = (F.col("rank") >= 10) & (F.col("hits") / F.col("rank") < 0.3)
    ends = ranked.groupBy("event_type").agg(F.min(F.when(falls, F.col("rank"))).alias("fall"), F.max("rank").alias("n"))
    last = F.coalesce(F.col("fall") - 1, F.col("n"))
    return ends.select("event_type", F.when(last >= 10, last).alias("cliff"))


@query("t5_contamination", f"{S}, w AS (SELECT okey, u_stored, latency_ms, row_number() OVER (ORDER BY u_stored DESC, latency_ms DESC, okey) AS rn FROM s WHERE decision = 'STORE' AND COALESCE(em, 0e0) = 0e0) SELECT okey, u_stored, latency_ms FROM w WHERE rn <= 10")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    """The ten most trusted wrong entries: a top-k report."""
    wrong = samples(spark, d).filter((F.col("decision") == "STORE") & M.is_wrong()).select("okey", "u_stored", "latency_ms")
    return wrong.orderBy(F.desc("u_stored"), F.desc("latency_ms"), "okey").limit(10)


@query("d10_paired_delta", f"WITH p AS ({_PAIR}) SELECT family, count(*) AS n, avg(em_a) AS mean_a, avg(em_b) AS mean_b, round(avg(em_a - em_b), 9) AS delta, TRUE AS inside FROM p GROUP BY family")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' difference by family, which must lie inside its own interval."""
    a, b = systems(spark, d)
    found = stats.paired_bootstrap(a.join(b, "id"), "id", "em_a", "em_b", ["family"])
    return found.select("family", "n", "mean_a", "mean_b", F.round("delta", 9).alias("delta"), F.col("delta").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("d10_paired_intervals")
def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """95 % intervals of the difference of two systems, from weights that both share."""
    a, b = systems(spark, d)
    return stats.paired_bootstrap(a.join(b, "id"), "id", "em_a", "em_b", ["family"])


@query("d10_bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """95 % interval of mean em per benchmark from Poisson bootstrap weights."""
    return stats.bootstrap_mean(samples(spark, d), "em", ["benchmark"])


@query("p5_having_pairs", f"WITH p AS ({_PAIR}) SELECT family, count(*) AS n, sum(em_a - em_b) / count(*) AS delta FROM p WHERE id IN (SELECT doc_id FROM labels) GROUP BY family HAVING count(*) >= 10")
def having_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = systems(spark, d)
    inside = a.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").join(b, "id")
    return inside.groupBy("family").agg(F.count("*").alias("n"), (F.sum(F.col("em_a") - F.col("em_b")) / F.count("*")).alias("delta")).filter("n >= 10")

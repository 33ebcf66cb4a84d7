import math

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import calibration, metrics, pools, ranks, splits, stats
from tallyvane.operators.loops import best_rouge_l, lcs_length, spaced_rouge_l
from tallyvane.operators.scoring import harness_scores

SCHEMA = "em double, u_stored double, p_ground_atomic double, p_entail double, p_contra double, q_a_relevance double, decision string, prediction string"
BASE = {"em": 0.0, "u_stored": 0.5, "p_ground_atomic": 0.5, "p_entail": 0.5, "p_contra": 0.0, "q_a_relevance": 0.8, "decision": "STORE", "prediction": "x"}


def table(spark, *changes):
    names = SCHEMA.replace(" double", "").replace(" string", "").split(", ")
    return spark.createDataFrame([tuple((BASE | c)[n] for n in names) for c in changes], SCHEMA)


def chm(spark, *changes):
    return metrics.hallucination_table(table(spark, *changes).withColumn("g", F.lit(1)), ["g"]).first()


def test_all_correct_is_clean(spark):
    assert chm(spark, {"em": 1.0, "u_stored": 0.2}, {"em": 1.0, "u_stored": 0.2})["chm"] == 0.0


def test_confident_and_wrong(spark):
    row = chm(spark, {"u_stored": 0.8, "p_ground_atomic": 0.8, "p_entail": 0.8})
    assert (row["confident_confabulation_rate"], row["union_rate"], row["chm"]) == (1.0, 1.0, 1 / 8)


def test_template_leak_counts_when_correct(spark):
    assert chm(spark, {"em": 1.0, "u_stored": 0.0, "prediction": "<concise factual answer>"})["template_leak_rate"] == 1.0


def test_missing_values(spark):
    row = chm(spark, {"em": None, "u_stored": None, "p_ground_atomic": None, "p_entail": None, "p_contra": None, "q_a_relevance": None, "decision": None, "prediction": None}, {"em": 0.5, "u_stored": 1.0})
    assert row["chm"] == 0.0 and row["union_rate"] == 0.0


def test_contradiction_only_in_union(spark):
    row = chm(spark, {"u_stored": 0.0, "p_contra": 0.9, "p_ground_atomic": 0.9, "p_entail": 0.9})
    assert (row["chm"], row["union_rate"]) == (0.0, 1.0)


def test_sample_chm_averages_to_chm(spark):
    rows = table(spark, {"u_stored": 0.9}, {"em": 1.0, "decision": "ABSTAIN"}, {"prediction": "y" * 700, "p_entail": 0.1})
    mean = rows.agg(F.avg(metrics.sample_chm())).first()[0]
    assert mean == pytest.approx(metrics.hallucination_table(rows.withColumn("g", F.lit(1)), ["g"]).first()["chm"])


def test_empty_table(spark):
    assert metrics.hallucination_table(table(spark, {}).limit(0).withColumn("g", F.lit(1)), ["g"]).count() == 0


@pytest.mark.parametrize("rows,wanted", [([(0.1, 0), (0.9, 1)], 1.0), ([(0.5, 0), (0.5, 1)], 0.5), ([(0.3, 1)], 0.5), ([(0.9, 0), (0.1, 1), (0.5, 1), (0.5, 0)], 0.125)])
def test_auroc(spark, rows, wanted):
    got = metrics.auroc(spark.createDataFrame([(1, float(s), float(y)) for s, y in rows], "g int, s double, y double"), "s", "y", ["g"]).first()
    assert got["auroc"] == wanted


def test_reliability_bins(spark):
    rows = spark.createDataFrame([(0.3, 1.0), (0.6, 0.0), (1.0, 1.0), (1.4, 0.0)], "s double, y double")
    bins = {r["bin"]: r for r in metrics.reliability_bins(rows, "s", "y").collect()}
    assert bins[2]["n"] == 1 and bins[5]["n"] == 1 and bins[9]["n"] == 2
    assert (bins[0]["n"], bins[0]["conf"], bins[0]["acc"]) == (0, 0.05, 0.0)


def test_mcnemar_and_holm(spark):
    pairs = spark.createDataFrame([("a", 1.0, 0.0)] * 10 + [("a", 0.0, 1.0)] * 2 + [("b", 1.0, 1.0)], "f string, x double, y double")
    got = {r["f"]: r for r in stats.mcnemar_p(stats.mcnemar(pairs, "x", "y", ["f"])).collect()}
    assert got["a"]["chi2"] == pytest.approx(49 / 12) and got["a"]["p"] == pytest.approx(math.erfc(math.sqrt(49 / 24)))
    assert (got["b"]["chi2"], got["b"]["p"]) == (0.0, 1.0)
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    assert [round(r["p_holm"], 9) for r in stats.holm(p, "p", [], "k").orderBy("k").collect()] == [0.03, 0.06, 0.06]


def test_wilcoxon_equals_plain_ranks(spark):
    values = [3.0, -1.0, 2.0, 2.0, -2.0, 0.0, 5.0, 1.0, -4.0, 6.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 0.0)], "g string, d double")
    got = {r["g"]: r for r in stats.wilcoxon_p(stats.wilcoxon(rows, "d", ["g"])).collect()}
    d = [v for v in values if v]
    sizes = sorted(map(abs, d))
    rank = lambda x: (sizes.index(x) + 1 + len(sizes) - sizes[::-1].index(x)) / 2
    up, down = sum(rank(v) for v in d if v > 0), sum(rank(-v) for v in d if v < 0)
    n, ties = len(d), sum(sizes.count(x) ** 3 - sizes.count(x) for x in set(sizes))
    z = (min(up, down) - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    assert (got["a"]["n"], got["a"]["w"]) == (n, min(up, down)) and got["a"]["z"] == pytest.approx(z) and got["a"]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (got["b"]["n"], got["b"]["p"]) == (0, 1.0)


def test_signal_matrix_and_clusters(spark):
    rows = spark.createDataFrame([(float(i), float(i * i), float(i % 2), 1.0) for i in range(20)], "a double, b double, c double, k double")
    names = ["a", "b", "c", "k"]
    matrix = stats.signal_matrix(rows, names)
    rho = {(r["a"], r["b"]): r["rho"] for r in matrix.collect()}
    assert rho["a", "b"] == pytest.approx(1.0) and rho["a", "k"] is None and len(rho) == 6
    assert {r["signal"]: r["cluster"] for r in stats.signal_clusters(matrix, names, 0.9).collect()} == {"a": "a", "b": "a", "c": "c", "k": "k"}


def test_floors(spark):
    rows = [("x", i / 100, float(i >= 40)) for i in range(100)] + [("few", 0.9, 1.0)] * 5 + [("never", i / 100, 0.0) for i in range(100)] + [("edge", 0.29, 1.0)] * 30 + [("edge", 0.28, 0.0)] * 60
    got = {r["b"]: r["floor"] for r in metrics.floor_fit(spark.createDataFrame(rows, "b string, u double, em double"), "u", "em", "b", target=0.75).collect()}
    plain = next(i * 0.01 for i in range(101) if sum(em for b, u, em in rows if b == "x" and u >= i * 0.01) >= 0.75 * sum(b == "x" and u >= i * 0.01 for b, u, _ in rows))
    assert got == {"x": plain, "few": 0.38, "never": 0.38, "edge": 29 * 0.01}


def test_axes_roll_up_skips_what_is_missing(spark):
    rows = [(1, 10, 0, 0.5, 0.8, 1.0, None, 0.5), (1, 30, 10, 0.9, None, 1.0, 0.6, 0.5)]
    got = metrics.roll_up_axes(spark.createDataFrame(rows, "g int, n_samples int, n_conf int, acc double, epi double, ret double, cal double, ver double"), ["g"]).first()
    assert got["acc"] == pytest.approx(0.8) and got["epi"] == pytest.approx(0.8) and got["cal"] == pytest.approx(0.6)
    assert got["ces"] == pytest.approx((0.8 * 0.8 * 1.0 * 0.6 * 0.5) ** 0.2)


def test_shrinkage_and_platt(spark):
    rows = spark.createDataFrame([("ab"[i % 2], (i % 10) / 10, float((i % 10) > (3 if i % 2 else 6))) for i in range(400)], "b string, s double, em double")
    own = {(r["b"], r["x"]): r["y"] for r in calibration.shrunk_knots(rows, ["s"], "em", "b", alpha=1.0).collect()}
    half = {(r["b"], r["x"]): r["y"] for r in calibration.shrunk_knots(rows, ["s"], "em", "b", alpha=0.5).collect()}
    pooled = {(r["b"], r["x"]): r["y"] for r in calibration.shrunk_knots(rows, ["s"], "em", "b", alpha=0.0).collect()}
    assert set(own) == set(half) == set(pooled) and all(half[k] == pytest.approx((own[k] + pooled[k]) / 2, abs=0.011) for k in own)
    with pytest.raises(ValueError):
        calibration.shrunk_knots(rows, ["s"], "em", "b", alpha=1.5)
    line = spark.createDataFrame([("g", p, 1 / (1 + math.exp(-(0.5 * math.log(p / (1 - p)) + 1)))) for p in (0.1, 0.3, 0.5, 0.8)], "g string, p double, t double")
    got = calibration.fit_platt(line, "p", "t", ["g"]).first()
    assert got["a"] == pytest.approx(0.5) and got["b"] == pytest.approx(1.0) and got["mae_probability"] == pytest.approx(0.0, abs=1e-9)


def test_rouge_variants_and_harness(spark):
    rows = spark.createDataFrame([(1, "the cat sat", ["a dog", "the cat sat down"]), (2, "x", None)], "k int, p string, g array<string>")
    got = {r["k"]: r["rouge_l"] for r in best_rouge_l(rows, "p", "g").collect()}
    assert got[1] == pytest.approx(0.8) and got[2] == 0.0
    pairs = spark.createDataFrame([("the cat's", "the cat s"), ("", ""), ("!", "a")], "p string, g string")
    assert [r["rouge_l"] for r in spaced_rouge_l(pairs, "p", "g").collect()] == [1.0, 0.0, 0.0]
    asked = [("truthfulqa", "Answer: cat sat", ["cat sat here"], None, 1.0), ("arc_challenge", "Answer: (b)", ["B"], None, 1.0), ("fever", "Answer: refutes", [], "refutes", 1.0), ("new", "Answer: Paris", ["paris"], None, 1.0), ("asqa", "zzz", ["cat"], None, 0.0), ("triviaqa", "Answer: Rome", ["x", "rome"], None, 1.0)]
    frame = spark.createDataFrame([a[:4] for a in asked], "benchmark string, prediction string, golds array<string>, gold_label string")
    assert {r["benchmark"]: r["em"] for r in harness_scores(frame).collect()} == {a[0]: a[4] for a in asked}


def test_spearman_ties_and_constants(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in stats.spearman(rows, "x", "y", ["g"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0


def test_bootstrap_interval_holds_the_mean(spark):
    got = stats.bootstrap_mean(spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") % 2).cast("double").alias("v")), "v", ["g"]).first()
    assert got["lo"] < got["mean"] < got["hi"] and got["hi"] - got["lo"] < 0.2


def test_temperature_recovers_sharpness(spark):
    rows = spark.createDataFrame([("g", 0.9, float(i % 10 < 7)) for i in range(400)] + [("g", 0.1, float(i % 10 < 3)) for i in range(400)] + [("few", 0.9, 1.0)], "b string, p double, y double")
    got = {r["b"]: r["temperature"] for r in calibration.fit_temperatures(rows, "p", "y", "b").collect()}
    assert got["g"] == pytest.approx(math.log(9) / math.log(7 / 3), rel=0.02) and got["few"] == pytest.approx(got["g"], rel=0.05)


def test_capped_targets():
    got = pools.capped_targets({"a": 900, "b": 60, "c": 10}, {"a": 9, "b": 9, "c": 9}, 1000)
    assert got["c"] >= 50 and max(got.values()) <= 400


def test_temperature_evens_shares(spark):
    counts = spark.createDataFrame([("fever", 100), ("triviaqa", 10), ("hotpotqa", 5)], "b string, n long")
    t = [r["target"] for r in pools.temperature_targets(counts, 300, 100.0).collect()]
    assert (max(t) - min(t)) / 300 < 0.3


def test_reweight_copies(spark):
    rows = spark.range(110).select(F.when(F.col("id") < 100, "a").otherwise("b").alias("g"), F.col("id").cast("string").alias("k"))
    got = {r["g"]: (r["n"], r["m"]) for r in pools.reweight(rows, "g", "k", 100).groupBy("g").agg(F.count("*").alias("n"), F.max("copy_no").alias("m")).collect()}
    assert got["a"][1] == 1 and got["b"] == (30, 3)


def test_split_is_disjoint_and_whole(spark):
    got = splits.disjoint_split(spark.range(500), "id", (("x", 0.1), ("y", 0.2), ("z", 0.7)))
    assert {r["pool"]: r["count"] for r in got.groupBy("pool").count().collect()} == {"x": 50, "y": 100, "z": 350}
    with pytest.raises(ValueError):
        splits.disjoint_split(spark.range(5), "id", (("x", 0.5),))


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_and_running_sums_by_pieces(spark, descending):
    rows = [(i, "ab"[i % 3 == 0], float((i * 37) % 50) if i % 11 else None, i % 4) for i in range(400)] + [(1000 + i, "a", 7.0, 1) for i in range(100)] + [(2000, None, 1.0, 1)]
    frame = spark.createDataFrame(rows, "k long, g string, v double, x long")
    got = {r["k"]: (r["rank"], r["group_n"], r["s"]) for r in ranks.numbered(frame, ["g"], "v", "k", descending, {"s": F.col("x")}).collect()}
    wanted = {}
    for g in "ab":
        own = sorted((r for r in rows if r[1] == g and r[2] is not None), key=lambda r: (-r[2] if descending else r[2], r[0]))
        for n, r in enumerate(own):
            wanted[r[0]] = (n + 1, len(own), sum(x[3] for x in own[: n + 1]))
    assert got == wanted
    assert ranks.numbered(frame.limit(0), [], "v", "k").count() == 0


def test_lcs():
    assert lcs_length("a b c d".split(), "b x d".split()) == 2 and lcs_length([], ["a"]) == 0 and lcs_length(["a", "a"], ["a"]) == 1

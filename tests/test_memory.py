import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.functions import confidence as C
from tallyvane.operators import corpus, entropy, joins, memory, trajectory, vector
from tallyvane.operators.graph import connected_components
from tallyvane.operators.vector import knn_join
from tallyvane.sources import files
from tallyvane.sources.staging import stage as write_shared
from tallyvane.streaming import cycles

ENTRY = "entry_id long, embedding array<float>, pool string, answer string, u_stored double, storage_cycle int, retrieval_count long, success_rate double, hit_counter long, age_s double, retroverified boolean, source_benchmark string, merged_benchmarks array<string>"


def entries(spark, rows):
    full = [(i, v, p, a, u, c, 0, 0.0, h, 0.0, None, None, None) for i, v, p, a, u, c, h in rows]
    return spark.createDataFrame(full, ENTRY)


def near(angle):
    return [math.cos(angle), math.sin(angle)]


def test_knn_ties_pools_and_self(spark):
    rows = entries(spark, [(1, near(0), "a", "x", 0.5, 0, 0), (2, near(0), "a", "x", 0.5, 0, 0), (3, near(0), "a", "x", 0.5, 0, 0), (4, near(0), "b", "x", 0.5, 0, 0)])
    got = knn_join(rows, rows, 1, key="entry_id", pool="pool").collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(1, 2), (2, 1), (3, 1)}


def test_novelty_edge_is_novel(spark):
    old = entries(spark, [(1, [1.0, 0.0], "a", "x", 0.5, 0, 0)])
    fresh = entries(spark, [(7, [0.5, 0.0], "a", "x", 0.5, 0, 0), (8, [0.75, 0.0], "a", "x", 0.5, 0, 0)])
    assert [r["entry_id"] for r in memory.novel(fresh, old, 0.5).collect()] == [7]
    assert memory.novel(fresh, old.limit(0), 0.5).count() == 2


def test_prune_takes_the_least_valuable(spark):
    rows = entries(spark, [(i, near(0), "a", "x", i / 10, 0, 0) for i in range(10)])
    assert sorted(r["entry_id"] for r in memory.prune(rows).collect()) == list(range(2, 10))
    tied = entries(spark, [(i, near(0), "a", "x", 0.5, 0, 0) for i in range(5)])
    assert sorted(r["entry_id"] for r in memory.prune(tied).collect()) == [1, 2, 3, 4]
    assert memory.prune(rows.limit(0)).count() == 0


def test_feedback_folds_in_order(spark):
    rows = entries(spark, [(1, near(0), "a", "x", 0.5, 0, 0), (2, near(0), "a", "x", 0.5, 0, 0)])
    events = spark.createDataFrame([(1, k, k != 2) for k in range(6)], "entry_id long, seq long, accepted boolean")
    got = {r["entry_id"]: r for r in memory.feedback(rows, events).collect()}
    u = 0.5
    for _ in range(2):  # the fifth and sixth use
        u += 0.01 * (1 - u)
    assert got[1]["retrieval_count"] == 6 and got[1]["success_rate"] == pytest.approx(5 / 6) and got[1]["u_stored"] == pytest.approx(u) and got[1]["hit_counter"] == 6
    assert got[2]["u_stored"] == 0.5 and got[2]["hit_counter"] == 0


def test_retroverify(spark):
    rows = entries(spark, [(i, near(0), "a", "x", 0.7, 0, 9) for i in range(4)])
    scores = spark.createDataFrame([(0, 0.4), (1, 0.9), (2, None), (3, 0.7)], "entry_id long, new_u double")
    of = lambda **k: {r["entry_id"]: (r["u_stored"], r["hit_counter"], r["retroverified"]) for r in memory.retroverify(rows, scores, 0.0, **k).collect()}
    assert of() == {1: (0.9, 0, True), 2: (0.7, 9, False), 3: (0.7, 0, True)}
    assert of(loops=F.col("entry_id") == 2) == {1: (0.9, 0, True), 3: (0.7, 0, True)}
    lower = spark.createDataFrame([(1, 0.6)], "entry_id long, new_u double")
    assert {r["entry_id"]: r["u_stored"] for r in memory.retroverify(rows, lower, downgrade=False).collect()}[1] == 0.7


def test_consolidate_guards(spark):
    rows = entries(
        spark,
        [
            (1, near(0.0), "a", "x", 0.60, 0, 0), (2, near(0.01), "a", "x", 0.65, 1, 0),
            (3, near(1.0), "a", "x", 0.60, 0, 0), (4, near(1.01), "a", "y", 0.60, 0, 0),
            (5, near(2.0), "a", "x", 0.20, 0, 0), (6, near(2.01), "a", "x", 0.90, 0, 0),
            (7, near(0.0), "b", "x", 0.60, 0, 0),
        ],
    )
    kept, audit = memory.consolidate(rows, write_shared)
    got = {r["root"]: (r["n"], r["outcome"], r["keeper"]) for r in audit.filter("outcome <> 'cross_pool'").collect()}
    assert got == {1: (2, "merged", 2), 3: (2, "answer_mismatch", 3), 5: (2, "u_spread", 6)}
    assert sorted(r["entry_id"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7] and audit.filter("outcome = 'cross_pool'").count() == 4


def test_consolidate_merges(spark):
    rows = [
        (1, near(0.0), "a", "The X", 0.60, 3, 4, 0.5, 2, 0.0, False, "fever", ["asqa"]), (2, near(0.01), "a", "x!", 0.65, 1, 6, 1.0, 3, 0.0, None, "triviaqa", None),
        (3, near(0.02), "a", "x", 0.65, 2, 0, 0.9, 0, 0.0, True, None, ["triviaqa", "hotpotqa"]), (9, near(2.0), "a", "x", 0.1, 0, 1, 0.1, 1, 0.0, False, None, None),
    ]
    kept, _ = memory.consolidate(spark.createDataFrame(rows, ENTRY), write_shared)
    got = {r["entry_id"]: r for r in kept.collect()}
    assert set(got) == {2, 9} and kept.columns == spark.createDataFrame(rows, ENTRY).columns
    r = got[2]
    assert (r["retrieval_count"], r["hit_counter"], r["retroverified"], r["merged_benchmarks"]) == (10, 5, True, ["fever", "asqa", "hotpotqa"])
    assert r["success_rate"] == pytest.approx(0.8) and got[9]["merged_benchmarks"] is None
    assert memory.consolidate(kept.limit(0), write_shared)[0].count() == 0


def test_add_remove_update(spark):
    rows = entries(spark, [(5, near(0), "a", "x", 0.5, 0, 0)])
    fresh = entries(spark, [(0, near(0), "a", "y", 0.3, 0, 0), (0, near(0), "a", "z", 0.2, 0, 0)])
    got = {r["answer"]: r["entry_id"] for r in memory.add(rows, fresh, "u_stored").collect()}
    assert got["x"] == 5 and 5 < got["z"] < got["y"]
    with pytest.raises(RuntimeError):
        memory.add(rows, fresh, "u_stored", capacity=2)
    values = spark.createDataFrame([(5, 1.7), (6, 0.1)], "entry_id long, value double")
    assert [r["u_stored"] for r in memory.update_scores(rows, values).collect()] == [1.0]
    assert memory.remove(rows, values).count() == 0 and memory.get(rows, values).count() == 1


def test_promotion_and_cache(spark):
    done = spark.createDataFrame([(1, [1.0, 0.0], "promoted"), (2, [0.0, 1.0], "promoted"), (3, [0.0, 1.0], "kept")], "entry_id long, embedding array<float>, outcome string")
    stored = spark.createDataFrame([(9, [1.0, 0.0])], "entry_id long, embedding array<float>")
    assert {r["entry_id"]: r["inserted"] for r in memory.promote(done, stored).collect()} == {1: False, 2: True}
    rows = spark.createDataFrame([(i, near(i / 10)) for i in range(6)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(100, "known", near(0)), (101, "short", near(0)), (102, "new", near(0.5))], "query_id long, question string, embedding array<float>")
    cache = spark.createDataFrame([("known", [(7, 0.9), (8, 0.8), (9, 0.7)]), ("short", [(7, 0.9)])], "question string, results array<struct<id:long,similarity:double>>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["source"]) for r in memory.cached_search(asked, cache, rows, 2).collect()}
    assert got == {(100, 1): (7, "cache"), (100, 2): (8, "cache"), (101, 1): (0, "live"), (101, 2): (1, "live"), (102, 1): (5, "live"), (102, 2): (4, "live")}


def test_knn_over_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 5)
    monkeypatch.setattr(vector, "MEET", 2)
    rows = [(i, [float((i * 7) % 13), float((i * 5) % 11)], "ab"[i % 2] if i % 9 else None) for i in range(60)] + [(99, None, "a")]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>, pool string")
    for pool in (None, "pool"):
        got = {(r["query_id"], r["rank"]): r["id"] for r in knn_join(frame, frame, 3, pool=pool).collect()}
        for i, v, p in rows[:-1]:
            others = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for j, w, q in rows[:-1] if j != i and (pool is None or (p is not None and p == q)))[:3]
            assert [got.get((i, k + 1)) for k in range(3)] == [j for _, j in others] + [None] * (3 - len(others))


@pytest.mark.parametrize("decision,tag,icon,shown", [("STORE", "verified", "check", True), ("DEFERRED", "provisional", "tilde", True), ("DISCARD", "conflicting", "warning", True), ("ABSTAIN", "insufficient", "cross", False)])
def test_envelope(spark, decision, tag, icon, shown):
    got = spark.range(1).select(C.envelope(F.lit("Paris"), F.lit(1.7), F.lit(decision), cadence=F.lit("nightly")).alias("e")).first()["e"]
    assert (got["tag"], got["icon"], got["show_answer"], got["confidence"], got["decision"]) == (tag, icon, shown, 1.0, decision)
    assert (got["answer"] is None) == (not shown) and (got["caveat"] is None) == (decision in ("STORE", "ABSTAIN"))
    assert decision != "DEFERRED" or got["caveat"] == "I'll reconsider this in my nightly learning cycle. Please ask again tomorrow."


def test_envelope_of_unknown_decision_and_drift_bounds(spark):
    row = spark.range(1).select(C.envelope(F.lit("x"), F.lit(0.5), F.lit(None).cast("string")).alias("a"), C.envelope(F.lit("x"), F.lit(0.5), F.lit("MAYBE")).alias("b")).first()
    assert row["a"] is None and row["b"] is None
    gates = spark.range(1).select(*(C.drift(F.lit(x)).alias(f"g{k}") for k, x in enumerate((0.0, 1e-3, 1.1e-3, 1e-2, 0.02)))).first()
    assert tuple(gates) == ("SAFE", "SAFE", "WARN", "WARN", "UNSAFE")


def test_directional_grounding(spark):
    of = lambda label, *x: spark.range(1).select(C.directional(F.lit(label).cast("string"), *(F.lit(v).cast("double") for v in x)).alias("d")).first()["d"]
    assert tuple(of("supports", 0.9, 0.8, None, None)) == (0.9, 0.8) and tuple(of("refutes", 0.9, 0.8, 0.2, 0.1)) == (0.2, 0.1)
    assert of("refutes", 0.9, 0.8, None, None) is None and of(None, 0.9, 0.8, 0.1, 0.1) is None
    assert tuple(of("not enough info", 0.55, 0.9, 0.45, 0.5)) == (pytest.approx(0.9), 0.0)


def test_halt_and_stop(spark):
    rates = spark.createDataFrame([(c, b, r) for c, b, r in [(0, "x", 0.1), (1, "x", 0.0), (2, "x", 0.0), (1, "y", 0.0), (2, "y", None), (0, "z", 0.0), (1, "z", 0.0), (2, "z", 0.1)]], "cycle int, benchmark string, rate double")
    scores = spark.createDataFrame([(0.2,), (0.95,), (None,), (float("nan"),)], "collapse double")
    got = [(r["action"], r["relax"]) for r in trajectory.halt(rates, scores).collect()]
    assert got == [("relax_alpha", ["x"]), ("halt", []), ("relax_alpha", ["x"]), ("relax_alpha", ["x"])]
    assert trajectory.halt(rates.filter("cycle = 0"), scores.limit(1)).first()["action"] == "continue"
    cycles = spark.createDataFrame([(0, 0.5, 0.5, 1.0), (1, 0.501, 0.2, 0.93), (2, 0.502, 0.04, 0.92)], "cycle int, ces double, storage_rate double, retention double")
    got = {r["cycle"]: (r["flat"], r["saturated"], r["retained"], r["should_stop"]) for r in trajectory.early_stop(cycles).collect()}
    assert got == {0: (False, False, False, False), 1: (False, False, False, False), 2: (True, True, True, True)}


def test_overlay_refuses_missing_labels(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, em double")
    labels = spark.createDataFrame([(1, 1.0), (2, None)], "id long, label double")
    assert {r["id"]: (r["em_stored"], r["em"]) for r in joins.overlay(rows, labels, "id", "em", "label").collect()} == {1: (0.0, 1.0), 2: (1.0, None)}
    with pytest.raises(Exception, match="no label for 2"):
        joins.overlay(rows, labels.filter("id = 1"), "id", "em", "label").collect()


def test_entropies(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "x")], "k long, c string")
    got = {r["k"]: (r["entropy"], r["h_norm"]) for r in entropy.cluster_entropy(rows, "k", "c").collect()}
    assert got == {1: (pytest.approx(1.0), pytest.approx(0.5)), 2: (0.0, 0.0)}
    assert entropy.kernel_entropy_of(np.eye(4)) == pytest.approx(1.0) and entropy.kernel_entropy_of(np.ones((4, 4))) == pytest.approx(0.0, abs=1e-6) and entropy.kernel_entropy_of(np.ones((1, 1))) == 0.0
    k = np.array([[1.0, 0.5], [0.5, 1.0]])
    assert entropy.kernel_entropy_of(k) == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2))
    samples = spark.createDataFrame([(i,) for i in range(4)], "sample_id long")
    links = spark.createDataFrame([(0, 1, True, True), (1, 2, True, False), (2, 3, True, True)], "u long, v long, forward boolean, backward boolean")
    assert {r["sample_id"]: r["cluster"] for r in entropy.entailment_clusters(samples, links, write_shared).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_deferred(spark):
    buffer = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "entry_id long, age int")
    scores = spark.createDataFrame([(1, 0.9, "STORE"), (2, 0.1, "DISCARD"), (3, 0.1, "DISCARD")], "entry_id long, new_u double, new_decision string")
    got = {r["entry_id"]: (r["outcome"], r["age"]) for r in memory.reconsider(buffer, scores).collect()}
    assert got == {1: ("promoted", 0), 2: ("dropped", 1), 3: ("kept", 1), 4: ("kept", 1)}
    assert sorted(r["entry_id"] for r in memory.push_deferred(buffer, buffer.limit(0), "entry_id", 2).collect()) == [3, 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long"), write_shared).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100 and len(got) == 43
    assert connected_components(spark.createDataFrame([], "u long, v long"), write_shared).count() == 0


@pytest.mark.parametrize("sim,u,pre,tier", [(0.95, 0.8, 0.9, 1), (0.8, 0.5, 0.9, 2), (0.75, 0.5, 0.9, 3), (0.95, 0.9, 0.3, 3), (0.9, 0.9, 0.38, 1)])
def test_route(spark, sim, u, pre, tier):
    assert spark.range(1).select(C.route(F.lit(sim), F.lit(u), F.lit(pre), F.lit(0.38))).first()[0] == tier


@pytest.mark.parametrize("u,g,wanted", [(0.6, 0.0, "STORE"), (0.45, 0.0, "DEFERRED"), (0.4, 0.19, "ABSTAIN"), (0.4, 0.2, "DISCARD")])
def test_decide(spark, u, g, wanted):
    assert spark.range(1).select(C.decide(F.lit(u), F.lit(g))).first()[0] == wanted


def test_composite_skips_missing(spark):
    none = F.lit(None).cast("double")
    knots = {"a": ((0.0, 0.1), (1.0, 0.9)), "b": ((0.0, 0.5), (1.0, 0.5))}
    assert spark.range(1).select(C.composite({"a": none, "b": none}, knots)).first()[0] == 0.5
    assert spark.range(1).select(C.composite({"a": F.lit(1.0), "b": none}, knots)).first()[0] == pytest.approx(0.9)


def test_chunks_and_sections(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(190))), (2, "too short"), (3, None)], "k long, t string")
    got = corpus.chunks(docs, ["k"], "t").orderBy("chunk_no").collect()
    assert [(r["k"], r["chunk_no"], len(r["chunk"].split())) for r in got] == [(1, 0, 100), (1, 1, 100), (1, 2, 10)]
    article = "Title\n" + "one two three " * 8 + "\n\nplain paragraph\n\nReferences\nnoise\n\nmore noise"
    got = corpus.sections(spark.createDataFrame([(1, article)], "k long, t string"), "k", "t").orderBy("section_no").collect()
    assert [(r["section_no"], r["title"], r["body"][:10]) for r in got] == [(0, "Title", "one two th"), (1, "Title", "plain para"), (3, "References", "more noise")]
    told = spark.createDataFrame([(1, " Art ", "plain words " * 12 + "\n\nSee also\nx y z\n\n" + "w " * 12)], "k long, a string, t string")
    got = corpus.passages(told, "k", "t", "a").orderBy("section_no").collect()
    assert [(r["section_no"], r["chunk"].split(" ", 2)[0]) for r in got] == [(0, "Art:"), (2, "See")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "fever_cycle10.json").write_text('{"meta": {"n": "1"}, "samples": [{"id": "a", "em": 1.0, "tier": 2}]}')
    (tmp_path / "bad_cycle2.json").write_text("{not json")
    (tmp_path / "other.json").write_text('{"samples": [{"id": "b"}]}')
    assert [(r["benchmark"], r["cycle"], r["id"]) for r in files.read_cycle_results(spark, str(tmp_path)).collect()] == [("fever", 10, "a")]
    (tmp_path / "s.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_signals(spark, str(tmp_path / "s.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "log.txt").write_text("cycle 3 ratio=0.91\nnoise\n")
    assert files.read_log(spark, str(tmp_path / "log.txt"), r"cycle ([0-9]+) ratio=([0-9.]+)", {"cycle": "int", "ratio": "double"}).first() == (3, 0.91)
    files.save_snapshot(spark.range(3), str(tmp_path / "snap"), 1)
    files.save_snapshot(spark.range(2), str(tmp_path / "snap"), 2)
    files.save_snapshot(spark.range(4), str(tmp_path / "snap"), 1)
    assert {r["cycle"]: r["count"] for r in files.load_snapshot(spark, str(tmp_path / "snap")).groupBy("cycle").count().collect()} == {1: 4, 2: 2}
    files.write_csv(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "csv"))
    assert "NaN" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_loaders(spark):
    rows = spark.createDataFrame([("q", (["x"], "y"), 1), ("r", ([], "z"), 2)], "question string, answer struct<aliases:array<string>,normalized_value:string>, id int")
    assert [r["answers"] for r in files.load_benchmark("triviaqa", rows).orderBy("id").collect()] == [["x"], ["z"]]
    choices = spark.createDataFrame([("q", (["A", "B"], ["foo", "bar"]), "A", 1)], "question string, choices struct<label:array<string>,text:array<string>>, answer string, id int")
    assert "Choices: (A) foo (B) bar" in files.load_benchmark("arc_challenge", choices).first()["question"]
    assert [r["gold_label"] for r in files.synthetic_samples(spark, "fever", 4).orderBy("id").collect()] == ["supports", "refutes", "not enough info", "supports"]
    with pytest.raises(ValueError):
        files.load_benchmark("unknown", rows)
    nq = spark.createDataFrame([("q", ["a", "b"], 1), ("r", [], 2)], "question string, answer array<string>, id int")
    assert [r["answers"] for r in files.load_benchmark("natural_questions", nq).collect()] == [["a", "b"]]
    truth = nq.withColumnRenamed("answer", "correct_answers")
    assert [(r["id"], r["benchmark"]) for r in files.load_benchmark("truthfulqa", truth).collect()] == [("1", "truthfulqa")]
    asqa = spark.createDataFrame([("q", "", [("long",), ("",)], "z", "s1"), ("", "r", [], "single", "s2"), ("x", "", None, "", "s3"), ("", "", [("a",)], "", "s4")], "ambiguous_question string, question string, annotations array<struct<long_answer:string>>, answer string, sample_id string")
    assert sorted((r["id"], r["question"], tuple(r["answers"])) for r in files.load_benchmark("asqa", asqa).collect()) == [("s1", "q", ("long",)), ("s2", "r", ("single",))]
    hotpot = spark.createDataFrame([("q", "a", "h1"), ("", "a", "h2"), ("q", None, "h3")], "question string, answer string, id string")
    assert [(r["id"], r["answers"]) for r in files.load_benchmark("hotpotqa", hotpot).collect()] == [("h1", ["a"])]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 9, "old")], "k long, cycle int, benchmark string")
    files.write_signals(rows, str(tmp_path / "signals"), 3, "fever")
    assert spark.read.json(str(tmp_path / "signals")).select("k", "cycle", "benchmark").first() == (1, 3, "fever")
    for _ in range(2):
        files.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    files.write_atomic(rows, str(tmp_path / "result"))
    files.write_atomic(rows.union(rows), str(tmp_path / "result"))
    with pytest.raises(Exception):
        files.write_atomic(rows.withColumn("x", F.raise_error(F.lit("stop")).cast("int")), str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result")).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["audit", "result", "signals"]


def test_corpus_scan_goes_on_with_new_files(spark, tmp_path):
    article = lambda k: spark.createDataFrame([(k, f"T{k}", "some words " * 30)], "id long, title string, text string")
    seen = []
    for k in (1, 2):
        article(k).write.mode("append").parquet(str(tmp_path / "in"))
        cycles.scan_corpus(spark, str(tmp_path / "in"), "id long, title string, text string", lambda p, n: seen.append((n, sorted(r["chunk"][:3] for r in p.collect()))), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, ["T1:"]), (1, ["T2:"])]


def test_stream_cycles_and_windows(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'view' event_type, 1.0d value, 5L user_id").write.parquet(str(source))
    stream = cycles.read_events(spark, str(source), "ts timestamp, event_type string, value double, user_id long")
    seen = []
    cycles.maintain(stream, lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, 1)]
    assert cycles.event_windows(spark.read.parquet(str(source))).first()["n"] == 1

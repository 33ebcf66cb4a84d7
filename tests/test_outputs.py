"""Objects in prose, lenient scores and verification against plain versions."""

import json
import random


import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvane.functions import capability, jsons
from tallyvane.operators import calibration, scorers, vector


def plain_first(text):
    if not text or "{" not in text:
        return None
    start, depth, quoted, escaped = text.index("{"), 0, False, False
    for i, ch in enumerate(text[start:], start):
        if quoted:
            quoted, escaped = (True, False) if escaped else (ch != '"', ch == "\\")
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def test_first_object_equals_plain_scan():
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choice('{}{}"\\a \n') for _ in range(rng.randrange(14)))
        assert jsons.first_object(text) == plain_first(text), text
    assert jsons.first_object(None) is None and jsons.first_object('"x" {' + "{" * 100_000) is None
    assert len(jsons.first_object('{"a": "' + "\\" * 1_000_000 + '"}')) == 1_000_009


def test_annotations_are_checked(spark):
    good = {"retrieve_decision": "[Retrieve]", "passage_decisions": ["[Relevant]"], "support_decision": "[Partial]", "useful_score": "[Useful:3]", "annotated_answer": 'a "quoted" } \\ é'}
    cases = [(json.dumps(good), 1, True), ("so: " + json.dumps(good, ensure_ascii=False) + " }", 1, True), (json.dumps(good), 2, False), (json.dumps(good)[:-1], 1, False), (None, 1, False), ("{}", 0, False), ("{not json}", 1, False), ("[1]", 1, False)]
    for field, value in (("retrieve_decision", "[Yes]"), ("passage_decisions", "[Relevant]"), ("passage_decisions", ["[Maybe]"]), ("passage_decisions", [1]), ("support_decision", None), ("useful_score", "[Useful:6]"), ("annotated_answer", 5), ("annotated_answer", None)):
        cases.append((json.dumps(good | {field: value}), 1, False))
    cases.append((json.dumps({k: v for k, v in good.items() if k != "annotated_answer"}), 1, False))
    cases.append((json.dumps(good | {"passage_decisions": []}), 0, True))
    df = spark.createDataFrame(cases, "text string, n int, wanted boolean")
    got = df.withColumn("valid", jsons.valid_annotation(jsons.json_object(F.col("text")), F.col("n"))).collect()
    assert [r["valid"] for r in got] == [r["wanted"] for r in got]


CASES = [
    # prediction, gold, benchmark, wanted
    ("Answer: (B) or A", "b", "commonsense_qa", 1.0), ("A rug ... so C", "C", "CSQA", 1.0), ("A rug ... so C", "A", "csqa", 0.0), ("Answer: none of them, B", "B", "csqa", 1.0), ("", "B", "csqa", 0.0), (None, "B", "csqa", 0.0),
    ("Answer: a\nanswer - True.", " YES ", "strategyqa", 1.0), ("no, yes", "yes", "strategy_qa", 1.0), ("no, yes", "0", "strategyqa", 0.0), ("maybe", "maybe", "strategyqa", 0.0), ("yesterday", "yes", "strategyqa", 0.0),
    ("It REFUTES this", "refutes", "fever", 1.0), ("Answer: not_enough", "NEI", "fever", 0.0), ("Answer: not-enough info", "not enough_info", "fever", 1.0), ("nei", "Not Enough Info!", "fever", 1.0), ("supports", "", "fever", None), ("supports", None, "fever", None),
    ("Paris", "Paris", "triviaqa", None), ("éA", "A", "csqa", 0.0), ("Answer: x. Answer:", "A", "csqa", 0.0),
]


def test_capability(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, p string, g string, b string, wanted double")
    for r in df.withColumn("em", capability.capability_em(F.col("p"), F.col("g"), F.col("b"))).collect():
        assert r["em"] == r["wanted"], r


def share(premise, hypothesis):
    words = {w for w in hypothesis.lower().split(" ") if w}
    return len(words & set(premise.lower().split(" "))) / len(words) if words else 0.0


MC = "Which? Choices: (A) red fox (B) blue. \nAnswer with just the letter."
FEVER = "Supports, refutes, not enough info? Claim: the fox is red"
ROWS = [
    (1, MC, "Answer: A", ["a red fox ran", "the blue"], 0.9, 0.1),
    (2, MC, "Answer: E", ["a red fox ran"], 0.9, 0.1),
    (3, FEVER, "Answer: supports", ["the fox is red", "no"], 0.5, 0.5),
    (4, FEVER, "Answer: refutes", ["the fox is not red."], 0.5, 0.5),
    (5, "Who?", " Paris. ", ["answer: paris. it is"], 0.2, None),
    (6, "Who?", "it is Paris", ["paris it", None], 0.2, 0.0),
    (7, "Who?", None, ["x"], 0.9, 0.0),
    (8, "Who?", "x", [], 0.9, 0.0),
    (None, "Who?", "x", ["x"], 0.9, 0.0),
]
SCHEMA = "id long, query string, answer string, passages array<string>, u_token double, u_dropout double"


def test_ground_by_kind(spark):
    got = {r["id"]: (r["kind"], r["p_ground_max"], r["p_ground_mean"]) for r in scorers.ground(spark.createDataFrame(ROWS, SCHEMA), "id", "word_overlap").collect()}
    option = "The answer to the question is: red fox"
    both = [share(p, option) for p in ROWS[0][3]]
    assert got[1] == ("multichoice", max(both), pytest.approx(sum(both) / 2)) and got[2][0] == "plain"
    assert got[3] == ("directional", 1.0, 0.5) and got[4] == ("directional", 1.0, 1.0)
    assert got[5] == ("entity", share("answer: paris. it is", "Answer: Paris."), 1.0)
    assert got[6] == ("plain", pytest.approx(2 / 3), pytest.approx(1 / 3)) and got[7] == ("plain", 0.0, 0.0)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}


def test_verify_from_signals_to_decision(spark):
    knots = {"u_internal": [(0.0, 0.1), (1.0, 0.9)], "p_ground_max": [(0.0, 0.05), (0.5, 0.5), (1.0, 0.95)]}
    done = {r["id"]: r for r in scorers.verify(spark.createDataFrame(ROWS, SCHEMA), "id", "word_overlap", knots).collect()}
    assert len(done) == 9 and done[7]["early"] and done[7]["u_stored"] == 0 and done[7]["decision"] == "DISCARD"
    assert done[8]["kind"] is None and done[8]["early"]
    logit = lambda p: np.log(p / (1 - p))
    z = (logit(0.1 + 0.8 * 0.5) + logit(0.95)) / 2
    assert done[3]["u_internal"] == 0.5 and done[3]["u_stored"] == pytest.approx(1 / (1 + np.exp(-z))) and done[3]["decision"] == "STORE"
    assert done[5]["u_internal"] is None and done[5]["u_stored"] == pytest.approx(0.95)


def test_scorers_declare_what_they_return(spark):
    pairs = spark.createDataFrame([("a", "b"), (None, "b"), ("c", None)], "premise string, hypothesis string")
    odd = scorers.Scorer("odd", lambda p, h: {"entail": pa.array([float("nan"), 7.0, -1.0][: len(p)]), "contradict": pa.array([0.5] * len(p))}, ("entail", "contradict"))
    got = scorers.score_pairs(pairs.coalesce(1), odd).collect()
    assert [r["entail"] for r in got] == [None, 1.0, 0.0] and all(r["contradict"] == 0.5 for r in got)
    with pytest.raises(Exception, match="must return"):
        scorers.score_pairs(pairs, scorers.Scorer("bad", lambda p, h: {"other": p})).collect()
    with pytest.raises(ValueError, match="already"):
        scorers.register(scorers.Scorer("word_overlap", odd.function))


def test_isotonic_pieces_equal_the_whole(spark, monkeypatch):
    from tallyvane.operators import ranks

    rng = random.Random(3)
    rows = [(["a", "b", None][i % 3], (x := round(rng.random(), 2)), float("nan") if i % 50 == 0 else -x + rng.random() * 0.2, float(rng.random() < x), "clash") for i in range(900)] + [("few", 0.5, 0.5, 1.0, "")] * 10
    df = spark.createDataFrame(rows, "bench string, up double, down double, em double, g string")
    whole = {tuple(r) for r in calibration.isotonic_knots(df, ["up", "down"], "em", "bench").collect()}
    monkeypatch.setattr(ranks, "PIECE_ROWS", 20)
    monkeypatch.setattr(calibration, "MERGED", 3)
    cut = {tuple(r) for r in calibration.isotonic_knots(df, ["up", "down"], "em", "bench").collect()}
    assert {(*r[:3], round(r[3], 9)) for r in whole} == {(*r[:3], round(r[3], 9)) for r in cut} and not any(r[0] == "few" for r in whole)
    from pyspark.ml.regression import IsotonicRegression

    means = df.filter("bench = 'a'").groupBy(F.col("up").alias("feature")).agg(F.avg("em").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="feature", weightCol="weight").fit(means)
    at = np.linspace(0, 1, 101)
    mine = sorted((r[2], r[3]) for r in whole if r[:2] == ("a", "up"))
    theirs = np.clip(np.interp(at, list(model.boundaries), list(model.predictions)), 0.02, 0.98)
    assert np.allclose(np.interp(at, *zip(*mine, strict=True)), theirs, atol=0.02) and all(a[1] <= b[1] + 1e-12 for a, b in zip(mine, mine[1:], strict=False))


def test_saturation_recovers_curves(spark):
    rng = random.Random(5)
    curves = {"a": (0.9, 0.5, 0.7), "b": (0.6, 0.2, 0.25)}
    rows = [(g, c, t[0] - t[1] * np.exp(-t[2] * c)) for g, t in curves.items() for c in range(1, 9)]
    rows += [("noisy", c, 0.8 - 0.4 * np.exp(-0.5 * c) + rng.gauss(0, 0.01)) for c in range(1, 11) for _ in range(30)]
    rows += [("a", None, 1.0), ("a", 3, None)]
    df = spark.createDataFrame([(g, c, float(v) if v is not None else None) for g, c, v in rows], "g string, c int, v double")
    got = {r["g"]: r for r in calibration.fit_saturation(df, "g", "c", "v").collect()}
    for g, t in curves.items():
        assert (got[g]["c_inf"], got[g]["a"], got[g]["k"]) == pytest.approx(t, rel=1e-5) and got[g]["r2"] == pytest.approx(1)
        assert got[g]["c_star"] == pytest.approx(np.log(t[1] / (0.01 * t[0])) / t[2], rel=1e-4)
    n = got["noisy"]
    sd = np.sqrt(np.array(n["cov"]).reshape(3, 3).diagonal())
    assert all(abs(x - t) < 4 * s for x, t, s in zip((n["c_inf"], n["a"], n["k"]), (0.8, 0.4, 0.5), sd, strict=True)) and sd.max() < 0.1
    with pytest.raises(Exception, match="three cycles"):
        calibration.fit_saturation(df.filter("c < 3"), "g", "c", "v").collect()
    assert calibration.fit_saturation(df.limit(0), "g", "c", "v").count() == 0


def test_threshold_forest_holds_what_pairs_hold(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 6))
    v = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.05 * rng.standard_normal((150, 6)), np.tile(centres[0], (40, 1))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pools = [["x", "y"][i % 2] for i in range(len(v))]
    rows = [(i, p, r.tolist()) for i, (p, r) in enumerate(zip(pools, v, strict=True))] + [(900, None, v[0].tolist()), (901, "x", None)]
    df = spark.createDataFrame(rows, "id long, pool string, v array<double>")
    edges = vector.threshold_forest(df, "id", "v", 0.97, "pool", lambda a, b: (a[:, None] + b[None, :]) % 7 != 0).collect()

    def groups(pairs):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in pairs:
            root[find(max(find(a), find(b)))] = min(find(a), find(b))
        return {x: find(x) for x in root}

    wanted = [(i, j) for i in range(len(v)) for j in range(i) if pools[i] == pools[j] and v[i] @ v[j] >= 0.97 and (i + j) % 7]
    mine, theirs = groups((r["u"], r["v"]) for r in edges), groups(wanted)
    assert {x: {y for y in mine if mine[y] == mine[x]} for x in mine} == {x: {y for y in theirs if theirs[y] == theirs[x]} for x in theirs}
    assert len(edges) < len(wanted) / 2

"""Cross-validation against one plain fit a model."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvane.operators import validation

SCHEMA = "id long, bench string, a double, b double, k double, em double, x string, y string, cell int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        a, b = rng.gauss(3, 20), rng.random()
        em = float(rng.random() < 1 / (1 + math.exp(-(0.05 * a + 2 * b - 1.5))))
        out.append((i, rng.choice(["fever", "arc", "nq"]), a, b, 7.0, em if rng.random() > 0.05 else None, "clash", "clash", 9))
    return out + [(1000, "fever", None, 0.5, 7.0, 1.0, "", "", 0), (1001, "arc", float("nan"), 0.5, 7.0, 1.0, "", "", 0), (None, "arc", 1.0, 0.5, 7.0, 1.0, "", "", 0), (1002, None, 2.0, 0.1, 7.0, 0.0, "", "", 0)] + [(2000 + i, "one", 1.0 * i, 0.2, 7.0, 1.0, "", "", 0) for i in range(4)]


def plain_fit(x, y, c, balanced):
    """Newton's method for one model; weights and intercept of the raw features."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1)
    a = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(np.eye(len(w)) + c * (a * (s * p * (1 - p))[:, None]).T @ a, w + c * a.T @ (s * (p - y)))
    return np.append(w[:-1] / sd, w[-1] - w[:-1] @ (mean / sd))


def plain_auroc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)) if len(pos) and len(neg) else None


def usable(rows):
    known = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    return known, np.array([r[2:5] for r in known]), np.array([float((r[5] or 0) >= 1) for r in known])


def test_folds_are_even_within_labels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).filter("id is not null").withColumn("label", F.coalesce("em", F.lit(0.0)))
    got = validation.hash_folds(df, "id", "label", 5, 4)
    sizes = [r["count"] for r in got.groupBy("label", "outer", "inner").count().collect()]
    assert max(sizes) - min(s for s in sizes) <= max(sizes) and got.count() == df.count()
    for label in (0.0, 1.0):
        mine = [r["count"] for r in got.filter(F.col("label") == label).groupBy("outer").count().collect()]
        assert max(mine) - min(mine) <= 1
        ids = sorted((r["id"] for r in got.filter((F.col("label") == label) & (F.col("outer") == 0)).collect()))
        order = sorted((r["id"] for r in df.filter(F.col("label") == label).collect()), key=lambda i: (hashlib.sha256(f"42:{i}".encode()).hexdigest()[:15], i))
        assert ids == sorted(order[::5])


def test_nested_equals_plain(spark, rows):
    grid = (0.01, 1.0)
    folds, areas, by = validation.nested_cv(spark.createDataFrame(rows, SCHEMA), ["a", "b", "k"], "em", "id", "bench", grid, 3, 3)
    known, x, y = usable(rows)
    keep = np.array([r[0] is not None for r in known])
    known, x, y = [r for r, k in zip(known, keep, strict=True) if k], x[keep], y[keep]
    place = {}
    for label in (0.0, 1.0):
        order = sorted((r[0] for r, v in zip(known, y, strict=True) if v == label), key=lambda i: (hashlib.sha256(f"42:{i}".encode()).hexdigest()[:15], i))
        place |= {i: (k % 3, k // 3 % 3) for k, i in enumerate(order)}
    outer, inner = (np.array([place[r[0]][s] for r in known]) for s in (0, 1))
    found = {r["outer"]: r for r in folds.collect()}
    tried = {(r["outer"], r["c"]): r["auroc"] for r in areas.collect()}
    out = np.zeros(len(y))
    for f in range(3):
        means = {}
        for c in grid:
            each = []
            for j in range(3):
                w = plain_fit(x[(outer != f) & (inner != j)], y[(outer != f) & (inner != j)], c, True)
                held = (outer != f) & (inner == j)
                each.append(plain_auroc(x[held] @ w[:-1] + w[-1], y[held]))
            means[c] = np.mean(each)
            assert tried[f, c] == pytest.approx(means[c], abs=1e-6)
        best = max(means, key=means.get)
        w = plain_fit(x[outer != f], y[outer != f], best, True)
        out[outer == f] = 1 / (1 + np.exp(-(x[outer == f] @ w[:-1] + w[-1])))
        assert found[f]["best_c"] == best and found[f]["auroc"] == pytest.approx(plain_auroc(out[outer == f], y[outer == f]), abs=1e-6)
    areas_by = {(r["bench"], r["pooled"]): r for r in by.collect()}
    assert areas_by[None, True]["auroc"] == pytest.approx(plain_auroc(out, y), abs=1e-6) and areas_by[None, True]["n"] == len(y)
    assert areas_by["one", False]["auroc"] is None and areas_by["one", False]["n"] == 4
    arc = np.array([r[1] == "arc" for r in known])
    assert areas_by["arc", False]["auroc"] == pytest.approx(plain_auroc(out[arc], y[arc]), abs=1e-6)


def test_leave_one_out_equals_plain(spark, rows):
    got = {(r["bench"], r["pooled"]): r for r in validation.leave_one_out(spark.createDataFrame(rows, SCHEMA), ["a", "b", "k"], "em", "bench").collect()}
    known, x, y = usable([r for r in rows if r[1] is not None])
    bench = np.array([r[1] for r in known])
    scores, labels = [], []
    for name in ("fever", "arc", "nq"):
        w = plain_fit(x[bench != name], y[bench != name], 1.0, False)
        p = 1 / (1 + np.exp(-(x[bench == name] @ w[:-1] + w[-1])))
        r = got[name, False]
        assert r["auroc"] == pytest.approx(plain_auroc(p, y[bench == name]), abs=1e-6) and r["n_test"] == (bench == name).sum()
        assert r["accuracy"] == pytest.approx(((p > 0.5) == y[bench == name]).mean()) and r["pos_rate"] == pytest.approx(y[bench == name].mean())
        scores.append(p)
        labels.append(y[bench == name])
    assert got["one", False]["auroc"] is None and got["one", False]["accuracy"] is None and got["one", False]["pos_rate"] == 1.0
    assert got[None, True]["auroc"] == pytest.approx(plain_auroc(np.concatenate(scores), np.concatenate(labels)), abs=1e-6)


def test_validation_of_little(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert [r["auroc"] for r in validation.leave_one_out(nothing, ["a", "b"], "em", "bench").collect() if not r["pooled"]] == []
    folds, areas, by = validation.nested_cv(nothing, ["a"], "em", "id", "bench")
    assert folds.count() == 0 and areas.count() == 0 and by.filter("not pooled").count() == 0


def test_rows_that_agree_are_read_as_one(spark):
    from tallyvane.sources.staging import Scratch

    rows = [(i, "arc" if i % 2 else "nq", float(i % 4), float(i % 3 == 0), 7.0, float(i % 7 < 3), "", "", 0) for i in range(1200)]
    scratch = Scratch(spark)
    folds, areas, by = validation.nested_cv(spark.createDataFrame(rows, SCHEMA), ["a", "b", "k"], "em", "id", "bench", (0.1, 1.0), 3, 3, scratch=scratch)
    staged = spark.read.parquet(scratch.tables["folded"][0])
    # 9 cells, 2 benchmarks, 2 labels, 4 and 2 values of the features: never more rows than these, however many there are
    assert staged.count() <= 9 * 2 * 2 * 8 and staged.agg(F.sum("times")).first()[0] == 1200
    assert {r["bench"]: r["n"] for r in by.collect()} == {"arc": 600, "nq": 600, None: 1200} and folds.count() == 3 and areas.count() == 6
    scratch.close()

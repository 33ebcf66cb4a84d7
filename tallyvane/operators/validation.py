"""Cross-validation of many logistic models at once.

Rows are dealt to cells: pairs of outer and inner folds, or the benchmark they come from. A model is trained on some cells, so
what it is standardised by are sums over cells, and a Newton step of all models is one pass over the rows: each task sums the
gradients and curvatures of all models for its rows. Only such sums reach the driver, a few numbers a model. Rows that agree in
cell, label and features are one with a multiplicity, so that what is read again and again are the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.metrics import auroc
from tallyvane.operators.ranks import numbered
from tallyvane.sources.staging import Scratch

#: Fixed values of the analytics: the grid of inverse regularisation, and the rows that a benchmark's own area needs.
C_GRID = (0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
LEAST_ROWS = 5
#: Cells that rows may be dealt to; the driver keeps a few sums of each.
MAX_CELLS = 10_000
STEPS, CLOSE = 40, 1e-9
#: Bits of the hash that folds are dealt by, and those of its first ones by which its order is cut.
HASH_BITS, PIECE_BITS = 60, 12


def hash_folds(rows: DataFrame, key: str, label: str, outer: int = 5, inner: int = 5, seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """rows with outer and inner: folds of near equal size within each label, dealt in the order of a hash of a key; rows of one
    key in the order of the columns `ties`, so that what they hold decides and not how they are spread.

    The rows of one outer fold are themselves dealt evenly to inner folds, so those of all others are too.
    """
    order = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 15), 16, 10).cast("long")
    # hashes are even, so their first bits cut them into even pieces: no percentiles are needed
    piece = F.shiftright("fold_hash_", HASH_BITS - PIECE_BITS).cast("int")
    ranked = numbered(rows.withColumns({"fold_hash_": order, "fold_tie_": F.struct(key, *ties)}), [label], "fold_hash_", "fold_tie_", piece=piece, rank="fold_rank_", size="fold_n_")
    at = F.col("fold_rank_") - 1
    return ranked.withColumns({"outer": (at % outer).cast("int"), "inner": (F.floor(at / outer) % inner).cast("int")}).drop("fold_hash_", "fold_tie_", "fold_rank_", "fold_n_")


def _moments(rows: DataFrame, n_cells: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: rows, rows of label 1, and mean and squared deviation of each feature."""
    x = lambda j: F.element_at("x", j + 1)
    n, pos, mean, dev = np.zeros(n_cells), np.zeros(n_cells), np.zeros((n_cells, p)), np.zeros((n_cells, p))
    found = rows.groupBy("cell").agg(F.sum("times"), F.sum(F.col("times") * F.col("y")), *(F.sum(F.col("times") * x(j)) / F.sum("times") for j in range(p)))
    for r in found.collect():  # a row a cell
        n[r[0]], pos[r[0]], mean[r[0]] = r[1], r[2], r[3:]
    # deviations from the means themselves: sums of squares would lose what small deviations from large means hold
    means = F.broadcast(rows.sparkSession.createDataFrame([(c, mean[c].tolist()) for c in np.flatnonzero(n).tolist()], "cell int, mean array<double>"))
    around = rows.join(means, "cell").groupBy("cell").agg(F.count("*"), *(F.sum(F.col("times") * (x(j) - F.element_at("mean", j + 1)) ** 2) for j in range(p)))
    for r in around.collect():
        dev[r[0]] = r[2:]
    return n, pos, mean, dev


def _pooled(n: np.ndarray, mean: np.ndarray, dev: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over each model's cells; a deviation of 0 counts as 1."""
    w = member.T * n
    total = np.maximum(w.sum(axis=1, keepdims=True), 1)
    centre = w @ mean / total
    spread = member.T @ dev + np.einsum("mc,mcp->mp", w, (mean[None] - centre[:, None]) ** 2)
    scale = np.sqrt(np.maximum(spread / total, 0))
    return centre, np.where(scale > 0, scale, 1.0)


def fit_many(rows: DataFrame, member: np.ndarray, c: Sequence[float], balanced: bool, partial_models: int = 1024) -> np.ndarray:
    """Coefficients and, last, the intercept of one logistic model a column of `member`, which says on what cells it is trained.

    rows: cell int, y double (0 or 1), x array<double>, times long (how many rows it stands for), staged: they are read once a
    step. Features are standardised by each
    model's own rows; all weights, that of the constant among them, are held by an L2 penalty against `c` times the loss;
    `balanced` weighs the classes equally. A model whose rows have one class alone gets NaN.
    """
    n_cells, n_models = member.shape
    if n_cells > MAX_CELLS or n_models > partial_models:
        raise ValueError("too many cells or models to sum on the driver")
    p = len((rows.select("x").first() or [[]])[0])
    n, pos, mean, dev = _moments(rows, n_cells, p)
    member = member.astype(float)
    all_centre, all_scale = (v[0] for v in _pooled(n, mean, dev, np.ones((n_cells, 1))))
    centre, scale = _pooled(n, mean, dev, member)
    # the affine map of each model's own standardised weights to those of all rows' standardised features
    shift, stretch = (centre - all_centre) / all_scale, scale / all_scale
    maps = np.zeros((n_models, p + 1, p + 1))
    for m in range(n_models):
        maps[m, :p, :p] = np.diag(1 / stretch[m])
        maps[m, p, :p], maps[m, p, p] = -shift[m] / stretch[m], 1
    ones, total = member.T @ pos, member.T @ n
    two = (ones > 0) & (ones < total)
    weight = np.ones((n_models, 2))
    if balanced:
        weight[two] = np.stack([total / (2 * np.maximum(total - ones, 1)), total / (2 * np.maximum(ones, 1))], axis=1)[two]
    inverse = np.asarray(c, float)
    ia, ib = np.triu_indices(p + 1)

    def sums(models: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """Loss, gradient and curvature of some models at some weights, by one pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(models), 1 + p + 1 + len(ia)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                a = np.concatenate([(x - all_centre) / all_scale, np.ones((len(x), 1))], axis=1)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                s = member[batch.column("cell").to_numpy()][:, models] * weight[models][:, y.astype(int)].T * batch.column("times").to_numpy()[:, None]
                z = a @ at.T
                prob = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                out[:, 0] += (s * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
                out[:, 1 : p + 2] += (s * (prob - y[:, None])).T @ a
                out[:, p + 2 :] += (s * prob * (1 - prob)).T @ (a[:, ia] * a[:, ib])
            k = np.tile(np.arange(out.shape[1]), len(models))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(models, out.shape[1])), pa.array(k), pa.array(out.ravel())], names=["model", "k", "value"])

        found = rows.select("cell", "y", "x", "times").mapInArrow(run, "model long, k long, value double").groupBy("model", "k").agg(F.sum("value").alias("value"))
        values = {int(m): np.zeros(1 + p + 1 + len(ia)) for m in models}
        for r in found.collect():  # some numbers a model
            values[r["model"]][r["k"]] = r["value"]
        return values

    own, before, last = np.zeros((n_models, p + 1)), np.zeros((n_models, p + 1)), np.full(n_models, np.inf)
    active = np.flatnonzero(two)
    for _ in range(STEPS):
        if not len(active):
            break
        values = sums(active, np.stack([maps[m] @ own[m] for m in active]))
        going = []
        for m in active:
            v = values[int(m)]
            loss = 0.5 * own[m] @ own[m] + inverse[m] * v[0]
            if loss > last[m] + 1e-9 * abs(last[m]):  # too far: half way back
                own[m] = (own[m] + before[m]) / 2
                going.append(m)
                continue
            curve = np.zeros((p + 1, p + 1))
            curve[ia, ib] = curve[ib, ia] = v[p + 2 :]
            gradient = own[m] + inverse[m] * maps[m].T @ v[1 : p + 2]
            step = np.linalg.solve(np.eye(p + 1) + inverse[m] * maps[m].T @ curve @ maps[m], gradient)
            before[m], last[m] = own[m].copy(), loss
            own[m] = own[m] - step
            if np.abs(step).max() > CLOSE:
                going.append(m)
        active = np.array(going, int)
    joint = np.einsum("mab,mb->ma", maps, own)
    out = np.concatenate([joint[:, :p] / all_scale, (joint[:, p] - joint[:, :p] @ (all_centre / all_scale))[:, None]], axis=1)
    out[~two] = np.nan
    return out


def _prepared(rows: DataFrame, features: Sequence[str], label: str, cell: Column, keep: Sequence[str]) -> DataFrame:
    """Rows with all features: cell, y (1 from 1 up, else 0), x, and columns that are kept."""
    known = rows
    for f in features:
        known = known.filter(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    y = F.coalesce((F.col(label) >= 1).cast("double"), F.lit(0.0))
    return known.select(cell.cast("int").alias("cell"), y.alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), *keep)


def _alike(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of some columns, and as times how many rows have them."""
    return rows.groupBy(*columns).agg(F.count("*").alias("times"))


def _probability(weights: Column) -> Column:
    z = F.aggregate(F.zip_with("x", F.slice(weights, 1, F.size("x")), lambda a, b: a * b), F.element_at(weights, -1), lambda s, v: s + v)
    return 1.0 / (1.0 + F.exp(-z))


def _models(rows: DataFrame, columns: Sequence[str], schema: str, values: list[tuple]) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(values, f"{schema}, w array<double>").toDF(*columns, "w"))  # a row a model


def nested_cv(rows: DataFrame, features: Sequence[str], label: str, key: str, by: str, grid: Sequence[float] = C_GRID, outer: int = 5, inner: int = 5, seed: int = 42, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested cross-validation of a class-balanced logistic model over folds by hash within strata.

    Returns folds (outer, best_c, inner_auroc, auroc), the grid (outer, c, auroc: the mean over inner folds, those of one class
    left out) and areas of out-of-fold probabilities by benchmark (by, n, auroc, null below LEAST_ROWS rows or without both
    classes; the row whose `by` is null and pooled is true holds all). The best c is the first of largest area; 0.05 where no
    fold has one. Rows without a feature or key are left out; a null label counts as 0.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    ready = _prepared(rows.filter(F.col(key).isNotNull()), features, label, F.lit(0), [F.col(key).alias("key"), F.col(by).cast("string").alias("by")])
    folded = hash_folds(ready, "key", "y", outer, inner, seed, ["by", "x"]).withColumn("cell", F.col("outer") * inner + F.col("inner"))
    data = scratch(_alike(folded, ["outer", "inner", "cell", "by", "y", "x"]), "folded")
    cells = np.arange(outer * inner)
    inside = [(f, j, c) for f in range(outer) for j in range(inner) for c in grid]
    member = np.stack([(cells // inner != f) & (cells % inner != j) for f, j, _ in inside], axis=1)
    weights = fit_many(data, member, [c for *_, c in inside], balanced=True)
    fitted = _models(rows, ["f", "j", "c"], "f int, j int, c double", [(*m, w.tolist()) for m, w in zip(inside, weights, strict=True) if not np.isnan(w).any()])
    tried = data.join(fitted, (F.col("inner") == F.col("j")) & (F.col("outer") != F.col("f"))).select("f", "j", "c", "y", "times", _probability(F.col("w")).alias("score"))
    areas = scratch(auroc(tried, "score", "y", ["f", "j", "c"], None, "times").filter("auroc is not null").groupBy(F.col("f").alias("outer"), "c").agg(F.avg("auroc").alias("auroc")), "grid")
    best = {r["outer"]: r["best"] for r in areas.groupBy("outer").agg(F.max(F.struct("auroc", -F.col("c"))).alias("best")).collect()}  # a row a fold
    chosen = [(f, -best[f][1] if f in best else 0.05, best[f][0] if f in best else None) for f in range(outer)]
    final = fit_many(data, np.stack([cells // inner != f for f in range(outer)], axis=1), [c for _, c, _ in chosen], balanced=True)
    outside = _models(rows, ["f", "c", "inner_auroc"], "f int, c double, a double", [(*m, w.tolist()) for m, w in zip(chosen, final, strict=True) if not np.isnan(w).any()])
    scored = scratch(data.join(outside, F.col("outer") == F.col("f")).select("by", "outer", F.col("c").alias("best_c"), "inner_auroc", "y", "times", _probability(F.col("w")).alias("score")), "out-of-fold")
    folds = scored.select("outer", "best_c", "inner_auroc").distinct().join(auroc(scored, "score", "y", ["outer"], None, "times").select("outer", "auroc"), "outer")
    counts = scored.groupBy("by").agg(F.sum("times").alias("n"))
    own = auroc(scored, "score", "y", ["by"], None, "times").alias("a").join(counts.alias("b"), F.col("a.by").eqNullSafe(F.col("b.by")))
    each = own.select(F.col("a.by").alias("by"), F.lit(False).alias("pooled"), "n", F.when(F.col("n") >= LEAST_ROWS, F.col("auroc")).alias("auroc"))
    pooled = auroc(scored, "score", "y", [], None, "times").select(F.lit(None).cast("string").alias("by"), F.lit(True).alias("pooled"), (F.col("n_pos") + F.col("n_neg")).alias("n"), "auroc")
    return folds, areas, each.unionByName(pooled).withColumnRenamed("by", by)


def leave_one_out(rows: DataFrame, features: Sequence[str], label: str, by: str, c: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """by, pooled, n_test, auroc, accuracy, pos_rate of each benchmark under a model trained on all others, and a pooled row.

    Benchmarks are few and named: each is a cell, and what a model is trained on is the total less one. A held-out benchmark of
    one class has no area and no accuracy and is left out of the pooled row; so is one whose others have one class. Rows
    without a feature or benchmark are left out; a null label counts as 0.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    names = sorted(r[0] for r in rows.select(F.col(by).cast("string")).distinct().limit(MAX_CELLS + 1).collect() if r[0] is not None)
    numbers = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(names)), "number int, name string"))  # a row a benchmark
    named = _prepared(rows.join(numbers, F.col(by).cast("string") == F.col("name")), features, label, F.col("number"), ["name"])
    data = scratch(_alike(named, ["cell", "name", "y", "x"]), "by-benchmark")
    weights = fit_many(data, ~np.eye(len(names), dtype=bool), [c] * len(names), balanced=False) if names else np.zeros((0, 1))
    fitted = _models(rows, ["m"], "m int", [(m, w.tolist()) for m, w in enumerate(weights) if not np.isnan(w).any()])
    scored = scratch(data.join(fitted, F.col("cell") == F.col("m"), "left").select("name", "y", "times", F.when(F.col("w").isNotNull(), _probability(F.col("w"))).alias("score")), "held-out")
    share = lambda value: F.sum(F.col("times") * value) / F.sum("times")
    facts = scored.groupBy("name").agg(F.sum("times").alias("n_test"), share(F.col("y")).alias("pos_rate"), share(((F.col("score") > 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"))
    areas = auroc(scored, "score", "y", ["name"], None, "times").select("name", "auroc")
    both = facts.join(areas, "name", "left").select(F.col("name").alias(by), F.lit(False).alias("pooled"), "n_test", "auroc", F.when(F.col("auroc").isNotNull(), F.col("accuracy")).alias("accuracy"), "pos_rate")
    judged = scored.join(areas.filter("auroc is not null").select("name"), "name", "left_semi")
    pooled = auroc(judged, "score", "y", [], None, "times").select(F.lit(None).cast("string").alias(by), F.lit(True).alias("pooled"), (F.col("n_pos") + F.col("n_neg")).alias("n_test"), "auroc", F.lit(None).cast("double").alias("accuracy"), (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("pos_rate"))
    return both.unionByName(pooled)

"""Fitting of calibration models. Rows are first counted by distinct (score, label), so what is fitted on is small or stays
in Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.ranks import _place, edges_of

LEAST_ROWS = 50
#: Pieces of an order whose blocks are pooled together.
MERGED = 32
#: Scores are counted on a grid of log odds, so many steps a unit, before a temperature is fitted: a group is a bounded number
#: of rows, whatever its size.
GRID = 1_000


def _golden(loss, low: float, high: float, steps: int = 60) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return (a + b) / 2


def temperature_of(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The temperature of least log loss, its logarithm held to [-3, 3]."""
    z = np.log(p / (1 - p))

    def loss(log_t: float) -> float:
        q = np.clip(1 / (1 + np.exp(-z / math.exp(log_t))), 1e-12, 1 - 1e-12)
        return float(-(n * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum())

    return math.exp(_golden(loss, -3.0, 3.0))


def fit_temperatures(rows: DataFrame, score: str, label: str, by: str, least: int = 20) -> DataFrame:
    """temperature for each group; groups of fewer than `least` rows or of one class take that of all rows."""
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    # the grid is even in log odds, where the temperature works, so that extreme scores keep their distance
    p = 1.0 / (1.0 + F.exp(-F.round(F.log(held / (1.0 - held)) * GRID) / GRID))
    counted = rows.filter(F.col(score).isNotNull()).groupBy(by, p.alias("p"), F.coalesce(label, F.lit(0.0)).alias("y")).agg(F.count("*").alias("n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        p = part["p"].clip(1e-6, 1 - 1e-6).to_numpy()
        y, n = part["y"].to_numpy(), part["n"].to_numpy()
        total, right = n.sum(), (n * (y == 1)).sum()
        t = temperature_of(p, y, n) if total >= least and 0 < right < total else None
        return pd.DataFrame({"key": [part["key"].iloc[0]], "rows": [int(total)], "temperature": [t]})

    schema = "key string, rows long, temperature double"
    keyed = counted.withColumn("key", F.col(by).cast("string")).select("key", "p", "y", "n")
    own = keyed.groupBy("key").applyInPandas(fit, schema)
    pooled = keyed.withColumn("key", F.lit("all")).groupBy("key", "p", "y").agg(F.sum("n").alias("n")).groupBy("key").applyInPandas(fit, schema)
    pooled = pooled.select(F.col("temperature").alias("pooled"))
    return own.crossJoin(F.broadcast(pooled)).select(F.col("key").alias(by), "rows", F.coalesce("temperature", "pooled", F.lit(1.0)).alias("temperature"))  # one row


def pool_violators(low: np.ndarray, high: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order, each of a range, a mean and a weight, with neighbours whose means do not rise pooled into one."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), mean.tolist(), weight.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] >= out[-1][2]:
            _, top, m, w = out.pop()
            last = out[-1]
            last[1], last[2], last[3] = top, (last[2] * last[3] + m * w) / (last[3] + w), last[3] + w
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return tuple(np.array(c, float) for c in columns)


def isotonic_knots(rows: DataFrame, signals: list[str], label: str, by: str | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """signal, x, y (and `by` before them): the knots of each signal's isotonic regression, in each group of `by`, rising or
    falling as the signal and the label correlate, y held to [0.02, 0.98]; none for groups of fewer than `least` rows.

    Rows are counted by distinct value, the values' order is cut into pieces, and violators are pooled in each piece; what is
    left of MERGED pieces at a time, few blocks each, is pooled again until one is left. Pooling parts first does not change
    the result. A null group is a group; NaN counts as missing.
    """
    group = (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("g")
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = rows.select(group, F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), known(c).alias("x")) for c in signals))).alias("e"))
    long = long.select("g", "y", "e.*").filter("x is not null")
    facts = long.groupBy("g", "signal").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c")).filter(F.col("n") >= least)
    counted = long.groupBy("g", "signal", "x").agg(F.avg("y").alias("m"), F.count("*").cast("double").alias("w"))
    sign = F.when(F.col("c") >= 0, 1.0).otherwise(-1.0)
    joined = counted.alias("a").join(facts.select("g", "signal", sign.alias("up")).alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.signal") == F.col("b.signal")))
    (edges,) = edges_of(counted, "x")
    blocks = joined.select("a.g", "a.signal", "up", _place(F.col("x"), edges).cast("long").alias("piece"), F.col("x").alias("low"), F.col("x").alias("high"), (F.col("m") * F.col("up")).alias("m"), "w")
    schema = "g string, signal string, up double, piece long, low double, high double, m double, w double"

    def pooled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("low")
        low, high, m, w = pool_violators(*(part[c].to_numpy() for c in ("low", "high", "m", "w")))
        first = part.iloc[0]
        return pd.DataFrame({"g": first["g"], "signal": first["signal"], "up": first["up"], "piece": first["piece"], "low": low, "high": high, "m": m, "w": w})

    pieces = 2 * len(edges) + 1
    while True:
        blocks = blocks.groupBy("g", "signal", "piece").applyInPandas(pooled, schema)
        if pieces == 1:
            break
        pieces = -(-pieces // MERGED)
        blocks = blocks.withColumn("piece", F.floor(F.col("piece") / MERGED))
    y = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("m") * F.col("up")))
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    return blocks.select(*([F.col("g").alias(by)] if by else []), "signal", F.explode(ends).alias("x"), y.alias("y"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0) -> DataFrame:
    """name, weight of a logistic regression with inverse regularisation c, without standardisation."""
    data = rows.select(*features, F.coalesce(F.col(label), F.lit(0.0)).alias("label")).dropna().groupBy(*features, "label").agg(F.count("*").cast("double").alias("weight"))
    made = VectorAssembler(inputCols=features, outputCol="features").transform(data)
    n = made.agg(F.sum("weight")).first()[0] or 1.0
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (n * c), standardization=False, maxIter=50).fit(made)
    values = [*map(float, model.coefficients), float(model.intercept)]
    return rows.sparkSession.createDataFrame(list(zip([*features, "intercept"], values, strict=True)), "name string, weight double")


def shrunk_knots(rows: DataFrame, signals: list[str], label: str, by: str, alpha: float = 0.6, masks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """by, signal, x, y: each group's own isotonic knots, drawn towards the curve of all rows: alpha of the former, the rest of
    the latter, held to [0.02, 0.98]. `masks` names signals that a group leaves out; a signal without a pooled curve stays.

    All groups are fitted at once; a signal's knots, far fewer than its rows, meet its pooled curve in one task.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must lie in [0, 1]")
    own = isotonic_knots(rows, signals, label, by)
    for group, left_out in (masks or {}).items():
        own = own.filter(~(F.col(by).eqNullSafe(F.lit(group)) & F.col("signal").isin(*left_out)))

    def drawn(mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        curve = all_.sort_values("x")
        if len(mine) and len(curve):
            mine["y"] = np.clip(alpha * mine["y"] + (1 - alpha) * np.interp(mine["x"], curve["x"], curve["y"]), 0.02, 0.98)
        return mine

    pooled = isotonic_knots(rows, signals, label)
    return own.groupBy("signal").cogroup(pooled.groupBy("signal")).applyInPandas(drawn, own.schema)


def _saturating(theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c_inf - a exp(-k x) and its derivatives by the three."""
    e = np.exp(-theta[2] * x)
    return theta[0] - theta[1] * e, np.stack([np.ones_like(x), -e, theta[1] * x * e], axis=1)


def saturation_of(x: np.ndarray, n: np.ndarray, mean: np.ndarray, within: float, low: float, high: float, steps: int = 5000) -> tuple[np.ndarray, float, np.ndarray]:
    """The parameters of least squares, R² and their covariance, by Gauss-Newton steps damped as long as they do not help.

    x: cycles, of which each has n values of some mean; within: what the values deviate from their cycle's mean, squared and
    summed; low and high: the least and largest value.
    """
    loss = lambda f: float((n * (mean - f) ** 2).sum())
    theta, damping = np.array([high + 0.1 * abs(high) + 0.05, max(high - low, 1e-3), 0.5]), 1e-3
    f, j = _saturating(theta, x)
    now = loss(f)
    for _ in range(steps):
        a, g = j.T @ (n[:, None] * j), j.T @ (n * (mean - f))
        step = np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
        tried = theta + step
        with np.errstate(over="ignore", invalid="ignore"):
            f_new, j_new = _saturating(tried, x)
            new = loss(f_new)
        if np.isfinite(new) and new <= now:
            settled = now - new <= 1e-15 * max(now, 1e-300) and np.abs(step).max() <= 1e-9 * max(1.0, np.abs(theta).max())
            theta, f, j, now, damping = tried, f_new, j_new, new, max(damping / 3, 1e-12)
            if settled:
                break
        elif damping > 1e12:
            break
        else:
            damping *= 4
    else:
        raise RuntimeError("the saturation fit did not converge")
    total, sse = n.sum(), now + within
    around = float((n * (mean - (n * mean).sum() / total) ** 2).sum()) + within
    spread = sse / (total - 3) if total > 3 else np.inf
    cov = np.linalg.pinv(j.T @ (n[:, None] * j)) * spread if np.isfinite(spread) else np.full((3, 3), np.inf)
    return theta, 1 - sse / around if around > 0 else 0.0, cov


def fit_saturation(rows: DataFrame, by: str, cycle: str, value: str, eps: float = 0.01) -> DataFrame:
    """by, n_cycles, c_inf, a, k, r2, cov (row by row) and c_star of value = c_inf - a exp(-k cycle), for each group.

    c_star is the cycle from which the gap is below `eps` of c_inf: 1 if it always was; null without convergence (k, a or
    c_inf not above 0). Rows are summed by cycle first, so a group is a row a cycle. Fewer than three cycles are an error.
    Rows without cycle or value are left out; a null group is a group; no rows give none.
    """
    v = F.col(value).cast("double")
    known = rows.filter(F.col(cycle).isNotNull() & v.isNotNull() & ~F.isnan(v))
    sums = known.groupBy(F.col(by).cast("string").alias("g"), F.col(cycle).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("within"), F.min(v).alias("low"), F.max(v).alias("high"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 3:
            raise ValueError(f"{part['g'].iloc[0]}: a saturation fit needs three cycles at least, not {len(part)}")
        part = part.sort_values("x")
        theta, r2, cov = saturation_of(*(part[c].to_numpy() for c in ("x", "n", "mean")), float(part["within"].sum()), part["low"].min(), part["high"].max())
        return pd.DataFrame({"g": [part["g"].iloc[0]], "n_cycles": [len(part)], "c_inf": [theta[0]], "a": [theta[1]], "k": [theta[2]], "r2": [r2], "cov": [cov.ravel().tolist()]})

    found = sums.groupBy("g").applyInPandas(fit, "g string, n_cycles long, c_inf double, a double, k double, r2 double, cov array<double>")
    ratio = F.col("a") / (F.lit(eps) * F.col("c_inf"))
    star = F.when((F.col("k") > 0) & (F.col("c_inf") > 0) & (F.col("a") > 0), F.when(ratio <= 1, 1.0).otherwise(F.log(ratio) / F.col("k")))
    return found.withColumn("c_star", star).withColumnRenamed("g", by)


def fit_platt(rows: DataFrame, raw: str, target: str, by: list[str], eps: float = 1e-6) -> DataFrame:
    """by, n, a, b, rho, mae_logit, mae_probability: the least-squares line logit(target) = a logit(raw) + b and how well it
    fits. Rows without either are left out. Two passes of partial sums."""
    held = lambda c: F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(c)))
    odds = lambda p: F.log(p / (1.0 - p))
    known = rows.filter(F.col(raw).isNotNull() & F.col(target).isNotNull()).select(*by, odds(held(raw)).alias("x"), odds(held(target)).alias("y"), F.col(target).alias("t"))
    line = known.groupBy(*by).agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.corr("x", "y").alias("rho"))
    z = F.col("a") * F.col("x") + F.col("b")
    fitted = known.join(line, by).groupBy(*by, "a", "b", "rho")
    return fitted.agg(F.count("*").alias("n"), F.avg(F.abs(z - F.col("y"))).alias("mae_logit"), F.avg(F.abs(1.0 / (1.0 + F.exp(-z)) - F.col("t"))).alias("mae_probability"))

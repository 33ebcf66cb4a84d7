"""The few text operators that Spark's expressions cannot hold: zlib ratios and longest common subsequences, in Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyvane.functions import text as T

LEAST_TOKENS, LEAST_DISTINCT, LEAST_RATIO = 20, 0.25, 0.35


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """zlib bytes over UTF-8 bytes; 1 for a missing or empty text."""

    def ratio(text: str | None) -> float:
        raw = (text or "").encode("utf-8", "replace")
        return len(zlib.compress(raw)) / len(raw) if raw else 1.0

    return texts.map(ratio)


def flag_loops(texts: DataFrame) -> DataFrame:
    """texts with distinct4 and is_loop. Python sees only texts that the cheap tests leave open."""
    stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    measured = texts.withColumn("_s", stripped).withColumn("_t", T.words(F.col("_s")))
    measured = measured.withColumn("distinct4", T.distinct_ngram_ratio(F.col("_t"))).withColumn("_n", F.size("_t")).drop("_t", "text")
    settled = (F.col("_n") < LEAST_TOKENS) | (F.col("distinct4") < LEAST_DISTINCT)
    # one pass: a settled text goes to Python as null, which costs nothing there
    ratio = compression_ratio(F.when(~settled, F.col("_s")))
    return measured.withColumn("_r", ratio).withColumn("is_loop", F.when(settled, F.col("_n") >= LEAST_TOKENS).otherwise(F.col("_r") < LEAST_RATIO)).drop("_s", "_n", "_r")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    if not a or not b:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        hit = np.where(y == codes[w], row[:-1] + 1, 0)
        row[1:] = np.maximum(np.maximum.accumulate(hit), row[1:])
    return int(row[-1])


def lcs_f1(prediction: str | None, gold: str | None) -> float:
    p, g = (prediction or "").split(), (gold or "").split()
    n = lcs_length(p, g)
    return 2 * n / (len(p) + len(g)) if n else float(not p and not g)


@F.pandas_udf(DoubleType())
def _rouge(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_f1(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _best_rouge(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([max((lcs_f1(x, y) for y in ys), default=0.0) for x, ys in zip(a, b, strict=True)], dtype="float64")


def rouge_l(rows: DataFrame, prediction: str, gold: str) -> DataFrame:
    """rows with the LCS F1 of two normalised texts in column rouge_l; two empty ones score 1."""
    return rows.withColumn("rouge_l", _rouge(T.normalise(F.col(prediction)), T.normalise(F.col(gold))))


def best_rouge_l(rows: DataFrame, prediction: str, golds: str) -> DataFrame:
    """rows with the highest LCS F1 over an array of golds in column rouge_l; 0 without any."""
    return rows.withColumn("rouge_l", _best_rouge(T.normalise(F.col(prediction)), F.transform(F.coalesce(F.col(golds), F.array().cast("array<string>")), T.normalise)))


def spaced_rouge_l(rows: DataFrame, prediction: str, gold: str) -> DataFrame:
    """rows with the LCS F1 of two texts in which punctuation is a space and articles stay; an empty one scores 0."""
    spaced = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)[^\w\s]", " ")
    some = (F.size(T.words(spaced(prediction))) > 0) & (F.size(T.words(spaced(gold))) > 0)
    return rows.withColumn("rouge_l", F.when(some, _rouge(spaced(prediction), spaced(gold))).otherwise(0.0))

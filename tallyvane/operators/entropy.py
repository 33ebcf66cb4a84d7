"""Entropies of sampled answers: over clusters, over a kernel, and as a vote that may abstain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.operators.graph import connected_components


def cluster_entropy(samples: DataFrame, key: str, cluster: str) -> DataFrame:
    """key, n, clusters, entropy (bits) and h_norm (over the most that n samples can have, 0 for one) of each key's samples."""
    counts = samples.groupBy(key, cluster).agg(F.count("*").alias("_c"))
    # -sum p log p = log n - sum c log c / n
    sums = counts.groupBy(key).agg(F.sum("_c").alias("n"), F.count("*").alias("clusters"), F.sum(F.col("_c") * F.log2("_c")).alias("x"))
    entropy = F.greatest(F.lit(0.0), F.log2("n") - F.col("x") / F.col("n"))
    return sums.select(key, "n", "clusters", entropy.alias("entropy"), F.when(F.col("n") > 1, entropy / F.log2("n")).otherwise(0.0).alias("h_norm"))


def surface_cluster(text):
    """The key by which samples are the same on the surface: lower case, letters, digits and white space alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"^\s+|\s+\z", "")


def entailment_clusters(samples: DataFrame, links: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """samples (sample_id, ...) with cluster, the least sample that links (u, v, forward, backward) entailing both ways reach."""
    both = links.filter("forward and backward").select("u", "v")
    found = connected_components(both, write).select(F.col("node").alias("sample_id"), F.col("component").alias("found"))
    return samples.join(found, "sample_id", "left").withColumn("cluster", F.coalesce("found", "sample_id")).drop("found")


def vote(samples: DataFrame, key: str, cluster: str, order: str, limit: float) -> DataFrame:
    """key, entropy (nats), abstained, chosen: the first sample, by `order`, of the largest cluster, of equal ones that whose
    first sample comes first; null where the entropy reaches the limit."""
    counts = samples.groupBy(key, cluster).agg(F.count("*").alias("_c"), F.min(order).alias("first"))
    sums = counts.groupBy(key).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log("_c")).alias("x"), F.max_by("first", F.struct(F.col("_c"), -F.col("first"))).alias("mode"))
    entropy = F.greatest(F.lit(0.0), F.log("n") - F.col("x") / F.col("n"))
    return sums.select(key, entropy.alias("entropy"), (entropy >= limit).alias("abstained"), F.when(entropy < limit, F.col("mode")).alias("chosen"))


def kernel_entropy_of(kernel: np.ndarray) -> float:
    """Von Neumann entropy of a similarity kernel over the most that its size can have; 0 below two samples or without a trace."""
    m = len(kernel)
    trace = float(np.trace(kernel)) if m else 0.0
    if m < 2 or trace <= 1e-9:
        return 0.0
    values = np.clip(np.linalg.eigvalsh((kernel + kernel.T) / (2 * trace)), 1e-12, None)
    values /= values.sum()
    return float(np.clip(-(values * np.log(values)).sum() / np.log(m), 0.0, 1.0))


def kernel_entropy(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, kle: the kernel entropy of a key's vectors by their inner products held to [0, 1]. A key is one query with its few
    sampled chains: eigenvalues need all of them in one place."""

    def of(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_list())
        return pd.DataFrame({key: [part[key].iloc[0]], "kle": [kernel_entropy_of(np.clip(x @ x.T, 0.0, 1.0))]})

    known = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    return known.groupBy(key).applyInPandas(of, f"`{key}` long, kle double")

"""Temperature-mixed pools with a floor, a share cap and capped repetition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.operators.ranks import numbered
from tallyvane.operators.splits import seeded_key

FLOOR, SHARE_CAP, ROUNDS, REPEAT_CAP = 50, 0.40, 10, 3.0
#: Groups that a pool may be made of; their counts are worked on at the driver.
MAX_GROUPS = 10_000


def temperature_targets(counts: DataFrame, total: int, temperature: float) -> DataFrame:
    """counts (group, n) with a target in proportion to share^(1/T); T of 0 or less is uniform. One row a group."""
    everything = Window.partitionBy()
    if temperature <= 0:
        return counts.withColumn("target", F.floor(F.lit(total) / F.greatest(F.count("*").over(everything), F.lit(1))))
    share = F.pow(F.col("n") / F.sum("n").over(everything), F.lit(1.0 / temperature))
    return counts.withColumn("_w", share).withColumn("target", F.rint(total * F.col("_w") / F.sum("_w").over(everything)).cast("long")).drop("_w")


def capped_targets(targets: dict[str, int], counts: dict[str, int], total: int, floor: int = FLOOR, share_cap: float = SHARE_CAP) -> dict[str, int]:
    """Targets raised to the floor where a group has rows, then cut to the cap, the excess shared among those under it."""
    out = {g: max(t, floor) if counts.get(g, 0) > 0 else t for g, t in targets.items()}
    cap = max(1, int(total * share_cap))
    for _ in range(ROUNDS):
        excess = sum(t - cap for t in out.values() if t > cap)
        room = {g: t for g, t in out.items() if 0 < t < cap}
        out = {g: min(t, cap) for g, t in out.items()}
        if not excess or not room:
            break
        weight = sum(room.values())
        out |= {g: min(cap, t + round(excess * t / weight)) for g, t in room.items()}
    return out


def reweight(rows: DataFrame, group: str, key: str, total: int, temperature: float = 2.0, repeat_cap: float = REPEAT_CAP) -> DataFrame:
    """rows resampled to a pool of about `total`: each group's first rows in hash order, or up to ceil(repeat_cap) copies.

    Column copy_no numbers a row's copies from 1. Only the groups' counts reach the driver.
    """
    counted = temperature_targets(rows.groupBy(group).agg(F.count("*").alias("n")), total, temperature).limit(MAX_GROUPS + 1).collect()
    if len(counted) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    counts = {r[group]: r["n"] for r in counted}
    targets = capped_targets({r[group]: r["target"] for r in counted}, counts, total)
    per = {g: (min(t, math.ceil(repeat_cap) * counts[g]), counts[g]) for g, t in targets.items()}
    whole = F.create_map(*[F.lit(x) for g, (t, n) in per.items() for x in (g, t // n)]) if per else F.create_map()
    rest = F.create_map(*[F.lit(x) for g, (t, n) in per.items() for x in (g, t % n)]) if per else F.create_map()
    hashed = rows.withColumn("_hash", seeded_key(key))
    # the hash's first digits cut a group into even pieces
    ranked = numbered(hashed, [group], "_hash", key, piece=F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int"))
    copies = F.element_at(whole, F.col(group)) + F.when(F.col("rank") <= F.element_at(rest, F.col(group)), 1).otherwise(0)
    kept = ranked.withColumn("_copies", copies).filter("_copies > 0")
    return kept.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy_no"))

"""Sharding by fixed virtual slots: records hash into slots, and a versioned map says which shard holds each slot.

The map is a table (version, slot, shard, bytes, n_rows, first_row). A new version is an edit of the one before it: growing
moves slots only into the new shard, rebalancing moves slots from full shards to empty ones. Only the map changes; a
record's slot never does.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.llm.common import inline_rows, table
from tallyvane.sources.staging import Scratch

N_SLOTS = 8192
#: The map is kept on the driver while it is edited, and broadcast; this bounds it.
MAX_SLOTS = 1 << 16
#: What a record costs in a shard besides its text.
RECORD_BYTES = 16
MAP_SCHEMA = "version int, slot int, shard int, bytes bigint, n_rows bigint, first_row bigint"


def slot_of(key: Column, spare: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record: by its key, or by `spare` where the key is null, so that null keys spread."""
    return F.pmod(F.xxhash64(key, F.when(key.isNull(), spare)), F.lit(n_slots)).cast("int")


def first_map(loads: dict[int, tuple[int, int]], n_slots: int, n_shards: int) -> list[dict]:
    """Version 1: slots by falling bytes, each to the shard with the fewest bytes so far (ties: fewer rows, lower number)."""
    shards = [(0, 0, s) for s in range(n_shards)]
    heapq.heapify(shards)
    placed = {}
    for slot in sorted(range(n_slots), key=lambda k: (-loads.get(k, (0, 0))[0], k)):
        total, rows, shard = heapq.heappop(shards)
        b, n = loads.get(slot, (0, 0))
        placed[slot] = shard
        heapq.heappush(shards, (total + b, rows + n + (not n), shard))
    return _rows(1, placed, loads)


def rebalance(old: list[dict], loads: dict[int, tuple[int, int]], n_shards: int, slack: float = 0.01) -> list[dict]:
    """The next version: moves slots from the fullest to the emptiest shard while that narrows the gap by more than slack.

    Of the fullest shard's slots the one nearest half the gap goes; a shard without a slot that helps is left as it is. Heaps
    and sorted slots find each move without a look at all slots.
    """
    placed = {r["slot"]: r["shard"] for r in old}
    size = lambda slot: loads.get(slot, (0, 0))[0]
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, shard in placed.items():
        if size(slot):
            own[shard].append((size(slot), slot))
    for slots in own:
        slots.sort()
    totals = [sum(b for b, _ in slots) for slots in own]
    mean = sum(totals) / max(1, n_shards)
    full, empty = [(-t, s) for s, t in enumerate(totals)], [(t, s) for s, t in enumerate(totals)]
    heapq.heapify(full)
    heapq.heapify(empty)
    for _ in range(4 * len(placed)):
        while full and -full[0][0] != totals[full[0][1]]:
            heapq.heappop(full)
        while empty and empty[0][0] != totals[empty[0][1]]:
            heapq.heappop(empty)
        if not full or not empty:
            break
        (top, giver), (low, taker) = full[0], empty[0]
        gap = -top - low
        if gap <= slack * mean:
            break
        at = bisect.bisect_left(own[giver], (gap // 2, 0))
        near = [k for k in (at - 1, at) if 0 <= k < len(own[giver]) and own[giver][k][0] < gap]
        if not near:
            heapq.heappop(full)
            continue
        moved = own[giver].pop(min(near, key=lambda k: (abs(2 * own[giver][k][0] - gap), k)))
        bisect.insort(own[taker], moved)
        placed[moved[1]] = taker
        for shard, change in ((giver, -moved[0]), (taker, moved[0])):
            totals[shard] += change
            heapq.heappush(full, (-totals[shard], shard))
            heapq.heappush(empty, (totals[shard], shard))
    return _rows(old[0]["version"] + 1 if old else 1, placed, loads)


def grow(old: list[dict], loads: dict[int, tuple[int, int]], n_shards: int) -> list[dict]:
    """The next version for n_shards + 1 shards: slots move only into the new one, from the fullest shards, up to the mean."""
    placed = {r["slot"]: r["shard"] for r in old}
    own: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    totals = {s: 0 for s in range(n_shards)}
    for slot, shard in sorted(placed.items()):
        own[shard].append(slot)
        totals[shard] += loads.get(slot, (0, 0))[0]
    mean, new = sum(totals.values()) / (n_shards + 1), 0
    heap = [(-t, s) for s, t in totals.items()]
    heapq.heapify(heap)
    while heap and new < mean:
        _, shard = heapq.heappop(heap)
        fits = [k for k in own[shard] if 0 < loads.get(k, (0, 0))[0] <= mean - new]
        if not fits:
            continue
        slot = min(fits, key=lambda k: (loads[k][0], k))
        own[shard].remove(slot)
        placed[slot] = n_shards
        new += loads[slot][0]
        totals[shard] -= loads[slot][0]
        heapq.heappush(heap, (-totals[shard], shard))
    return _rows(old[0]["version"] + 1 if old else 1, placed, loads)


def _rows(version: int, placed: dict[int, int], loads: dict[int, tuple[int, int]]) -> list[dict]:
    """Map rows; first_row is where a slot's records begin in their shard."""
    at: dict[int, int] = {}
    out = []
    for slot, shard in sorted(placed.items()):
        b, n = loads.get(slot, (0, 0))
        out.append({"version": version, "slot": slot, "shard": shard, "bytes": b, "n_rows": n, "first_row": at.get(shard, 0)})
        at[shard] = at.get(shard, 0) + n
    return out


def store_map(spark: SparkSession, rows: list[dict], path: str) -> DataFrame:
    """Write one version of the map into the folder of its path; a version that is there already is an error."""
    inline_rows(spark, rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version-{rows[0]['version']}")
    return stored_map(spark, path, rows[0]["version"])


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version-{version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[dict]:
    """The rows of one stored version, at most MAX_SLOTS of them."""
    rows = [r.asDict() for r in stored_map(spark, path, version).limit(MAX_SLOTS + 1).collect()]
    if len(rows) > MAX_SLOTS or {r["version"] for r in rows} != {version}:
        raise ValueError("not one version of a map")
    return sorted(rows, key=lambda r: r["slot"])


def edit_map(spark: SparkSession, path: str, version: int, loads: dict[int, tuple[int, int]], n_shards: int, more: bool) -> DataFrame:
    """The version after a stored one, stored in turn: one more shard, or the same ones rebalanced, by the slots' loads now."""
    old = load_map(spark, path, version)
    return store_map(spark, grow(old, loads, n_shards) if more else rebalance(old, loads, n_shards), path)


def place(records: DataFrame, stored: DataFrame) -> DataFrame:
    """records (v_slot, ...) with the shard and version of a stored map."""
    return records.join(F.broadcast(stored.select(F.col("slot").alias("v_slot"), "shard", "version")), "v_slot")  # at most MAX_SLOTS rows


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most one row a slot comes to the driver."""
    return {r["v_slot"]: (r["b"], r["n"]) for r in records.groupBy("v_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Place each record of docs (doc_id, text) in a shard so that the shards' bytes are near equal.

    The map is stored in `path`, by default a folder of the job: version 1 by the slots' loads, and version 2, which is what
    records are placed by, from the stored version 1 by rebalancing.

    Returns doc_id, size, text_crc32, shard, position (in the shard, gapless from 0), v_slot, version. A null text counts no
    bytes but the record's own and has a null crc; a null doc_id is hashed by its text, or by its place without one; repeated rows are records of their
    own, next to each other; other columns are ignored; an empty table gives no rows. The text itself is read once and never
    shuffled: only (doc_id, size, crc, slot) is.
    """
    if not 0 < n_shards <= n_slots <= MAX_SLOTS:
        raise ValueError(f"need 0 < shards <= slots <= {MAX_SLOTS}")
    spark, text, scratch = docs.sparkSession, F.col("text"), scratch or Scratch(docs.sparkSession)
    records = scratch(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            # rows that have neither id nor text are alike: their place spreads them, fixed once they are staged
        ).withColumn("v_slot", slot_of(F.col("doc_id"), F.coalesce("text_crc32", F.monotonically_increasing_id()), n_slots)),
        "shard-records",
    )
    loads, path = slot_loads(records), path or f"{scratch.folder}/slot-map"
    store_map(spark, first_map(loads, n_slots, n_shards), path)
    mapped = edit_map(spark, path, 1, loads, n_shards, more=False)
    within = Window.partitionBy("v_slot").orderBy(F.col("doc_id"), F.col("size"), F.col("text_crc32"))
    return (
        records.withColumn("n_in_slot", F.row_number().over(within) - 1)
        .join(F.broadcast(mapped.select(F.col("slot").alias("v_slot"), "shard", "first_row", "version")), "v_slot")  # at most MAX_SLOTS rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_row") + F.col("n_in_slot")).alias("position"), "v_slot", "version")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "v_slot", "version",
    )

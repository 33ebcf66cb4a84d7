"""Exact top-k search with an impact-ordered, score-at-a-time index.

Vectors are cut into blocks of bounded size. A block's index holds, for each dimension, its rows by falling value, and the
quantised impact (a level of bounded count) of each. A query takes posting segments of all dimensions in the order of their
impact on its score, weight times level, down to a falling threshold. What a row may still gain is then at most the threshold
for each dimension in which it has not been met, so rows that cannot reach the k-th best drop out by proof. When few are
left, or no segment is, those are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.llm.common import join_bounded, table
from tallyvane.sources.staging import Scratch

SCALE = 256
K = 5
#: Rows in a block of the index, queries in a block, levels of quantised impact.
BLOCK_ROWS, BLOCK_QUERIES, LEVELS = 4096, 512, 64
#: Blocks of either kind that one task takes.
MEET_ROWS, MEET_QUERIES = 4, 8
#: Thresholds at which a query looks for proof, as shares of its largest impact.
STEPS = (0.1, 0.03, 0.0)
#: Share of a block that may be left for exact scores.
LEFT = 0.3
#: Counts a met dimension above the sum of impacts; both stay exact in a double up to these bounds, beyond which rows are scored outright.
MET, MOST_DIMS = float(1 << 40), 1 << 12


class ImpactIndex:
    """Posting segments of a block of integer vectors, shifted so that each value is an impact from 0 up."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.width = max(1, -(-int((self.high - self.low).max() + 1) // LEVELS))
        self.order = np.argsort(-values, axis=0, kind="stable").T.astype(np.int32)  # rows of each dimension by falling value
        by_value = np.take_along_axis(values, self.order.T, axis=0).T
        self.up = ((by_value - self.low[:, None]) // self.width).astype(np.uint8)  # levels for weights from 0 up, falling
        self.down = ((self.high[:, None] - by_value) // self.width)[:, ::-1].astype(np.uint8)  # for weights below 0, falling from the end
        self.order_down = self.order[:, ::-1].copy()
        rows = values.shape[0]
        # where each level ends, for all dimensions at once
        self.end_up = np.stack([(self.up >= level).sum(axis=1) for level in range(LEVELS + 1)], axis=1)
        self.end_down = np.stack([(self.down >= level).sum(axis=1) for level in range(LEVELS + 1)], axis=1)
        self.rows = rows

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of a superset of the block's rows that can be among the k best; `least` is a score known
        to be needed, from other blocks."""
        weight = np.abs(query)
        if len(query) > MOST_DIMS or float(weight.sum()) * float((self.high - self.low).max() + self.width) >= MET:
            other = self.ids != own
            return self.ids[other], self.values[other] @ query
        rising = query >= 0
        base = int(query @ np.where(rising, self.low, self.high))
        slack = int(weight.sum()) * (self.width - 1)
        most = (weight * np.where(rising, self.up[:, 0], self.down[:, 0])).max() * self.width
        total = np.zeros(self.rows)  # the impacts met, and MET for each of them: one pass counts both
        score, met = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        done = np.zeros(len(query), np.int64)
        dims = np.flatnonzero(weight)
        possible = np.arange(self.rows)
        for share in STEPS:
            threshold = int(most * share)
            # the least level of each dimension whose impact is above the threshold
            first = np.minimum(LEVELS, threshold // np.maximum(1, weight * self.width) + 1) if threshold else np.zeros(len(query), np.int64)
            rows, gains = [], []
            for d in dims.tolist():
                order, levels, ends = (self.order, self.up, self.end_up) if rising[d] else (self.order_down, self.down, self.end_down)
                end = int(ends[d, first[d]])
                if end > done[d]:
                    rows.append(order[d, done[d] : end])
                    gains.append(levels[d, done[d] : end] * float(weight[d] * self.width) + MET)
                    done[d] = end
            if rows:
                total += np.bincount(np.concatenate(rows), weights=np.concatenate(gains), minlength=self.rows)
                met, score = np.divmod(total.astype(np.int64), int(MET))
            known = score[self.ids != own]
            if len(known) > k:
                need = base + int(np.partition(known, len(known) - k)[-k])
                least = need if least is None else max(least, need)
            if least is not None:
                best = base + score + slack + threshold * (len(dims) - met)
                possible = np.flatnonzero(best >= least)
            if len(possible) <= max(4 * k, LEFT * self.rows):
                break
        possible = possible[self.ids[possible] != own]
        return self.ids[possible], self.values[possible] @ query


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _usable(vectors: DataFrame) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return kept.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))


def _packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, the width before them."""
    for width in (2, 4):
        if not values.size or np.abs(values).max() < 1 << (8 * width - 1):
            return bytes([width]) + values.astype(f"<i{width}").tobytes()
    return bytes([8]) + values.astype("<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _blocks(vectors: DataFrame, rows: int, scratch: Scratch, name: str) -> DataFrame:
    """(dims, block, ids, body): integer vectors of one length, about `rows` at a time, as packed bytes. A row is dealt by its
    content and its place, which was fixed when it was staged, so a task that is done again deals it to the same block."""
    sized = vectors.withColumn("dims", F.size("v"))
    counts = scratch(sized.groupBy("dims").agg(F.ceil(F.count("*") / rows).cast("long").alias("n_blocks")), f"{name}-counts")
    dealt = join_bounded(sized, counts, ["dims"], "inner", counts.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("place", "vec_id", "v"), F.col("n_blocks")))

    def pack(group: pa.Table) -> pa.Table:
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = np.floor(SCALE * flat).astype(np.int64)
        out = {"dims": [group.column("dims")[0].as_py()], "block": [group.column("block")[0].as_py()], "ids": [_packed(group.column("vec_id").to_numpy())], "body": [_packed(values)]}
        return pa.table(out, schema=pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("body", pa.binary())]))

    return scratch(dealt.select("dims", "block", "vec_id", "v").groupBy("dims", "block").applyInArrow(pack, "dims int, block long, ids binary, body binary"), name)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that is a query, the k highest integer
    inner products with other rows, ties to smaller vec_id.

    Components become floor(256 x). Rows whose id or vector is null, or whose vector is empty or holds null or non-finite
    components, take no part; vectors of different lengths are not compared; repeated rows are candidates of their own, but
    never those with the query's own id, and ask once; an id is expected to name one vector; other columns are ignored; an empty table gives no rows. Scores must fit a long.

    A task takes MEET_ROWS blocks of the index and MEET_QUERIES blocks of queries; each side is sent as often as the other has
    such groups, so neither is ever held whole anywhere and no key has more than one task's blocks.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    usable = scratch(_usable(vectors).withColumn("place", F.monotonically_increasing_id()), "vectors")
    index = _blocks(usable, BLOCK_ROWS, scratch, "index")
    asking = usable.filter(is_query).select("vec_id", "v", F.lit(0).cast("long").alias("place")).distinct()
    queries = _blocks(asking, BLOCK_QUERIES, scratch, "queries")
    scratch.drop("vectors")
    group = lambda size: F.floor(F.col("block") / size).cast("long")
    groups = lambda side, size, name: side.groupBy("dims").agg((F.max(group(size)) + 1).alias(name))
    counts = scratch(groups(index, MEET_ROWS, "n_r").join(groups(queries, MEET_QUERIES, "n_q"), "dims"), "groups")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    n_lengths = counts.count()
    left = join_bounded(index.withColumn("r", group(MEET_ROWS)), counts, ["dims"], "inner", n_lengths).withColumn("q", each("n_q"))
    right = join_bounded(queries.withColumn("q", group(MEET_QUERIES)), counts, ["dims"], "inner", n_lengths).withColumn("r", each("n_r"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wanted = [(_unpacked(i), _unpacked(b)) for i, b in zip(asked.column("ids").to_pylist(), asked.column("body").to_pylist(), strict=True)]
        for raw_ids, body in zip(rows.column("ids").to_pylist(), rows.column("body").to_pylist(), strict=True):
            ids = _unpacked(raw_ids)
            block = ImpactIndex(ids, _unpacked(body).reshape(len(ids), -1))
            for q, vector in ((q, v) for qs, vs in wanted for q, v in zip(qs.tolist(), vs.reshape(len(qs), -1), strict=True)):
                so_far = best.get(q)
                least = int(so_far[1][-1]) if so_far is not None and len(so_far[1]) == k else None
                found, scores = block.search(vector, q, k, least)
                if so_far is not None:
                    found, scores = np.concatenate([so_far[0], found]), np.concatenate([so_far[1], scores])
                best[q] = best_of(found, scores, k)
        lengths = [len(ids) for ids, _ in best.values()]
        flat = [np.concatenate([np.zeros(0, np.int64), *(x[side] for x in best.values())]) for side in (0, 1)]
        return pa.table([np.repeat(np.array(list(best), np.int64), lengths), *flat], schema=schema)

    left, right = (x.select("dims", "q", "r", "ids", "body").groupBy("dims", "q", "r") for x in (left, right))
    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

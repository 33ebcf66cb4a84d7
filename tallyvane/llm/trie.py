"""The trie of conversations' common beginnings, as a Cartesian tree over the array of their longest common prefixes.

Conversations are sequences of turn hashes. Sorted, each shares with the one before it a prefix of some length, its LCP. A
prefix that several share is an interval of the order in which no LCP is smaller than its depth, bounded by the nearest smaller
LCP on either side: the nodes of the Cartesian tree of the array, where nodes of equal LCP in one interval are one, and where
a node stands for all depths below its parent's. The order is cut into blocks. A block finds nearest smaller values within
itself by a stack; what its stack does not settle is bounded by the falling minima of the blocks after it (before it, on the
left), so a few rows of minima a block, with sums over what lies between them, are all that blocks must know of each other.
Sums, minima and counts of an interval are those of the stack's entries that it swallows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import WORD, inline_rows, table
from tallyvane.sources.staging import Scratch

#: Neighbouring ids that share a conversation's beginning, and how many first turns they may share.
FAMILY, MOST_SHARED = 20, 4
#: Bytes of a turn's hash.
WIDTH = 16
#: Turns that a block holds; it grows with the input so that there are at most MAX_BLOCKS, whose minima meet on the driver.
BLOCK_TURNS, MAX_BLOCKS = 200_000, 4096
#: Rows of nodes that a task gathers before it passes them on.
HELD = 20_000
#: The hash where no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, words): each conversation's turns after the rule of shared beginnings, as turn hashes (WIDTH bytes a turn)
    and numbers of words (little-endian 32-bit).

    The first h = crc32(conv_id) % MOST_SHARED turns come from conversation conv_id - conv_id % FAMILY, then its own after the
    first h. Only hashes and counts are shuffled, by family; a task holds the shared turns of one family and one conversation.
    """
    role, text, c = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id").cast("long")
    hashed = turns.filter("conv_id is not null").select(
        (c - c % FAMILY).alias("family"),
        c.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("hash"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int").alias("words"),
        (F.crc32(c.cast("string").cast("binary")) % MOST_SHARED).cast("int").alias("h"),
    )
    order = ["family", (F.col("conv_id") != F.col("family")).asc(), "conv_id", F.col("turn").asc_nulls_first(), "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, shared, own, conv = None, ([], []), ([], []), None

        def whole() -> list:
            key, words = (b"".join(x) for x in own)
            n, part = conv[1], shared if conv[0] != family else own
            head = [b"".join(x[:n]) for x in part]
            return [conv[0], head[0] + key[WIDTH * n :], head[1] + words[4 * n :]]

        def table_of(rows: list) -> pa.RecordBatch:
            ids, keys, words = (list(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(words, pa.binary())], names=["conv_id", "key", "words"])

        for batch in batches:
            out = []
            counts = batch.column("words").to_numpy().astype("<i4").tobytes()
            for i, (f, c, h, hashed) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("family", "conv_id", "h", "hash")), strict=True)):
                if conv is None or c != conv[0]:
                    if conv is not None:
                        out.append(whole())
                    if f != family:
                        family, shared = f, ([], [])
                    conv, own = (c, h), ([], [])
                own[0].append(hashed)
                own[1].append(counts[4 * i : 4 * i + 4])
                if c == f and len(shared[0]) < MOST_SHARED:
                    shared[0].append(hashed)
                    shared[1].append(own[1][-1])
            if out:
                yield table_of(out)
        if conv is not None:
            yield table_of([whole()])

    dealt = hashed.repartition("family").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, key binary, words binary")


def common_turns(a: bytes, b: bytes) -> int:
    """How many first turns two keys share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: WIDTH * high] == b[: WIDTH * high]:
        return high
    while low < high - 1:  # low turns are shared, high are not
        mid = (low + high) // 2
        if a[WIDTH * low : WIDTH * mid] == b[WIDTH * low : WIDTH * mid]:
            low = mid
        else:
            high = mid
    return low


def blocks_of(conversations: DataFrame, block_turns: int, parts: int) -> DataFrame:
    """The sorted order in blocks of about so many turns, a row each: conversations' ids and lengths, their LCPs, and the words
    of each one's first d turns for all d, one conversation after the other. The first LCP of a partition is -1 for now."""
    names = ["part", "seq", "n", "first_key", "last_key", "ids", "lens", "lcps", "words"]
    schema = "part int, seq int, n long, first_key binary, last_key binary, ids binary, lens binary, lcps binary, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, None
        ids: list[int] = []
        lens: list[int] = []
        lcps: list[int] = []
        words: list[bytes] = []
        first, turns = b"", 0

        def block() -> pa.RecordBatch:
            packed = [np.array(ids, "<i8").tobytes(), np.array(lens, "<i8").tobytes(), np.array(lcps, "<i8").tobytes(), b"".join(words)]
            values = [[part], [seq], [len(ids)], [first], [before], *([x] for x in packed)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], names=names)

        for batch in batches:
            for c, key, count in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "key", "words")), strict=True):
                if ids and turns >= block_turns:
                    yield block()
                    seq, turns = seq + 1, 0
                    for x in (ids, lens, lcps, words):
                        x.clear()
                if not ids:
                    first = key
                ids.append(c)
                lens.append(len(key) // WIDTH)
                lcps.append(-1 if before is None else common_turns(before, key))
                words.append(count)
                before, turns = key, turns + len(key) // WIDTH + 1
        if ids:
            yield block()

    dealt = conversations.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, schema)


class Block:
    """A block's arrays, with its first LCP as found across partitions, and the LCP that follows its last conversation."""

    def __init__(self, row: dict) -> None:
        self.ids, self.lens, self.lcps = (np.frombuffer(row[x], "<i8").copy() for x in ("ids", "lens", "lcps"))
        self.lcps[0], self.next_lcp, self.start = row["first_lcp"], row["next_lcp"], row["at"]
        words = np.frombuffer(row["words"], "<i4").astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lens)])
        total = np.concatenate([[0], np.cumsum(words)])
        self.total, self.offset = total, total[self.base[:-1]]
        # words of the turns that a conversation shares with the one before it
        self.shared = total[self.base[:-1] + np.maximum(self.lcps, 0)] - self.offset
        self.leaf = np.append(self.lcps[1:], self.next_lcp) < self.lens
        self.grows = self.lens > self.lcps

    def words_upto(self, i: int, depth: int) -> int:
        """Words of the first `depth` turns of conversation i."""
        return int(self.total[self.base[i] + depth] - self.offset[i]) if depth > 0 else 0


# Entries of the stack on the right: [place, LCP, children there, least id, leaves, shared words], the last three over the
# conversations from the place up to the next entry's. On the left: [place, LCP, least id].


def swallow(stack: list[list], entry: list) -> None:
    """Put an entry, nearer than all others, on the right stack: what has a larger LCP is part of it, what has the same is it."""
    while stack and stack[-1][1] >= entry[1]:
        far = stack.pop()
        entry[2] += far[2] if far[1] == entry[1] else 0
        entry[3] = min(entry[3], far[3])
        entry[4] += far[4]
        entry[5] += far[5]
        if far[1] == entry[1]:
            break
    stack.append(entry)


def settle(stack: list[list], entry: list, least: int | None = None) -> None:
    """Put an entry, further than all others, on the left stack: what has no smaller LCP belongs to the entry below."""
    while stack and stack[-1][1] >= entry[1]:
        gone = stack.pop()
        least = gone[2] if least is None else min(least, gone[2])
    if stack and least is not None:
        stack[-1][2] = min(stack[-1][2], least)
    stack.append(entry)


def minima(block: Block) -> tuple[list[list], list[list], int | None]:
    """What other blocks must know: the stacks that the block alone leaves on its right and left, and the least id of the
    conversations before the left one's first entry."""
    right: list[list] = []
    for i in range(len(block.ids) - 1, -1, -1):
        swallow(right, [block.start + i, int(block.lcps[i]), int(block.grows[i]), int(block.ids[i]), int(block.leaf[i]), int(block.shared[i])])
    left: list[list] = []
    before = None
    for i in range(len(block.ids)):
        lcp, least = int(block.lcps[i]), None
        while left and left[-1][1] >= lcp:
            least = min(left.pop()[2], least if least is not None else 1 << 63)
        if least is not None:
            if left:
                left[-1][2] = min(left[-1][2], least)
            else:
                before = least if before is None else min(before, least)
        left.append([block.start + i, lcp, int(block.ids[i])])
    return right, left, before


def contexts(found: list[tuple[list[list], list[list], int | None]], total: int) -> list[tuple[list[list], list[list]]]:
    """For each block in order, the right stack of all that follows it and the left stack of all before it."""
    rights: list[list[list]] = []
    stack = [[total, -1, 0, 1 << 62, 0, 0]]
    for right, _, _ in reversed(found):
        rights.append([x[:] for x in stack])
        for entry in right:
            swallow(stack, entry[:])
    out = []
    stack = []
    for (_, left, before), right in zip(found, reversed(rights), strict=True):
        out.append((right, [x[:] for x in stack]))
        for k, entry in enumerate(left):
            settle(stack, entry[:], before if k == 0 else None)
    return out


NODE = "kind int, at long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece long, body binary"


class Rows:
    """Rows of NODE by column."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in NODE.split(", ")]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [x.split() for x in NODE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(self.columns, fields, strict=True)], names=[n for n, _ in fields])


def runs_of(block: Block, left: list[list], next_same: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """(first place, depth, decimal ids, whole) of each run of equal conversations: those that end at one node, by id. A run
    that goes on in the next block, or came from the one before, is not whole."""
    same = block.lcps == block.lens
    same[1:] &= block.lens[1:] == block.lens[:-1]
    same[0] &= bool(left) and block.first_same
    starts = np.flatnonzero(~same).tolist()
    cuts = ([0] if same[0] else []) + starts + [len(block.ids)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        open_left, open_right = k == 0 and bool(same[0]), b == len(block.ids) and next_same
        at = block.start + a
        if open_left:  # the run began at the nearest conversation before that shares less with its own predecessor
            at = next(x[0] for x in reversed(left) if x[1] < block.lens[0])
        yield at, int(block.lens[a]), ",".join(map(str, block.ids[a:b].tolist())).encode(), not (open_left or open_right)


def nodes_of(block: Block, number: int, right: list[list], left: list[list], next_same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of all nodes whose interval begins in the block, and of the pieces of runs that cross its edges."""
    out = Rows()
    ends: dict[int, str | None] = {}
    for at, depth, body, whole in runs_of(block, left, next_same):
        if at >= block.start:
            ends[at] = hashlib.sha256(body).hexdigest() if whole else None
        if not whole:
            out.add(1, at, depth, None, None, None, None, None, None, None, number, body)
    # least id from the nearest smaller LCP on the left up to a conversation
    nearest: list[int | None] = []
    stack = [x[:] for x in left]
    for i in range(len(block.ids)):
        settle(stack, [block.start + i, int(block.lcps[i]), int(block.ids[i])])
        nearest.append(stack[-2][2] if len(stack) > 1 else None)
    stack = [x[:] for x in right]
    for i in range(len(block.ids) - 1, -1, -1):
        at, lcp, length = block.start + i, int(block.lcps[i]), int(block.lens[i])
        found: list[tuple] = []  # intervals that begin here, deepest first: depths, kids, end, least id, leaves, shared words
        low, leaves, shared, end = int(block.ids[i]), int(block.leaf[i]), 0, at
        if max(lcp, stack[-1][1]) < length:
            found.append((max(lcp, stack[-1][1]), length, 0, end, low, leaves, shared))
        while stack[-1][1] > lcp:
            entry = stack.pop()
            low, leaves, shared, end = min(low, entry[3]), leaves + entry[4], shared + entry[5], stack[-1][0] - 1
            found.append((max(lcp, stack[-1][1]), entry[1], entry[2] + (length > entry[1]), end, low, leaves, shared))
        swallow(stack, [at, lcp, int(length > lcp), low, leaves, shared + int(block.shared[i])])
        above = None if nearest[i] is None else min(nearest[i], stack[-1][3])
        for k, (top, bottom, kids, end, low, leaves, shared) in enumerate(found):
            parent = found[k + 1][4] if k + 1 < len(found) else above
            for depth in range(top + 1, bottom + 1):
                own = ends.get(at, NO_ENDS) if depth == length else NO_ENDS
                saved = shared - (end - at) * block.words_upto(i, depth - 1)
                out.add(0, at, depth, low, parent if depth == top + 1 else low, end - at + 1, kids if depth == bottom else 1, leaves, saved, own, None, None)
                if len(out.columns[0]) >= HELD:
                    yield out.batch()
                    out = Rows()
    yield out.batch()


def prefix_trie(turns: DataFrame, block_turns: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct beginning of
    the rebuilt conversations of turns (conv_id, turn, role, text).

    A null turn comes first; turns of one number are ordered by a hash of role and text; a null role or text is empty; rows
    without conv_id are left out; repeated rows are turns of their own; other columns are ignored; an empty table has no
    conversation and gives no rows, not even a root. Turns are compared by hashes of 128 bits. One conversation's hashes, 20
    bytes a turn, must fit into a task; a group of equal conversations need not: their order is cut by id, and the hash of
    their ids is taken as they stream by.
    """
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark)
    conversations = scratch(rebuilt(turns), "conversations")
    size = conversations.agg(F.sum(F.octet_length("key") / WIDTH + 1).cast("long")).first()[0] or 0
    if not size:
        return scratch(spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in NODE.split(", ")))), "nodes").select(*COLUMNS)
    block_turns = max(block_turns or BLOCK_TURNS, -(-size // MAX_BLOCKS))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BLOCKS)
    blocks = scratch(blocks_of(conversations, block_turns, parts), "blocks", compression="zstd")
    scratch.drop("conversations")
    numbers, at = [], 0
    for number, r in enumerate(sorted(blocks.select("part", "seq", "n").collect())):  # a row a block
        numbers.append({"part": r["part"], "seq": r["seq"], "block": number, "at": at})
        at += r["n"]
    numbered = blocks.join(F.broadcast(inline_rows(spark, numbers, "part int, seq int, block bigint, at bigint")), ["part", "seq"])

    def edges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pairs = list(zip(batch.column("last_key").to_pylist(), batch.column("first_key").to_pylist(), strict=True))
            found = [pa.array([common_turns(a, b) for a, b in pairs], pa.int64()), pa.array([a == b for a, b in pairs], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("block"), *found], names=["block", "lcp", "same"])

    follows = numbered.select("block", "first_key").join(numbered.select((F.col("block") + 1).alias("block"), "last_key"), "block")
    edge = {r["block"]: (r["lcp"], r["same"]) for r in follows.mapInArrow(edges, "block long, lcp long, same boolean").collect()}  # a row a block
    end = (-1, False)
    facts = [x | {"first_lcp": edge.get(x["block"], end)[0], "first_same": edge.get(x["block"], end)[1], "next_lcp": edge.get(x["block"] + 1, end)[0], "next_same": edge.get(x["block"] + 1, end)[1]} for x in numbers]
    schema = "part int, seq int, block bigint, at bigint, first_lcp bigint, first_same boolean, next_lcp bigint, next_same boolean"
    known = blocks.drop("first_key", "last_key").join(F.broadcast(inline_rows(spark, facts, schema)), ["part", "seq"])

    def opened(row: dict) -> Block:
        block = Block(row)
        block.first_same = row["first_same"]
        return block

    def summary(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in rows for r in batch.to_pylist()):
            right, left, before = minima(opened(row))
            arrays = [pa.array([row["block"]]), pa.array([right], pa.list_(pa.list_(pa.int64()))), pa.array([left], pa.list_(pa.list_(pa.int64()))), pa.array([before], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "right", "left", "before"])

    stacks = known.mapInArrow(summary, "block long, right array<array<long>>, left array<array<long>>, before long").collect()  # a stack has an entry a depth at most
    found = [([list(x) for x in r["right"]], [list(x) for x in r["left"]], r["before"]) for r in sorted(stacks, key=lambda r: r["block"])]
    around = dict(enumerate(contexts(found, at)))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in rows for r in batch.to_pylist()):
            yield from nodes_of(opened(row), row["block"], *around[row["block"]], row["next_same"])

    nodes = scratch(known.mapInArrow(make, NODE), "nodes")

    def hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, found = None, None, ([], [])
        for batch in rows:
            for at, body in zip(batch.column("at").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if at != place:
                    if state is not None:
                        found[0].append(place)
                        found[1].append(state.hexdigest())
                    place, state = at, hashlib.sha256(body)
                else:
                    state.update(b"," + body)
        if state is not None:
            found[0].append(place)
            found[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string())], names=["at", "sha"])

    # runs that cross blocks: their pieces, at most two a block, stream through one hash in order
    crossing = nodes.filter("kind = 1").select("at", "piece", "body").repartition("at").sortWithinPartitions("at", "piece").mapInArrow(hashes, "at long, sha string")
    hashed = nodes.filter("kind = 0").join(crossing, "at", "left")
    return hashed.withColumn("ends_sha256", F.coalesce("ends_sha256", "sha")).select(*COLUMNS)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every common beginning of the conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH tab AS (
    SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(b))
), ids AS (
    SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS family,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h
    FROM ids, tab
), t AS (
    SELECT conv_id, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM (
        SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)
), r AS (
    SELECT c.conv_id, 0 AS part, t.i, t.k, t.w FROM c JOIN t ON t.conv_id = c.family AND t.i <= c.h
    UNION ALL SELECT c.conv_id, 1, t.i, t.k, t.w FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), s AS (
    SELECT c.conv_id, coalesce(list(r.k ORDER BY part, i) FILTER (r.k IS NOT NULL), []) AS ks, coalesce(list(r.w ORDER BY part, i) FILTER (r.k IS NOT NULL), []) AS ws
    FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (
    SELECT conv_id, d, len(ks) AS n, array_to_string(ks[1:d], '/') AS path, CASE WHEN d > 0 THEN array_to_string(ks[1 : d - 1], '/') END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, ks
    FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)
), nodes AS (
    SELECT d AS depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, any_value(ks) AS ks,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM m GROUP BY d, path
), kids AS (
    SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
    SELECT k AS depth, array_to_string(ks[1:k], '/') AS path, sum(saved)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves
    FROM (SELECT n.*, kids.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS k FROM nodes n LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.parent LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path JOIN below b ON b.depth = n.depth AND b.path = n.path
"""

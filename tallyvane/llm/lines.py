"""Deduplication of lines with levelled sorted runs of their hashes.

Documents go in by batches, newest first. A batch becomes a run, an immutable table of its lines' hashes in sorted buckets,
with the number of documents of each. It is merge-anti-joined with the runs before it: a line that none of them has is new,
and its newest document in the batch keeps it. Whenever a level has FAN runs they are merged into one of the next level, so a
batch meets few runs, and most of them in large ones. Lines that enough documents have go from all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import table
from tallyvane.sources.staging import Scratch

#: Code points that a line must have to be dropped, and documents that must have it.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches in which the query takes the documents, and runs of a level that become one of the next.
BATCHES, FAN = 4, 2
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A line's hash, of 128 bits.
KEY = ["a", "b"]


def line_keys(body: bytes | None, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """The hash of each line of a text, as 16 bytes; None for lines too short to be dropped."""
    out: list[bytes | None] = []
    for line in (body or b"").split(b"\n"):
        key = line.strip(SPACE).lower()  # of bytes: A-Z alone
        # a code point has at most four bytes
        long = len(key) >= 4 * least_chars or (len(key) >= least_chars and len(key.decode()) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _body(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, a, b): the distinct hashes of each text's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({k for k in line_keys(x, least_chars) if k}) for x in batch.column("body").to_pylist()]
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
            both = np.frombuffer(b"".join(k for x in found for k in x), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", *KEY])

    return _body(docs.filter("doc_id is not null")).mapInArrow(run, "doc_id long, a long, b long")


class LineIndex:
    """Levels of sorted runs (a, b, n_docs, newest) in the shared folder, and the documents that keep each line."""

    def __init__(self, scratch: Scratch, fan: int = FAN) -> None:
        if fan < 2:
            raise ValueError("a level needs two runs at least to be merged")
        self.scratch, self.fan = scratch, fan
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.keepers: list[DataFrame] = []
        self.n_runs = 0

    @property
    def runs(self) -> list[DataFrame]:
        """All runs, the largest first."""
        return [run for level in reversed(self.levels) for _, run in level]

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        self.n_runs += 1
        name = f"run-{self.n_runs}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, self.scratch.bucketed(rows, name, KEY)))
        return self.levels[level][-1][1]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of lines (doc_id, a, b), documents older than all before; returns (a, b, newest) of new lines."""
        older = self.runs
        run = self._write(lines.groupBy(*KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("newest")), 0)
        fresh = reduce(lambda rows, old: rows.join(old.select(*KEY).hint("merge"), KEY, "left_anti"), older, run.select(*KEY, "newest"))
        # the first run may be merged away, so what it keeps is a table of its own too
        self.keepers.append(self.scratch.bucketed(fresh, f"keepers-{len(self.keepers)}", KEY))
        self._compact()
        return self.keepers[-1]

    def _compact(self) -> None:
        """Merge the runs of each full level into one of the next; the merged ones are removed."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fan:
                self._write(merged([run for _, run in full]), level + 1)
                self.levels[level] = []
                self.scratch.drop(*(name for name, _ in full))
            level += 1


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of the lines of all: a merge join of two sorted ones at a time."""

    def two(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right.select(*KEY, F.col("n_docs").alias("more"), F.col("newest").alias("other")).hint("merge"), KEY, "full")
        sums = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return both.select(*KEY, sums.alias("n_docs"), F.greatest("newest", "other").alias("newest"))

    return reduce(two, runs)


def without_lines(docs: DataFrame, wanted: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (UTF-8): docs without the lines whose hashes are in `wanted` (doc_id, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for body, keys in zip(batch.column("body").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                body = body or b""
                n, kept = body.count(b"\n") + 1, body
                left = n
                if keys:
                    gone = {np.array([k["a"], k["b"]], "<i8").tobytes() for k in keys}
                    lines = [line for line, key in zip(body.split(b"\n"), line_keys(body, least_chars), strict=True) if key not in gone]
                    left, kept = len(lines), b"\n".join(lines)
                for column, value in zip(out, (n, n - left, kept), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "kept"])

    named = _body(docs.filter("doc_id is not null")).join(wanted, "doc_id", "left")
    unnamed = _body(docs.filter("doc_id is null")).withColumn("keys", F.lit(None).cast(wanted.schema["keys"].dataType))
    return named.select("doc_id", "body", "keys").union(unnamed).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")


def dedupe_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for each row of docs (doc_id, text): lines of at least `least_chars` code points,
    compared without white space at their ends and case of A-Z, that at least `least_docs` documents have are dropped but in
    the document of largest id.

    A null or empty text is one empty line. A null doc_id names no document: such a text counts for none and keeps its lines.
    Rows of one doc_id are one document, each cut for itself; a line repeated within a document counts once and stays or goes
    as a whole; other columns are ignored; an empty table gives no rows. Lines are compared by hashes of 128 bits.

    Texts are read twice and shuffled once, to meet the hashes that go; lines themselves are never shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = scratch or Scratch(docs.sparkSession)
    lines = scratch(lines_of(docs, least_chars), "lines")
    points = [k / batches for k in range(1, batches)]
    edges = sorted(set(docs.agg(F.percentile_approx("doc_id", points, 1000)).first()[0] or [])) if points else []
    index = LineIndex(scratch, fan)
    for low, high in reversed(list(zip([None, *edges], [*edges, None], strict=True))):
        part = lines
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        index.add(part)
    often = scratch.bucketed(merged(index.runs).filter(F.col("n_docs") >= least_docs).select(*KEY), "often", KEY)
    going = reduce(DataFrame.unionByName, (often.join(kept.hint("merge"), KEY) for kept in index.keepers))
    # staged plainly, so that Spark can split the join where one line is very common
    drops = scratch(going, "drops")
    wanted = lines.join(drops, KEY).filter(F.col("doc_id") < F.col("newest")).groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))
    return without_lines(docs, wanted, least_chars)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more have, but the newest."""
    left = dedupe_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT n, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT n, doc_id, unnest(t) AS line, unnest(range(len(t))) AS i FROM (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))
), drops AS (
    SELECT key, max(doc_id) AS newest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT l.*, coalesce(l.doc_id < d.newest, false) AS gone FROM lines l LEFT JOIN drops d ON d.key = l.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY n
"""

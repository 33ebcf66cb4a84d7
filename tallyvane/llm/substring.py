"""Incremental deduplication of repeated passages with a log-structured fingerprint index.

Each window of WINDOW words has a fingerprint: the least hash of its GRAM-word n-grams. Neighbouring windows mostly share
one, so a document has few, and equal windows always have equal ones. The index is a list of immutable runs, each in buckets
sorted by fingerprint. A batch of documents becomes a new run and is merge-joined with the older ones as they lie; only windows whose fingerprint is found in another document are looked at again, in the texts, and compared by a second hash of
all their words. When there are too many runs they are merged into one.
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

WINDOW, GRAM = 50, 16
#: Runs that an index may have before they are merged.
MAX_RUNS = 4
#: Batches in which the query takes the documents, in order of their ids: the third meets what the first two were merged into.
BATCHES = 3


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and hash of the window that starts at each word; hashes of 1, 2, 4, ... words are made by doubling."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    power = {1: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))}
    for size in (1, 2, 4, 8, 16):
        h = power[size]
        power[2 * size] = _mix(h[:-size], h[size:])
    # 50 = 32 + 16 + 2
    whole = _mix(_mix(power[32][:n], power[16][32 : 32 + n]), power[2][48 : 48 + n])
    least = power[GRAM]
    reach = 1
    while 2 * reach <= WINDOW - GRAM + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = WINDOW - GRAM + 1 - reach
    return np.minimum(least[:n], least[rest : rest + n]), whole


def _body(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))


def _slices(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, doc_id): the distinct fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _slices(b)):
            found = [np.unique(window_hashes((x or b"").split())[0]) for x in part.column("body").to_pylist()]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            fps = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(np.repeat(ids, [len(x) for x in found]), pa.int64())], names=["fp", "doc_id"])

    return _body(docs.filter("doc_id is not null")).mapInArrow(run, "fp long, doc_id long")


class FingerprintIndex:
    """Immutable runs (fp, lo, hi) in sorted buckets: the least and largest document of each fingerprint, so that a fingerprint
    that very many documents have is one row of a run; and, beside them, the documents of all fingerprints as they came."""

    def __init__(self, scratch: Scratch, max_runs: int = MAX_RUNS) -> None:
        self.scratch, self.max_runs = scratch, max_runs
        self.runs: list[tuple[str, DataFrame]] = []
        self.postings: list[DataFrame] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> DataFrame:
        self.written += 1
        name = f"run-{self.written}"
        self.runs.append((name, self.scratch.bucketed(rows, name, ["fp"])))
        return self.runs[-1][1]

    def append(self, rows: DataFrame) -> DataFrame:
        """Write a new run of rows (fp, doc_id)."""
        self.postings.append(self.scratch(rows, f"postings-{len(self.postings)}"))
        return self._write(self.postings[-1].groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))

    @staticmethod
    def merged(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Two runs by a merge join of their buckets, which are neither shuffled nor sorted again."""
        both = left.join(right.select("fp", F.col("lo").alias("lo_"), F.col("hi").alias("hi_")).hint("merge"), "fp", how)
        return both.select("fp", F.least("lo", "lo_").alias("lo"), F.greatest("hi", "hi_").alias("hi"))

    def shared_with(self, batch: DataFrame) -> DataFrame:
        """(fp, doc_id) of all documents for the fingerprints of the last run, that of a batch, that more than one document has."""
        older = [run for _, run in self.runs[:-1]]
        spread = reduce(lambda rows, old: self.merged(rows, old, "left"), older, batch).filter("lo < hi").select("fp")
        # staged, so that the join can be split where one fingerprint is very common
        return reduce(DataFrame.union, self.postings).join(self.scratch(spread, "spread"), "fp", "left_semi")

    def compact(self) -> None:
        """Merge all runs into one when there are too many; those it replaces are removed."""
        if len(self.runs) > self.max_runs:
            old, self.runs = self.runs, []
            self._write(reduce(lambda a, b: self.merged(a, b, "full"), (run for _, run in old)))
            self.scratch.drop(*(name for name, _ in old))


def _stretches(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(fp, rs, doc_id, pos, n, hashes): stretches of windows of one shared fingerprint; rs is a hash of the whole stretch."""
    wanted = shared.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))  # a document's own fingerprints, far fewer than its words
    schema = "fp long, rs long, doc_id long, pos long, n long, hashes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _slices(b)):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, body, fps in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "fps")), strict=True):
                fp, whole = window_hashes((body or b"").split())
                if not len(fp):
                    continue
                cuts = np.flatnonzero(np.diff(fp)) + 1
                begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
                keep = np.isin(fp[begin].view(np.int64), np.array(fps, np.int64))
                for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True):
                    raw = whole[a:b].tobytes()
                    for column, value in zip(out, (int(fp[a].view(np.int64)), xxhash.xxh3_64_intdigest(raw) - (1 << 63), doc_id, a, b - a, raw), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return _body(docs).join(wanted, "doc_id").select("doc_id", "body", "fps").mapInArrow(run, schema)


def _windows(stretches: DataFrame) -> DataFrame:
    """(fp, hash, doc_id, pos) of each window of some stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _slices(b, 4096)):
            hashes = [np.frombuffer(x, np.int64) for x in part.column("hashes").to_pylist()]
            n = np.array([len(x) for x in hashes], dtype=np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *hashes])
            fp, doc_id, pos = (np.repeat(part.column(c).to_numpy(), n) for c in ("fp", "doc_id", "pos"))
            pos = pos + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, flat, doc_id, pos)], names=["fp", "hash", "doc_id", "pos"])

    return stretches.mapInArrow(run, "fp long, hash long, doc_id long, pos long")


def repeated_windows(docs: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, pos, n): n windows from pos on that also start in a document of smaller id.

    A whole stretch seen in a smaller document is settled at once. Only the first document of each distinct stretch goes on
    to be compared window by window, with the other distinct ones. Either step takes the least document of a group by partial
    aggregates and joins it back, so that no group of equal passages is bound to one task.
    """
    stretches = scratch(_stretches(docs, shared), "stretches", compression="zstd")
    firsts = scratch(stretches.groupBy("fp", "rs").agg(F.min("doc_id").alias("first_doc")), "first-stretches")
    again = stretches.select("fp", "rs", "doc_id", "pos", "n").join(firsts, ["fp", "rs"]).filter("first_doc < doc_id").select("doc_id", "pos", "n")
    distinct = stretches.join(firsts.withColumnRenamed("first_doc", "doc_id"), ["fp", "rs", "doc_id"], "left_semi")
    windows = scratch(_windows(distinct.select("fp", "doc_id", "pos", "hashes")), "windows", compression="zstd")
    least = scratch(windows.groupBy("fp", "hash").agg(F.min("doc_id").alias("first_doc")), "first-windows")
    single = windows.join(least, ["fp", "hash"]).filter("first_doc < doc_id").select("doc_id", "pos", F.lit(1).cast("long").alias("n"))
    return again.union(single)


def cut(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of docs, given their repeated windows."""
    spans = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))  # at most a span a word of one document
    schema = "doc_id long, n_words long, n_removed long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _slices(b)):
            out: list[list] = [[], [], []]
            for body, found in zip(part.column("body").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = (body or b"").split()
                kept = words
                if found:
                    steps = np.zeros(len(words) + 1, np.int64)
                    pos, n = np.array([x["pos"] for x in found]), np.array([x["n"] for x in found])
                    np.add.at(steps, pos, 1)
                    np.add.at(steps, pos + n + WINDOW - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _body(docs).join(spans, "doc_id", "left").select("doc_id", "body", "spans").mapInArrow(run, schema)


def ingest(index: FingerprintIndex, history: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch of documents to the index and return the batch's doc_id, n_words, n_removed and kept.

    history holds the texts of the documents already in the index; only those that share a fingerprint with the batch are
    read. Ids of the batch are expected to be larger than those of the history, as with ids given in order of arrival:
    documents once returned are not judged again. What the batch alone needed is removed when it is done.
    """
    scratch = index.scratch
    run = index.append(fingerprints(batch))
    shared = scratch(index.shared_with(run), "shared")
    scratch.drop("spread")
    repeated = repeated_windows(history.select("doc_id", "text").union(batch.select("doc_id", "text")), shared, scratch)
    found = scratch(repeated, f"repeated-{len(index.postings)}")
    scratch.drop("shared", "stretches", "first-stretches", "windows", "first-windows")
    index.compact()
    return cut(batch, found)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept for each row of docs (doc_id, text): words in windows that also start in a document
    of smaller id are removed; windows are judged on the texts as given.

    A null or empty text has no words; a null doc_id is neither smaller nor larger than others, so its text is left alone; a
    doc_id is expected to name one text, and repeated rows of it are not each other's sources; other columns are ignored;
    an empty table gives no rows. The documents go in as `batches` batches in order of their ids, and the index is compacted
    whenever it has more than max_runs runs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    points = [k / batches for k in range(1, batches)]
    edges = docs.agg(F.percentile_approx("doc_id", points, 1000)).first()[0] if points else []
    edges = sorted(set(edges or []))
    index, out = FingerprintIndex(scratch or Scratch(docs.sparkSession), max_runs), []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs
        history = docs.limit(0) if low is None else docs.filter(F.col("doc_id") <= low)
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        elif low is None:
            part = part.filter("doc_id is not null")
        out.append(ingest(index, history, part))
    nothing = docs.limit(0).select("doc_id", F.lit(0).alias("pos"), F.lit(0).alias("n"))
    return reduce(DataFrame.union, [*out, cut(docs.filter("doc_id is null"), nothing)])


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when passages of 50 words repeated from smaller ids are removed."""
    left = remove_repeats(table(spark, sf_dir, "documents"), max_runs=1)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

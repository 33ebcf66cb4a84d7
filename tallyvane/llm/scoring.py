"""Stupid-backoff language-model scores: n-gram counts over all documents in tables partitioned by hash, joined to the
documents' own n-grams and summed per document.

A document is scored by what the others say: its own counts are taken off first. A word scores the count of the n-gram that
it ends, of the model's order, over that of the n-gram without it; where no other document has that n-gram, BACKOFF times its
score by the next shorter one, down to the word's share of all words; a word that no other document has counts as one.

Rows of n-grams would be many times the text. So documents are taken in blocks of bounded size: a block sends each partition
of the count table its distinct n-grams once, sorted and packed, and gets back only the counts that other blocks add to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import table
from tallyvane.sources.staging import Scratch

BACKOFF = 0.4
#: Longest n-gram.
ORDER = 2
#: Words in a block, n-grams in a partition of the count table.
BLOCK_WORDS, TABLE_GRAMS = 500_000, 1_000_000


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x2545F4914F6CDD1D))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(28))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x.tobytes() for x in arrays), 1)


class Block:
    """The documents of a block: ids, lengths, words as numbers of a vocabulary of hashes."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray, words: np.ndarray) -> None:
        self.ids, self.known, self.lengths, self.vocabulary, self.words = ids, known, lengths, vocabulary, words

    @classmethod
    def of(cls, ids: list[int | None], texts: list[list[int]]) -> Block:
        lengths = np.array([len(x) for x in texts], np.int64)
        hashes = np.fromiter((h for x in texts for h in x), np.uint64, int(lengths.sum()))
        vocabulary, words = np.unique(hashes, return_inverse=True)
        known = np.array([x is not None for x in ids], np.int8)
        return cls(np.array([x or 0 for x in ids], np.int64), known, lengths, vocabulary, words.astype(np.int32))

    def dump(self) -> bytes:
        sizes = np.array([len(self.ids), len(self.vocabulary)], np.int64)
        return _pack(sizes, self.ids, self.lengths, self.vocabulary, self.words, self.known)

    @classmethod
    def load(cls, raw: bytes) -> Block:
        data = zstandard.decompress(raw)
        n, v = np.frombuffer(data, np.int64, 2).tolist()
        at = 16
        ids = np.frombuffer(data, np.int64, n, at)
        lengths = np.frombuffer(data, np.int64, n, at + 8 * n)
        vocabulary = np.frombuffer(data, np.uint64, v, at + 16 * n)
        total = int(lengths.sum())
        words = np.frombuffer(data, np.int32, total, at + 16 * n + 8 * v)
        return cls(ids, np.frombuffer(data, np.int8, n, at + 16 * n + 8 * v + 4 * total), lengths, vocabulary, words)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sorted distinct hashes of all n-grams up to an order, their counts here, and for each n each word's place for the
        n-gram that it ends (-1 where its document has too few words before it)."""
        n = len(self.words)
        place = np.arange(n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        raw = self.vocabulary[self.words]
        hashes, ends, whole = [_mix(self.vocabulary, np.uint64(1))[self.words]], [np.arange(n)], raw
        for k in range(2, order + 1):
            longer = np.zeros(n, np.uint64)
            longer[1:] = _mix(whole[:-1], raw[1:])
            whole = longer
            at = np.flatnonzero(place >= k - 1)
            hashes.append(whole[at])
            ends.append(at)
        every, where, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        places, begin = [], 0
        for at in ends:
            own = np.full(n, -1, np.int64)
            own[at] = where[begin : begin + len(at)]
            places.append(own)
            begin += len(at)
        return every, counts, places


def partition_of(grams: np.ndarray, n_tables: int) -> np.ndarray:
    """Partition of the count table, rising with the hash."""
    return ((grams >> np.uint64(32)) * np.uint64(n_tables)) >> np.uint64(32)


def _blocks(docs: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(block, n_words, n_grams, body)."""

    def row(number: int, ids: list, texts: list) -> pa.RecordBatch:
        block = Block.of(ids, texts)
        values = [[number], [int(block.lengths.sum())], [len(block.grams(order)[0])], [block.dump()]]
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in values[:3]), pa.array(values[3], pa.binary())], names=["block", "n_words", "n_grams", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append([xxhash.xxh3_64_intdigest(w) for w in (body or b"").lower().split()])
                size += len(texts[-1]) + 1
                if size >= BLOCK_WORDS:
                    yield row(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row(number, ids, texts)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))
    return scratch(whole.mapInArrow(run, "block long, n_words long, n_grams long, body binary"), "lm-blocks")


def _requests(blocks: DataFrame, n_tables: int, order: int) -> DataFrame:
    """(part, block, grams, counts): a block's sorted distinct n-grams of one partition, as differences of `width` bytes."""
    schema = "part long, block long, grams binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                grams, counts, _ = Block.load(body).grams(order)
                cuts = np.searchsorted(partition_of(grams, n_tables), np.arange(n_tables + 1, dtype=np.uint64)).tolist()
                parts = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()),
                        pa.array([pack_sorted(grams[a:b]) for _, a, b in parts], pa.binary()), pa.array([_pack(counts[a:b].astype(np.int64)) for _, a, b in parts], pa.binary()),
                    ],
                    names=["part", "block", "grams", "counts"],
                )

    return blocks.select("block", "body").mapInArrow(run, schema)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as a first one and differences of as few bytes as the largest needs."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width] if len(steps) else np.zeros((0, 1), np.uint8)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + body.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    steps = steps.view("<u8").reshape(-1)
    steps[0] = np.frombuffer(raw, "<u8", 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _answers(requests: DataFrame) -> DataFrame:
    """(block, part, at, totals): for each block, the places of the n-grams that other blocks have too, and their counts."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("at", pa.binary()), ("totals", pa.binary())])

    def count(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        grams = [unpack_sorted(x) for x in group.column("grams").to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(x), np.int64) for x in group.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        out: list[list] = [[], [], [], []]
        ends = np.cumsum([len(g) for g in grams])
        for block, own, end in zip(blocks, counts, ends.tolist(), strict=True):
            every = totals[place[end - len(own) : end]]
            more = np.flatnonzero(every != own)
            if len(more):
                for column, value in zip(out, (block, group.column("part")[0].as_py(), _pack(np.diff(more, prepend=0).astype(np.int32)), _pack(every[more])), strict=True):
                    column.append(value)
        return pa.table(dict(zip(schema.names, out, strict=True)), schema=schema)

    return requests.groupBy("part").applyInArrow(count, "block long, part long, at binary, totals binary")


def score_block(block: Block, totals: np.ndarray, n_all: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Log scores summed per document, and how many of its words had to back off, given the counts of the block's n-grams."""
    _, _, places = block.grams(order)
    doc = np.repeat(np.arange(len(block.lengths)), block.lengths)

    def others(place: np.ndarray) -> np.ndarray:
        """Counts of n-grams without what each position's own document has; 0 where there is none."""
        out, at = np.zeros(len(place), np.int64), np.flatnonzero(place >= 0)
        _, which, own = np.unique(doc[at] * len(totals) + place[at], return_inverse=True, return_counts=True)
        out[at] = totals[place[at]] - own[which]
        return out

    shorter = others(places[0])
    rest = np.maximum(1, n_all - block.lengths)[doc]
    score = np.log(np.maximum(shorter, 1)) - np.log(rest)
    seen = np.zeros(len(doc), bool)
    for k in range(1, order):
        longer = others(places[k])
        before = np.concatenate([[0], shorter[:-1]])  # of the n-gram that ends a word earlier
        seen = longer > 0
        score = np.where(seen, np.log(np.maximum(longer, 1)) - np.log(np.maximum(before, 1)), np.log(BACKOFF) + score)
        shorter = longer
    n = len(block.lengths)
    return np.bincount(doc, weights=score, minlength=n), np.bincount(doc, weights=~seen, minlength=n).astype(np.int64)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (natural, summed), n_backoff for each row of docs (doc_id, text), by n-grams up to `order`.

    Words are lower-cased (A-Z) runs between ASCII white space. A null or empty text has no words and scores 0; a null doc_id
    stays null; repeated rows count and are scored each, as documents of their own; other columns are ignored; an empty
    table gives no rows. n_backoff counts the words whose n-gram of the model's order no other document has.
    """
    if order < 1:
        raise ValueError("the order is 1 at least")
    scratch = Scratch(docs.sparkSession)
    blocks = _blocks(docs, order, scratch)
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_grams"), F.lit(0)).alias("g")).first()
    n_all, n_tables = size["w"], max(1, -(-size["g"] // TABLE_GRAMS))
    answers = scratch(_answers(_requests(blocks, n_tables, order)), "lm-answers")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("n_backoff", pa.int64())])

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for body in own.column("body").to_pylist():
            block = Block.load(body)
            grams, counts, _ = block.grams(order)
            totals = counts.astype(np.int64)
            starts = np.searchsorted(partition_of(grams, n_tables), np.arange(n_tables + 1, dtype=np.uint64))
            del grams, counts
            for part, at, more in zip(*(told.column(c).to_pylist() for c in ("part", "at", "totals")), strict=True):
                places = np.cumsum(np.frombuffer(zstandard.decompress(at), np.int32), dtype=np.int64)
                totals[starts[part] + places] = np.frombuffer(zstandard.decompress(more), np.int64)
            logs, backed = score_block(block, totals, n_all, order) if len(block.words) else (np.zeros(len(block.ids)), np.zeros(len(block.ids), np.int64))
            out.append(pa.table([pa.array(block.ids, mask=block.known == 0), pa.array(block.lengths), pa.array(logs), pa.array(backed)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    met = blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block"))
    return met.applyInArrow(score, "doc_id long, n_words long, log_score double, n_backoff long")


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff score of every document, by the counts of all others."""
    scored = score_documents(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return scored.withColumn("mean_score", mean)

"""Toxicity by subword-bag embeddings: a word is the mean of vectors of its character n-grams, a window of words the mean of
its words, and a linear softmax tells the classes apart. Vectors and softmax are trained jointly in numpy.

A document is as toxic as its worst window, so that a few words tell in a long text as in a short one. Unseen misspellings
share n-gram vectors with the words they distort. Since everything up to the softmax is linear, scoring needs one number a
bucket: the vector's product with the softmax's weights. That is all that executors are sent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.common import join_bounded, table, unused
from tallyvane.sources.staging import stage

BUCKETS, DIMS = 1 << 15, 16
#: Lengths of n-grams, in bytes of UTF-8 with a mark at either end of the word.
NGRAMS = (3, 4, 5, 6)
#: Words in a window.
WINDOW = 3
#: Every so many-th text of the sample is kept from training, to fit scale and bias.
HOLD = 4
#: Texts in a training step, and steps at least.
BATCH, LEAST_STEPS = 128, 200
#: The bounded sample of labelled documents that training takes: of each class, and the longest text in it.
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_CHARS = 1500, 3000, 20_000
THRESHOLD = 0.5
#: Words whose scores a task keeps, words whose n-grams are made at once.
CACHE_WORDS, PIECE = 100_000, 20_000
#: Texts whose words a task holds at once.
SLICE = 256
WORDS = re.compile(r"\w+")


def word_list(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words, and of each word as a whole."""
    raw = [b"<%s>" % w.encode("utf-8", "surrogatepass") for w in words]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    number = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    owners, hashes = [], []
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    powers = np.cumprod(np.full(len(text) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint32(0)], np.cumsum(text * powers[:-1], dtype=np.uint32)])
        for n in NGRAMS:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + text[j : len(text) - n + 1 + j]
            inside = number[: len(text) - n + 1] == number[n - 1 :]
            owners.append(number[: len(text) - n + 1][inside])
            hashes.append(h[inside])
        inverse = np.uint32(pow(0x01000193, -1, 1 << 32))
        shifts = np.cumprod(np.full(len(text) + 1, inverse, np.uint32), dtype=np.uint32)
        if len(raw):
            owners.append(np.arange(len(raw)))
            hashes.append((sums[starts[1:]] - sums[starts[:-1]]) * shifts[starts[:-1]] + np.uint32(7))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (np.concatenate(owners) if owners else np.zeros(0, np.int64)), (h >> np.uint32(17)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """weights: the two classes' difference of each bucket's logit; a document's logit is scale * worst window + bias."""

    weights: np.ndarray
    scale: float = 1.0
    bias: float = -2.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, bucket = subwords(words)
        total = np.bincount(owner, weights=self.weights[bucket], minlength=len(words))
        return total / np.maximum(1, np.bincount(owner, minlength=len(words)))

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.bias, -30, 30)))


def worst_windows(scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose word scores stand one after the other: the highest mean over a window of WINDOW words, and its start.

    A shorter text is one window; a text without words has 0.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    best, at = np.zeros(len(lengths)), starts[:-1].copy()
    for k, (a, n) in enumerate(zip(starts[:-1].tolist(), lengths.tolist(), strict=True)):
        if n:
            w = min(n, WINDOW)
            means = (sums[a + w : a + n + 1] - sums[a : a + n - w + 1]) / w
            i = int(means.argmax())
            best[k], at[k] = means[i], a + i
    return best, at


def fit(texts: list[str | None], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0), rounds: int = 8, seed: int = 5) -> Model:
    """Train on texts and labels 0 or 1: first on whole texts, then on each text's worst window as the model now sees it.

    Scale and bias are fitted on texts kept from training; stands_for says how many labelled texts one of each class in the
    sample represents. Without texts of both classes the model tells nothing apart and answers with a constant below one half.
    """
    y = np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS))
    vocabulary: dict[str, int] = {}
    each = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in word_list(t)], dtype=np.int32) for t in texts]  # text by text: all words as strings would be most of the driver's memory
    words, lengths = np.concatenate(each), np.array([len(x) for x in each])
    del each
    starts = np.concatenate([[0], np.cumsum(lengths)])
    listed, parts, numbers = list(vocabulary), [], []
    for k in range(0, len(listed), PIECE):  # piece by piece: the n-grams of all words at once would be most of the driver's memory
        owner, found = subwords(listed[k : k + PIECE])
        parts.append(found[np.argsort(owner, kind="stable")].astype(np.uint16))
        numbers.append(np.bincount(owner, minlength=len(listed[k : k + PIECE])))
    del listed, vocabulary
    bucket, n_sub = np.concatenate(parts), np.concatenate(numbers)
    sub_at = np.concatenate([[0], np.cumsum(n_sub)])

    def bags(spans: list[tuple[int, int]]) -> np.ndarray:
        """Rows of mean bucket weights of word ranges."""
        out = np.zeros((len(spans), BUCKETS), np.float32)
        for k, (a, b) in enumerate(spans):
            if b > a:
                w, times = np.unique(words[a:b], return_counts=True)
                ids = np.concatenate([bucket[sub_at[i] : sub_at[i + 1]] for i in w])
                weight = np.repeat(times / (n_sub[w] * (b - a)), n_sub[w])
                out[k] = np.bincount(ids, weights=weight, minlength=BUCKETS)
        return out

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, softmax, bias)]
    kept = np.zeros(len(y), bool)
    for value in (0, 1):  # a few texts are too few to keep any back
        if (y == value).sum() >= 10 * HOLD:
            kept[np.flatnonzero(y == value)[::HOLD]] = True
    training = np.flatnonzero(~kept)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def step(rows: np.ndarray, spans: list[tuple[int, int]], rate: float) -> None:
        bag = bags(spans)
        hidden = bag @ vectors
        logits = hidden @ softmax + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        wrong = p - np.stack([1 - y[rows], y[rows]], axis=1)
        wrong = (wrong * balance[rows, None] / len(rows)).astype(np.float32)
        for value, gradient, moment in zip((vectors, softmax, bias), (bag.T @ (wrong @ softmax.T), hidden.T @ wrong, wrong.sum(axis=0)), moments, strict=True):
            moment += gradient**2
            value -= rate * gradient / np.sqrt(moment)

    def windows() -> tuple[np.ndarray, np.ndarray]:
        per_bucket = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
        score = np.empty(len(n_sub))
        for k in range(0, len(n_sub), PIECE):
            a, b = sub_at[k], sub_at[min(k + PIECE, len(n_sub))]
            score[k : k + PIECE] = np.add.reduceat(per_bucket[bucket[a:b]], sub_at[k : min(k + PIECE, len(n_sub))] - a)
        return worst_windows((score / n_sub)[words], lengths)

    rounds = max(rounds, LEAST_STEPS * BATCH // len(training))
    for turn in range(rounds):
        whole = turn < rounds // 3
        at = None if whole else windows()[1]
        shuffled = rng.permutation(training)
        for k in range(0, len(shuffled), BATCH):
            rows = shuffled[k : k + BATCH]
            spans = [(starts[r], starts[r + 1]) if whole else (at[r], min(at[r] + WINDOW, starts[r + 1])) for r in rows]
            step(rows, spans, 0.1)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
    held = kept if 0 < y[kept].sum() < kept.sum() else ~kept
    worst, y = windows()[0][held], y[held]
    mass = np.where(y == 1, stands_for[1], stands_for[0])
    mass = mass / mass.sum()
    center, spread = worst.mean(), worst.std() or 1.0
    z, a, c = (worst - center) / spread, 1.0, 0.0
    for _ in range(300):  # a and c by gradient steps on the weighted loss with a little shrinkage
        p = 1 / (1 + np.exp(-(a * z + c)))
        a -= 4.0 * (((p - y) * z * mass).sum() + 1e-3 * a)
        c -= 4.0 * ((p - y) * mass).sum()
    return Model(weights, a / spread, c - a * center / spread)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts, labels, and what one of each class stands for: at most about TRAIN_POSITIVE and TRAIN_NEGATIVE of the labelled
    texts up to TRAIN_CHARS characters, chosen by a hash of their id among those whose crc32(doc_id) mod 5 is not 0."""
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    fits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= TRAIN_CHARS)
    usable = stage(join_bounded(fits.select("doc_id"), labelled, ["doc_id"], "inner", labelled.count()).select("doc_id", "toxic"), "labelled")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, most in ((0, TRAIN_NEGATIVE), (1, TRAIN_POSITIVE)):
        share = F.when(F.col("toxic") == value, F.lit(min(1.0, most / max(1, counts.get(value, 0))))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    rows = fits.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()  # as many ids as the sample has
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    shares = (max(1.0, counts.get(0, 0) / TRAIN_NEGATIVE), max(1.0, counts.get(1, 0) / TRAIN_POSITIVE))
    return [r["text"] for r in rows], [r["toxic"] for r in rows], shares


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the probability that label 1 fits in column `score`.

    Every whole text is read. A null text, or one without words, has the score of a window without evidence. Rows are
    independent; repeated rows get the same score; other columns are kept, one named as `score` is replaced.
    """
    docs = docs.drop(score)
    names, at = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            split = [word_list(t) for t in batch.column(at).to_pylist()]
            if missing := list(set().union(*split) - known.keys()):
                for k in range(0, len(missing), PIECE):
                    part = missing[k : k + PIECE]
                    known.update(zip(part, shared.value.word_scores(part).tolist(), strict=True))
            lengths = np.array([len(ws) for ws in split], dtype=np.int64)
            flat = np.fromiter((known[w] for ws in split for w in ws), np.float64, int(lengths.sum()))
            worst, _ = worst_windows(flat, lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.probability(worst))], names=[*names, score])
            if len(known) > CACHE_WORDS:
                known = {}

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_sample(docs, labels))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with the columns of docs, whatever their names.

    A null or empty text has the score of no evidence and stays if that is below threshold; repeated rows go or stay
    together; null ids make no difference; an empty table gives no rows.
    """
    score = unused(docs, "toxicity")
    return score_documents(docs, model, score=score).filter(F.col(score) < threshold).drop(score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

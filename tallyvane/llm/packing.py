"""Packing along a space-filling curve: hashed document vectors are projected to a few dimensions, documents are range-sorted
by the Hilbert key of the projection, and neighbours along the curve fill sequences of a fixed length."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import table
from tallyvane.sources.staging import stage

SEQUENCE = 2048
END_ID = 1
#: Buckets of the hashed vector, dimensions of its projection, bits of each on the curve.
BUCKETS, DIMS, BITS = 256, 3, 16
#: Tokens that a range partition should hold, and how many partitions there may be.
PARTITION_TOKENS, MAX_PARTITIONS = 8_000_000, 100_000
#: Bytes of text that are tokenized at once.
SLICE_BYTES = 3 << 20
#: Entries of a worker's caches of runs and of words that go through the whole tokenizer, and the longest entry.
CACHE_RUNS, CACHE_WORDS, CACHE_CHARS = 200_000, 50_000, 40
#: Runs that are merged at once.
MERGE_RUNS = 16_384
#: What a worker keeps of either cache when it is full, and from one task to the next.
KEPT = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Cache(dict):
    """Ids by string. It keeps the entries that came first, which are those of frequent strings, when it is cut back."""

    def join(self, keys: list[str], make: Callable[[list[str]], list[bytes]], most: int) -> bytes:
        """Ids of some strings, one after the other; those that it lacks are made, and kept if they are short."""
        fresh = list(set(keys) - self.keys())
        self.update(zip(fresh, make(fresh), strict=True))
        out = b"".join(map(self.__getitem__, keys))
        for key in fresh:
            if len(key) > CACHE_CHARS:
                del self[key]
        self.cut(most)
        return out

    def cut(self, most: int) -> None:
        if len(self) > most:
            kept = dict(islice(self.items(), KEPT))
            self.clear()
            self.update(kept)


class Merges:
    """Byte-pair merges of many runs at once: in each round every run takes its best merge, the leftmost of equal ones."""

    NONE = np.int64(1 << 40)

    def __init__(self, model: dict) -> None:
        ids, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        if not suffix:
            raise ValueError("the tokenizer must mark the ends of words")
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        # an open hash table of pairs: a key lies at most `reach` places after its own
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ranks, self.reach = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, self.NONE, np.int64), 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            step = 0
            while self.keys[at + step] >= 0:
                step += 1
            self.keys[at + step], self.ranks[at + step], self.reach = key, rank, max(self.reach, step + 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge."""
        key = left << 32 | right
        at = self._place(key)
        out = np.where(self.keys[at] == key, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((out == self.NONE) & (self.keys[at] >= 0))
        for step in range(1, self.reach):
            if not len(open_):
                break
            there = at[open_] + step
            out[open_] = np.where(self.keys[there] == key[open_], self.ranks[there], self.NONE)
            open_ = open_[(out[open_] == self.NONE) & (self.keys[there] >= 0)]
        return out

    def apply(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some runs, none empty and none with a line's end, one after the other, and how many each has."""
        raw = np.frombuffer("\n".join([*runs, ""]).encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        last = np.zeros(len(raw), bool)
        last[ends - 1] = True
        sym = np.where(last, self.final[raw], self.inner[raw])[raw != 10]
        owner = np.repeat(np.arange(len(runs)), np.diff(ends, prepend=-1) - 1)
        rank = np.full(len(sym), self.NONE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(begin, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            going = best < self.NONE
            if not going.all():
                done.append((owner[~going], sym[~going]))
                sym, owner, rank, best = sym[going], owner[going], rank[going], best[going]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            # the merged symbol has a new pair on either side
            after = np.minimum(at + 1, len(sym) - 1)
            rank[at] = np.where((after > at) & (owner[after] == owner[at]), self.rank(sym[at], sym[after]), self.NONE)
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            rank[left] = self.rank(sym[left], sym[left + 1])
        owners, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(runs))


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins what stands on its two sides.

    A text's ids are then those of its words in turn, so each distinct word of a slice of texts is encoded once. Words of
    visible ASCII and Latin-1 letters, on which normalisation is lower-casing alone, are cut into runs as the tokenizer's
    own pattern does, all at once, and these are merged together; other words go through the whole tokenizer.
    """

    #: A line that is not of visible ASCII and Latin-1 letters alone; what the tokenizer's pattern keeps whole, or a line's end.
    ODD = re.compile(r"(?m)^[!-~À-ÖØ-öø-ÿ]*+[^!-~À-ÖØ-öø-ÿ\n][^\n]*")
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")
    #: Stands for a line's end among ids.
    CUT = np.uint32(0xFFFFFFFF)

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.specials = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        letters = byte_letters()
        self.mapped = {ord(c): "".join(letters[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        self.words, self.runs = Cache({}), Cache({"\n": self.CUT.tobytes()})

    def of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of lower-case runs that the tokenizer's pattern does not cut, each as little-endian unsigned 32-bit numbers.
        Long ones are left to the tokenizer's model: rounds are as many as the longest run's merges."""
        out: list[bytes] = [b""] * len(runs)
        short = [i for i, r in enumerate(runs) if len(r) <= CACHE_CHARS]
        for at in range(0, len(short), MERGE_RUNS):
            part = short[at : at + MERGE_RUNS]
            ids, n = self.merges.apply([runs[i] for i in part])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            for i, a, b in zip(part, [0, *ends], ends, strict=False):
                out[i] = raw[a:b]
        for i in (i for i, r in enumerate(runs) if len(r) > CACHE_CHARS):
            out[i] = np.array([t.id for t in self.tokenizer.model.tokenize(runs[i].translate(self.mapped))], "<u4").tobytes()
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words by the whole tokenizer, and CUT."""
        return [np.array([*self.tokenizer.encode(w, add_special_tokens=False).ids, self.CUT], "<u4").tobytes() for w in words]

    def table(self, lines: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, one a line, one after the other, and where each word's begin and how many they are."""
        odd = set(self.ODD.findall(lines))
        if "<" in lines:
            odd |= {w for w in lines.split("\n") if self.specials.search(w)}
        words = lines.split("\n") if odd else []
        if odd:
            lines = "\n".join(["" if w in odd else w for w in words])
        flat = np.frombuffer(self.runs.join(self.RUNS.findall(lines.lower() + "\n"), self.of_runs, CACHE_RUNS), "<u4")
        ends = np.flatnonzero(flat == self.CUT)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts
        if odd:
            at = np.array([i for i, w in enumerate(words) if w in odd])
            more = np.frombuffer(self.words.join([words[i] for i in at.tolist()], self.of_words, CACHE_WORDS), "<u4")
            cuts = np.flatnonzero(more == self.CUT)
            starts[at] = len(flat) + np.concatenate([[0], cuts[:-1] + 1])
            lengths[at] = np.diff(cuts, prepend=-1) - 1
            flat = np.concatenate([flat, more])
        return flat, starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of them; null has none."""
        clean = pc.fill_null(texts, "")
        for space in "\n\t\r":
            clean = pc.replace_substring(clean, space, " ")
        split = pc.split_pattern(clean, " ")
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        whole = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        flat, starts, lengths = self.table(pc.binary_join(whole, "\n")[0].as_py())
        which = words.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[which] - ends + n, n) + np.arange(int(ends[-1]))]
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(upto)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@cache
def _tables(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection of buckets to dimensions."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    sign = np.where((mixed >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    return bucket, sign, np.random.default_rng(17).standard_normal((BUCKETS, DIMS))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of an (n, dims) array of unsigned coordinates of `bits` bits."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for d in range(len(x)):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ turn) >> bit) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """Hilbert key of each document from the ids of all, one after the other."""
    bucket, sign, projection = _tables(vocabulary)
    at = np.repeat(np.arange(len(lengths)) * BUCKETS, lengths) + bucket[ids]
    vectors = np.bincount(at, weights=sign[ids], minlength=len(lengths) * BUCKETS)
    vectors = vectors.astype(np.float64).reshape(-1, BUCKETS)  # of no ids at all bincount makes integers
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    projected = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0) @ projection
    spread = 1 / (1 + np.exp(-1.702 * projected))  # about the normal distribution function: coordinates become even
    return hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a text column; a longer text is a slice of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def id_width(vocabulary: int) -> int:
    """Bytes of an id as staged."""
    return 2 if vocabulary <= 1 << 16 else 4


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve_key, tie, n_tokens and ids (little-endian 16-bit, or 32-bit for a large vocabulary, with END_ID last)."""
    schema = "doc_id long, curve_key long, tie long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(path)
        for part in (x for batch in batches for x in slices(batch, "text", SLICE_BYTES)):
            ids, lengths = words.encode(part.column("text"))
            ends = np.cumsum(lengths + 1)
            body = np.full(int(ends[-1]), END_ID, f"<u{id_width(words.vocabulary)}")
            body[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
            offsets = np.concatenate([[0], ends * body.itemsize]).astype(np.int64)
            bodies = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).cast(pa.binary())
            keys = pa.array(curve_keys(ids, lengths, words.vocabulary))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, part.column("tie"), pa.array(lengths + 1), bodies], names=["doc_id", "curve_key", "tie", "n_tokens", "ids"])
        words.words.cut(KEPT)
        words.runs.cut(KEPT)

    # equal texts share a key: the tie, fixed once staged, lets a range boundary fall between them
    tied = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    return tied.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of documents in sequences of at most `sequence` tokens, neighbours along the curve together.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset, curve_key and ids (little-endian 32-bit, those of the
    piece). A document is its text's ids and END_ID; it is cut wherever a sequence is full. Only the last sequence of each
    range partition is short. Null and empty texts are documents of one token; a null doc_id stays null; repeated rows are
    packed as often as they occur; ties on the curve are broken by a hash, so that no group of equal texts is bound to one
    partition; other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer_path or default_tokenizer()
    tokens = stage(tokenize(docs, path), "pack-tokens", compression="zstd")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, min(MAX_PARTITIONS, -(-total // PARTITION_TOKENS)))
    width = id_width(_tokenizer(path).vocabulary)
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve_key long, ids binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence_id, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, key, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "curve_key", "n_tokens", "ids")), strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    if used == sequence:
                        sequence_id, used = sequence_id + 1, 0
                    length = min(n - start, sequence - used)
                    for column, value in zip(out, (doc_id, start, length, n, sequence_id, used, key, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    start, used = start + length, used + length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return tokens.repartitionByRange(parts, "curve_key", "tie").sortWithinPartitions("curve_key", "tie").mapInArrow(fill, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns from packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve_key")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return piece_digests(pack(table(spark, sf_dir, "documents")))

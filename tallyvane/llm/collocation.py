"""Mining of collocations: phrases whose words stand together more often than their parts' own counts suggest.

Texts are cut into pieces at punctuation; equal pieces of a language become one with a multiplicity. N-grams are counted level
by level, weighted by the multiplicities: each task counts those of its pieces in duckdb, the counts go to hash buckets, and
duckdb adds them up there; both may use disk beyond a set amount of memory. An n-gram of a level takes part only if a filter
says that both n-grams it is made of were frequent, which drops nothing frequent. The counts of a phrase's parts lie in other
buckets: they are asked for by requests shuffled to the part's key, and answered by a join.
"""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.llm.common import table
from tallyvane.sources.staging import Scratch

#: Language of a document without one.
UNKNOWN = "und"
LEAST, LONGEST, COVER, TOP, SCALE = 10, 3, 50, 2000, 1_000_000
#: Ends of pieces, all written as a line's end; upper case of A-Z; a tab is a space.
ENDS, UPPER = b".,;:!?\x0a\x0b\x0c\x0d", bytes(range(65, 91))
PLAIN = bytes.maketrans(UPPER + ENDS + b"\t", UPPER.lower() + b"\n" * len(ENDS) + b" ")
#: Distinct pieces that a task holds before it passes their counts on.
HELD = 100_000
#: Memory of one count in duckdb; beyond it the count goes to disk. What is on disk costs memory too, so a count that grew with
#: the input would fail: rows that a task may count in several goes, and those that a hash bucket may be expected to have, in
#: bytes.
MEMORY = "160MB"
RUN_BYTES, BUCKET_BYTES = 192 << 20, 192 << 20
#: log2 of the bits of the filter of frequent n-grams (16 MB), and of those in one row while it is made.
FILTER_BITS, CHUNK_BITS = 27, 16
#: Parts in which a language's phrases are ranked before the best of each meet.
RANK_PARTS = 64
#: An odd number, by whose powers hashes tell places apart.
STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, words joined by one space, and how often each occurs."""
    schema = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                texts = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), texts, pa.array(counts.values(), pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    text = text.translate(PLAIN)
                    while b"  " in text:
                        text = text.replace(b"  ", b" ")
                    text = text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ")
                    held.setdefault(lang, Counter()).update(filter(None, text.split(b"\n")))
                    if sum(map(len, held.values())) > HELD:
                        yield from passed_on()
        yield from passed_on()

    found = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, "lang string, piece string, m long")
    return found.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


@contextmanager
def counter() -> Iterator[object]:
    """A duckdb connection of bounded memory that uses a folder of its own, removed at the end."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="counts-") as folder:
        db = duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": folder, "threads": 1, "preserve_insertion_order": False})
        try:
            yield db
        finally:
            db.close()


def added_up(least: int = 0, make: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches: `make` gives rows (lang, phrase, f) of each; f of equal phrases is added up in duckdb,
    and sums from `least` on are returned. Without `least` a phrase may come again with a part of its sum each time: after
    RUN_BYTES a new count begins."""
    limit = math.inf if least else RUN_BYTES

    def upto(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        while size < limit and (batch := next(rows, None)) is not None:
            size += batch.nbytes
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (make(b) if make else b for b in batches)
        for first in made:
            rows = pa.RecordBatchReader.from_batches(COUNTS, chain([first], upto(made, first.nbytes)))
            with counter() as db:
                db.register("rows", rows)
                sums = db.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM rows GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
                yield from sums.to_arrow_reader(20_000)

    return run


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * STEP + b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


#: A number for each byte, of which hashes of strings are made.
OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64), STEP)


def _hashes(strings: pa.Array, at_once: int = 1 << 16) -> np.ndarray:
    """Hashes of strings, the same in every task, from their bytes in Arrow: no string becomes a Python object. Sums of a number
    for each byte times a power for its place in the string; two strings may share one, which a filter can bear."""
    if len(strings) > at_once:
        return np.concatenate([_hashes(strings.slice(i, at_once), at_once) for i in range(0, len(strings), at_once)])
    _, offsets, body = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    sizes = np.diff(ends)
    if not sizes.any():
        return _mix(np.zeros(len(sizes), np.uint64), sizes.astype(np.uint64))
    powers = np.multiply.accumulate(np.full(sizes.max(), STEP, np.uint64))
    places = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)
    sums = np.zeros(len(places) + 1, np.uint64)
    np.cumsum(OF_BYTE[np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]] * powers[places], out=sums[1:])
    return _mix(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], sizes.astype(np.uint64))


class Words:
    """The words of some pieces: each one's place, its piece, and a hash of it and its language."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        split = pc.split_pattern(batch.column("piece"), " ")
        coded, self.langs = split.flatten().dictionary_encode(), batch.column("lang").dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.piece = np.repeat(np.arange(batch.num_rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))

    @cached_property
    def hash(self) -> np.ndarray:
        of_lang = _hashes(self.langs.dictionary)[self.langs.indices.to_numpy()]
        return _mix(of_lang[self.piece], _hashes(self.words)[self.codes])

    def starts(self, n: int) -> np.ndarray:
        """Where an n-gram begins."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams that begin at some places; of a language and a phrase always the same."""
        return reduce(_mix, (self.hash[at + k] for k in range(n)))

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def frequent_filter(frequent: DataFrame, n: int) -> bytes:
    """A bitmap of FILTER_BITS bits, whatever the number of n-grams, in which the hash of each frequent one is set."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase")], names=["lang", "piece"]))
            yield pa.RecordBatch.from_arrays([pa.array(_bits(words.hashes(words.starts(n), n)))], names=["place"])

    def packed(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << CHUNK_BITS, np.uint8)
        own[rows.column("place").to_numpy() & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": [rows.column("chunk")[0].as_py()], "body": [np.packbits(own).tobytes()]}, schema=pa.schema([("chunk", pa.int64()), ("body", pa.binary())]))

    found = frequent.select("lang", "phrase").mapInArrow(places, "place long").distinct().withColumn("chunk", F.shiftright("place", CHUNK_BITS))
    bits = bytearray(1 << (FILTER_BITS - 3))
    size = 1 << (CHUNK_BITS - 3)
    for row in found.groupBy("chunk").applyInArrow(packed, "chunk long, body binary").collect():  # 16 MB at most
        bits[row["chunk"] * size : (row["chunk"] + 1) * size] = row["body"]
    return bytes(bits)


def count_ngrams(found: DataFrame, longest: int, least: int, scratch: Scratch) -> list[DataFrame]:
    """For n = 1 to longest: (lang, phrase, f) of the n-grams that occur at least `least` times in pieces (lang, piece, m)."""
    spark, out = found.sparkSession, []
    n_bytes = found.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    for n in range(1, longest + 1):
        known = spark.sparkContext.broadcast(frequent_filter(out[-1], n - 1)) if n > 1 else None

        def make(batch: pa.RecordBatch, n: int = n, known=known) -> pa.RecordBatch:
            words = Words(batch)
            at = words.starts(n)
            if known is not None and len(at):
                bits = np.frombuffer(known.value, np.uint8)
                here = _bits(words.hashes(np.arange(len(words.piece) - n + 2), n - 1))
                set_ = (bits[here >> 3] >> (7 - (here & 7)).astype(np.uint8) & 1).astype(bool)
                at = at[set_[at] & set_[at + 1]]
            rows = pa.array(words.piece[at])
            return pa.RecordBatch.from_arrays([batch.column("lang").take(rows), words.phrases(at, n), batch.column("m").take(rows)], schema=COUNTS)

        schema = "lang string, phrase string, f long"
        partial = found.mapInArrow(added_up(make=make), schema)
        # n-grams of all pieces have at most n times their bytes, before they are counted
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * n_bytes // BUCKET_BYTES))
        out.append(scratch(partial.repartition(buckets, "lang", "phrase").mapInArrow(added_up(least), schema), f"frequent-{n}"))
        if known is not None:
            known.unpersist()
    return out


def _whole(column: str) -> F.Column:
    """A count as an exact decimal: the product of three and SCALE then has at most 38 digits."""
    return F.col(column).cast("decimal(13,0)")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a) with l, r and score of their lowest-scoring cut; counts (lang, phrase, f) answer for parts."""
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice(words, F.lit(1), k)).alias("first"), F.concat_ws(" ", F.slice(words, k + 1, F.size(words) - k)).alias("rest"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), cut)).alias("cut"))
    sides = F.array(F.struct(F.lit(True).alias("is_first"), F.col("cut.first").alias("part")), F.struct(F.lit(False).alias("is_first"), F.col("cut.rest").alias("part")))
    requests = cuts.select("lang", "phrase", "a", "cut.k", F.explode(sides).alias("side")).select("lang", "phrase", "a", "k", "side.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
    # whole division of decimals is exact; parts are at least as frequent as the phrase, so the quotient is at most SCALE
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(13,0)) * cast(a as decimal(13,0)))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covers(candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, cover): the largest count of a longer candidate that holds a phrase of two words or more."""
    words = F.split("phrase", " ")
    inside = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.concat_ws(" ", F.slice(words, at, F.lit(n))))
    shorter = [F.when(F.size(words) > n, inside(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest)]
    if not shorter:
        return candidates.limit(0).select("lang", "phrase", F.col("a").alias("cover"))
    return candidates.select("lang", F.explode(F.concat(*shorter)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language.

    A phrase is a candidate if it occurs at least `least` times (a); its score is floor(1,000,000 a a / (l r)) of the
    lowest-scoring cut into two parts of l and r occurrences (ties: the shorter first part); n counts the language's words.
    Candidates inside a longer one that has at least `cover` percent of their occurrences are left out. Ranks are by score and
    a, falling, then by the phrase's bytes. A null or empty text has no words; a document without language is of `und`;
    doc_id is not looked at, so repeated rows count as often as they occur; other columns are ignored; an empty table gives no
    rows. Counts may have up to 13 digits.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be positive, longest at least 2")
    scratch = Scratch(docs.sparkSession)
    found = scratch(pieces(docs), "pieces", compression="zstd")
    n = found.groupBy("lang").agg(F.sum(F.col("m") * F.size(F.split("piece", " "))).alias("n"))
    levels = count_ngrams(found, longest, least, scratch)
    counts = reduce(DataFrame.unionByName, levels)
    candidates = reduce(DataFrame.unionByName, levels[1:]).withColumnRenamed("f", "a")
    kept = scored(candidates, counts).join(covers(candidates, longest), ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("cover") < cover * F.col("a"), F.lit(True)))
    # ranked in parts first: no task holds all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f
    FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k))
    GROUP BY lang, k, g HAVING count(*) >= 10
), parts AS (
    SELECT lang, phrase, f AS a, c, array_to_string(g[1 : c], ' ') AS first, array_to_string(g[c + 1 :], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS c FROM grams WHERE k > 1)
), cuts AS (
    SELECT p.lang, p.phrase, p.a, p.c, l.f AS l, r.f AS r, ((1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM parts p JOIN grams l ON l.lang = p.lang AND l.phrase = p.first JOIN grams r ON r.lang = p.lang AND r.phrase = p.rest
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), covered AS (
    SELECT lang, phrase, max(f) AS cover FROM (SELECT lang, f, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS phrase FROM grams WHERE k = 3) GROUP BY lang, phrase
), ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
    FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase WHERE c.cover IS NULL OR 100 * c.cover < 50 * s.a
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""

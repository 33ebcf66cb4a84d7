"""N-gram Jaccard join by PartEnum signatures.

A document is its set of hashed word n-grams. Sizes are cut into bands so that sets that are similar enough lie in the same
band or in neighbouring ones. For a band with largest size r, similar sets differ in at most k elements. The domain is cut
into n1 partitions by hash, so that in one of them they differ in at most k2 elements; that partition is cut again into n2
parts, and every choice of n2 - k2 of these gives a signature. Similar sets share one.

Where a signature covers few n-grams (k2 = 0), an empty one would join a large part of all documents, so there are SPARE
partitions more than k + 1: a set with fewer empty partitions than spare ones agrees with each similar set on a signature
that is not empty. A set with more of them adds signatures by another hash.

Sets that merely share a passage meet there as well, and a passage that many texts share makes a large bucket. The classes of
large buckets are told apart once more: similar sets share one of the first n-grams of any common order, as many as they may
differ in and one, and rare n-grams come first, so that texts meet by what few have and not by the shared passage. What met is
compared by sketches, which tell surely that sets differ too much: pair by pair in a small bucket; in a large one in blocks of
bounded size, which meet where sizes allow links and of which a spanning forest is kept.

Equal sets are one class throughout. Classes that may be similar form candidate groups; within a group every pair that size
allows is compared exactly, in blocks, and what leaves a block pair is a spanning forest and counts, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import join_bounded, table, unused
from tallyvane.sources.staging import Scratch
from tallyvane.operators.graph import connected_components

#: Classes, and n-grams, in a block of a candidate group.
BLOCK_SETS, BLOCK_GRAMS = 384, 400_000
#: Groups up to this size compare pairs one by one; larger ones multiply matrices of so many n-grams at a time.
SMALL_GROUP, COLUMNS = 24, 2048
#: Partitions beyond those that the differences can hit, in percent, and hashes that a set with too many empty partitions
#: tries; by the last of them its empty signatures count too.
SPARE, HASHES = 10, 6
#: Classes of a bucket up to which each pair is compared by sketches; the classes of a larger one are linked at once.
SMALL_BUCKET = 12
#: N-grams that are moved at once while groups are compared, or those of all classes in groups, if these are more.
ROUND_GRAMS = 1 << 27
#: Cells in which n-grams are counted to tell rare ones from frequent ones; any order of n-grams is right, this one is quick.
CELLS = 1 << 18


def gram_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams, A-Z lowered; fewer words than that are one n-gram, none is empty."""
    tokens = (text or b"").lower().split()  # bytes: only ASCII letters and ASCII white space count
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = (out ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


class PartEnum:
    """Signatures for Jaccard similarity of at least percent / 100."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.tops = [1]  # largest size of each band
        # few parts where little may differ; none where many partitions are needed anyway
        self.n2, self.k2 = (3, 1) if percent >= 85 else (1, 0)

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size))

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return self.tops[band]

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.uint64)
        own = self.band(len(grams))
        out = []
        for band in (own, own + 1):
            k = 2 * self.top(band) * (100 - self.percent) // (100 + self.percent)
            if k == 0:
                continue  # only equal sets are similar
            n1 = -(-(k + 1) // (self.k2 + 1))
            if self.k2:
                out.append(self._choices(grams, band, n1, 0)[0].reshape(-1))
                continue
            spare = -(-n1 * SPARE // 100)
            for seed in range(HASHES):
                sig, chosen = self._choices(grams, band, n1 + spare, seed)
                # of two similar sets, both get to the first hash by which either has few empty partitions
                few = np.count_nonzero(chosen == 0) <= spare
                out.append(sig[chosen != 0] if few or seed < HASHES - 1 else sig.reshape(-1))
                if few:
                    break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _choices(self, grams: np.ndarray, band: int, n1: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures by one hash, and the sums of the n-grams they cover: 0 where there are none."""
        n2 = self.n2
        with np.errstate(over="ignore"):
            mixed = grams * np.uint64((0xD6E8FEB86659FD93 + seed * 0x9E3779B97F4A7C16) % (1 << 64))
            mixed ^= mixed >> np.uint64(32)
            cell = ((mixed >> np.uint64(3)) % np.uint64(n1)).astype(np.int64) * n2 + ((mixed >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, cell, mixed * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
            sums = sums.reshape(n1, n2)
            chosen = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums if self.k2 else sums
            place = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) + np.uint64((seed << 56) + ((band + 1) << 32))
            sig = (chosen ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
            return sig ^ (sig >> np.uint64(33)), chosen


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of n-grams in 2^j cells, about one cell an n-gram; each difference of two sets flips one."""
    cells = 1 << max(8, len(grams).bit_length())
    with np.errstate(over="ignore"):
        cell = (grams * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)) & np.uint64(cells - 1)
    return np.packbits((np.bincount(cell.astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number of n-grams in which the sets of two sketches differ at least."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<u8").reshape(-1, 2)
    return _signed(digests[:, 0].copy()), _signed(digests[:, 1].copy())


def shingle_sets(docs: DataFrame, words: int, with_grams: bool, with_sketch: bool = False) -> DataFrame:
    """doc_id, n_shingles, key_lo, key_hi (a 128-bit digest of the set) and, if asked for, the n-grams as bytes and a sketch."""
    schema = "doc_id long, n_shingles long, key_lo long, key_hi long" + ", grams binary" * with_grams + ", sketch binary" * with_sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [gram_hashes(x, words) for x in part.column("body").to_pylist()]
                columns = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *_keys(sets)]
                if with_grams:
                    columns.append(pa.array([x.tobytes() for x in sets], pa.binary()))
                if with_sketch:
                    columns.append(pa.array([sketch(x) for x in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body")).mapInArrow(run, schema)


def signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, cls): the signatures of every document, cls being the low half of its set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [gram_hashes(x, words) for x in batch.slice(at, 256).column("body").to_pylist()]
                found = [scheme.signatures(x) for x in sets]
                low, _ = _keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate([np.zeros(0, np.uint64), *found])), pa.array(np.repeat(low.to_numpy(), [len(x) for x in found]))],
                    names=["sig", "cls"],
                )

    return docs.select(F.encode("text", "UTF-8").alias("body")).mapInArrow(run, "sig long, cls long")


def bucket_pairs(sigs: DataFrame) -> DataFrame:
    """(sig, u, v): the pairs of classes that meet in a small bucket, and (sig, u, null) for each class of a larger one.
    sigs has a bucket's rows together, sorted by class; at most SMALL_BUCKET rows of it and one batch are kept in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, cls, opened = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last bucket's rows; whether it is known to be large
        for batch in chain(batches, [None]):
            if batch is not None:
                sig = np.concatenate([sig, batch.column("sig").to_numpy()])
                cls = np.concatenate([cls, batch.column("cls").to_numpy()])
            if not len(sig):
                continue
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
            sig, cls = sig[fresh], cls[fresh]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(starts, len(sig)))
            large = sizes > SMALL_BUCKET
            large[0] |= opened
            small = ~large
            if batch is not None:
                small[-1] = False  # it may go on
            place = np.arange(len(sig)) - np.repeat(starts, sizes)
            of_large = np.repeat(large, sizes)
            if opened:
                of_large[0] = False  # the row that was kept to go on from
            at = np.flatnonzero(of_large)
            members, s, u, v = len(at), [sig[at]], [cls[at]], [cls[at]]
            of_small = np.repeat(small, sizes)
            for back in range(1, SMALL_BUCKET):
                at = np.flatnonzero(of_small & (place >= back))
                if not len(at):
                    break
                s.append(sig[at])
                u.append(cls[at])
                v.append(cls[at - back])
            ss, us, vs = np.concatenate(s), np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(ss), pa.array(us), pa.array(vs, mask=np.arange(len(vs)) < members)], names=["sig", "u", "v"])
            opened = bool(large[-1])
            last = slice(len(sig) - 1 if opened else starts[-1], None)
            sig, cls = sig[last], cls[last]

    return sigs.mapInArrow(run, "sig long, u long, v long")


def sketches_of(sets: DataFrame, name: str) -> DataFrame:
    """A row for each low half of a digest (two classes that share one have two): its name, size and sketch."""
    kept = sets.filter("n_shingles > 0").groupBy("key_lo", "key_hi").agg(F.first("n_shingles").alias(f"n_{name}"), F.first("sketch").alias(f"sketch_{name}"))
    return kept.drop("key_hi").withColumnRenamed("key_lo", name)


def likely_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v) without the pairs whose sketches show that their sets are not similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            least = np.fromiter(map(least_difference, batch.column("sketch_u").to_pylist(), batch.column("sketch_v").to_pylist()), np.int64, len(n))
            yield batch.select(["u", "v"]).filter(pa.array((100 + percent) * least <= (100 - percent) * n))

    compared = pairs.join(sketches_of(sets, "u"), "u").join(sketches_of(sets, "v"), "v")
    return compared.mapInArrow(run, "u long, v long")


def folded(bits: np.ndarray, cells: int) -> np.ndarray:
    """Sketches, a row each of 64-bit words, folded to so many cells."""
    while bits.shape[1] * 64 > cells:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs that neither sizes nor sketches show not to be similar."""
    sizes = sizes.astype(np.int64)
    out = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    lengths = np.array([8 * len(x) for x in sketches])
    for cells in np.unique(lengths):  # pairs whose shorter sketch has so many cells
        rows = np.flatnonzero(lengths >= cells)
        own = np.flatnonzero(lengths == cells)
        bits = np.concatenate([folded(np.frombuffer(b"".join(sketches[i] for i in rows[lengths[rows] == c]), np.uint64).reshape(-1, c // 64), cells) for c in np.unique(lengths[rows])])
        order = np.concatenate([rows[lengths[rows] == c] for c in np.unique(lengths[rows])])
        mine = bits[: len(own)]  # the shortest come first
        least = np.zeros((len(own), len(order)), np.int32)
        for word in range(bits.shape[1]):
            least += np.bitwise_count(mine[:, word, None] ^ bits[None, :, word])
        fits = (100 + percent) * least <= (100 - percent) * (sizes[own][:, None] + sizes[order][None, :])
        out[np.ix_(own, order)] &= fits
        out[np.ix_(order, own)] &= fits.T
    np.fill_diagonal(out, True)
    return out


def in_blocks(rows: DataFrame, group: str, member: str, size: str, n_blocks: Column, percent: int, scratch: Scratch) -> DataFrame:
    """rows once for each pair (p, q) of blocks that they take part in, with their own band and block. n_blocks counts the
    blocks that rows fill. A group of more than one is cut into bands of sizes first: members link within a band or with the
    next, so other bands never meet."""
    # staged, so that joins with them can be split where one group is large
    whole = scratch(rows.groupBy(group).agg(n_blocks.alias("n_blocks")).select(group, (F.col("n_blocks") > 1).alias("is_cut")), "whole")
    width = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-6  # a little more than similar sizes differ
    banded = rows.join(whole, group).withColumn("band", F.when(F.col("is_cut"), F.floor(F.log(size) / width)).otherwise(0).cast("int"))
    blocks = scratch(banded.groupBy(group, "band").agg(n_blocks.alias("n_blocks")), "blocks")
    dealt = banded.join(blocks, [group, "band"]).withColumn("block", F.pmod(F.xxhash64(member), F.col("n_blocks")).cast("int"))
    # a block meets those of its own band and of the next, each once; smaller bands meet it in turn
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: F.col("band") + step)
    other = blocks.select(group, F.col("band").alias("other_band"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    met = dealt.withColumn("other_band", F.explode(near)).join(other, [group, "other_band"])
    own, theirs = F.struct(F.col("band").alias("b"), F.col("block").alias("k")), F.struct(F.col("other_band").alias("b"), F.col("other").alias("k"))
    return met.withColumns({"p": F.least(own, theirs), "q": F.greatest(own, theirs)}).drop("is_cut", "n_blocks", "other_band", "other")


def bucket_forests(sets: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): for each large bucket, forests that span the classes which sketches do not tell apart. members: sig, u."""
    met = in_blocks(members.join(sketches_of(sets, "u"), "u"), "sig", "u", "n_u", F.ceil(F.count("*") / BLOCK_SETS).cast("int"), percent, scratch)

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("u").to_numpy()
        linked = may_link(group.column("n_u").to_numpy(), group.column("sketch_u").to_pylist(), percent)
        least = ids[link_labels(linked)]
        return pa.table({"u": ids, "v": least}).filter(pa.array(ids != least))

    return met.select("sig", "p", "q", "u", "n_u", "sketch_u").groupBy("sig", "p", "q").applyInArrow(compare, "u long, v long")


def gram_counts(sets: DataFrame) -> np.ndarray:
    """How many n-grams of sets (grams) fall into each of CELLS cells; a task brings one row a cell at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                grams = np.frombuffer(b"".join(batch.column("grams").slice(at, 2048).to_pylist()), np.uint64)
                total += np.bincount(gram_cells(grams), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = sets.select("grams").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def gram_cells(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def rare_grams(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the order of their cells' counts, one more than may be missing from a similar set:
    two similar sets have one of these in common."""
    n = len(grams)
    return grams[np.lexsort((grams, counts[gram_cells(grams)]))[: n - -(-percent * n // 100) + 1]]


def rare_rows(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(sig, cls): the rare n-grams of each class. sets: cls, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [rare_grams(np.frombuffer(x, np.uint64), counts, percent) for x in part.column("grams").to_pylist()]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.repeat(part.column("cls").to_numpy(), [len(x) for x in found]))], names=["sig", "cls"])

    return sets.select("cls", "grams").mapInArrow(run, "sig long, cls long")


def crowd_edges(docs: DataFrame, sets: DataFrame, crowd: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): edges that join all similar classes among those of large buckets. crowd: u, the low halves of their digests."""
    n_crowd = crowd.count()
    if not n_crowd:
        return crowd.select("u", F.col("u").alias("v"))
    of_crowd = join_bounded(sets.filter("n_shingles > 0"), crowd.withColumnRenamed("u", "key_lo"), ["key_lo"], "left_semi", n_crowd)
    chosen = scratch(of_crowd.groupBy("key_lo", "key_hi").agg(F.min("doc_id").alias("chosen")).select("chosen").distinct(), "chosen")
    brought = shingle_sets(bringing(docs, chosen, n_crowd), words, True).filter("n_shingles > 0")
    grams = scratch(brought.select(F.col("key_lo").alias("cls"), "grams"), "grams")
    rows = rare_rows(grams, gram_counts(grams), percent).repartition("sig").sortWithinPartitions("sig", "cls")
    met = scratch(bucket_pairs(rows), "rare")
    scratch.drop("grams", "chosen")
    likely = likely_pairs(sets, met.filter("v is not null").select("u", "v").distinct(), percent)
    return likely.union(bucket_forests(sets, met.filter("v is null").select("sig", "u"), percent, scratch))


def bringing(docs: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """The documents whose ids are in chosen, null among them; rows bounds how many these are."""
    return join_bounded(docs, chosen, docs["doc_id"].cast("long").eqNullSafe(F.col("chosen")), "left_semi", rows)


def link_labels(linked: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric boolean matrix with a true diagonal."""
    labels = np.arange(len(linked), dtype=np.int32)
    while True:
        least = np.where(linked, labels[None, :], np.int32(len(linked))).min(axis=1)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs with 100 * intersection >= percent * union."""
    n, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    shared = np.zeros((n, n), np.float64 if sizes.sum() >= 1 << 24 else np.float32)
    if n <= SMALL_GROUP:
        for i in range(n):
            for j in range(i + 1, n):
                if 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        new = np.cumsum(times > 1) - 1  # n-grams of one set alone share nothing
        keep = times[column] > 1
        owner, column = owner[keep], new[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            body = np.zeros((n, COLUMNS), shared.dtype)
            body[owner[a:b], column[a:b] - first] = 1
            shared += body @ body.T
    both = sizes[:, None] + sizes[None, :] - shared
    linked = 100 * shared >= percent * both
    np.fill_diagonal(linked, True)
    return linked


def verify_groups(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v, links): for each class of a candidate group, a component root in each block pair and the documents it links to
    there. classes: comp, cls, n_docs, n_shingles, grams, key_lo, key_hi, in sorted buckets of these two.

    Classes are dealt to block pairs without their n-grams, which join them in rounds: the block pairs of one hold about as
    many n-grams as the classes do, however large groups are, and its shuffle files go before the next."""
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_GRAMS)).cast("int")
    places = scratch(in_blocks(classes.drop("grams"), "comp", "cls", "n_shingles", n_blocks, percent, scratch), "places")
    scratch.drop("whole", "blocks")
    n_met, n_own = (rows.agg(F.sum("n_shingles")).first()[0] or 0 for rows in (places, classes))
    rounds = max(1, -(-n_met // max(ROUND_GRAMS, n_own)))

    def compare(group: pa.Table) -> pa.Table:
        block = group.column("band").to_numpy().astype(np.int64) << 32 | group.column("block").to_numpy()
        ids, docs = group.column("cls").to_numpy(), group.column("n_docs").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        linked = linked_pairs(sets, percent)
        crossing = group.column("p")[0].as_py() != group.column("q")[0].as_py()
        counted = linked & (block[:, None] != block[None, :]) if crossing else linked
        links = counted.astype(np.int64) @ docs
        return pa.table({"u": ids, "v": ids[link_labels(linked)], "links": links})

    out = []
    for k in range(rounds):
        mine = places.filter(F.pmod(F.xxhash64("comp", "p", "q"), F.lit(rounds)) == k) if rounds > 1 else places
        met = mine.join(classes.select("key_lo", "key_hi", "grams"), ["key_lo", "key_hi"])
        found = met.select("comp", "p", "q", "band", "block", "cls", "n_docs", "grams").groupBy("comp", "p", "q").applyInArrow(compare, "u long, v long, links long")
        out.append(scratch(found, f"verified-{k}"))
    scratch.drop("places")
    return reduce(DataFrame.union, out)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their n-gram sets; component_id is the smallest doc_id that
    links reach, n_links counts the other documents it links to directly. A null or empty text has an empty set, no links
    and its own id; a null doc_id takes part with its text but is never a component's id; repeated rows are copies of each
    other; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    sets = scratch(shingle_sets(docs, words, False, True), "sets")
    sigs = signature_rows(docs, words, percent).repartition("sig").sortWithinPartitions("sig", "cls")
    met = scratch(bucket_pairs(sigs), "met")
    likely = likely_pairs(sets, met.filter("v is not null").select("u", "v").distinct(), percent)
    crowd = scratch(met.filter("v is null").select("u").distinct(), "crowd")
    edges = likely.union(crowd_edges(docs, sets, crowd, words, percent, scratch))
    groups = scratch(connected_components(edges, scratch).select(F.col("node").alias("key_lo"), F.col("component").alias("comp")), "groups")
    scratch.drop("met", "cc", "crowd", "rare", "whole", "blocks")
    n_grouped = groups.count()
    # one document of each class in a group brings its n-grams
    classes = scratch(
        join_bounded(sets.filter("n_shingles > 0").drop("sketch"), groups, ["key_lo"], "inner", n_grouped)
        .groupBy("key_lo", "key_hi", "comp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs")),
        "classes",
    )
    chosen = bringing(docs, classes.select(F.col("doc_id").alias("chosen")).distinct(), n_grouped)
    brought = shingle_sets(chosen, words, True).groupBy("key_lo", "key_hi").agg(F.first("grams").alias("grams"), F.first("n_shingles").alias("n_shingles"))
    # a class is named by a number of its own: the digest's halves could clash one by one
    named = classes.drop("doc_id").join(brought, ["key_lo", "key_hi"]).withColumn("cls", F.xxhash64("key_lo", "key_hi"))
    named = scratch.bucketed(named.select("comp", "cls", "n_docs", "n_shingles", "grams", "key_lo", "key_hi"), "named", ["key_lo", "key_hi"])
    verified = verify_groups(named, percent, scratch)
    scratch.drop("named", "groups")
    component = connected_components(verified.select("u", "v"), scratch)
    links = verified.groupBy(F.col("u").alias("cls")).agg((F.sum("links") - 1).alias("n_links"))
    keyed = classes.select("key_lo", "key_hi", F.xxhash64("key_lo", "key_hi").alias("cls"), F.col("doc_id").alias("class_doc"))
    found = keyed.join(component.withColumnRenamed("node", "cls"), "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    found = scratch(found, "found")
    scratch.drop(*(x for x in list(scratch.tables) if x.startswith("verified-")), "cc", "classes")
    least = found.groupBy("component").agg(F.min("class_doc").alias("group_doc"))
    found = found.join(least, "component").select("key_lo", "key_hi", "group_doc", "n_links")
    # classes outside the groups: copies of each other and nothing else
    alone = sets.filter("n_shingles > 0").groupBy("key_lo", "key_hi").agg(F.min("doc_id").alias("copy_doc"), F.count("*").alias("copies"))
    known = alone.join(found, ["key_lo", "key_hi"], "left")
    known = known.select("key_lo", "key_hi", F.coalesce("group_doc", "copy_doc").alias("component_doc"), F.coalesce("n_links", F.col("copies") - 1).alias("known_links"))
    known = scratch(known, "known")  # so that both sides of the last join can be split where one class has many copies
    out = sets.join(known, ["key_lo", "key_hi"], "left")
    empty = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_doc")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("known_links")).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that link to, or copy, a document of smaller id in their component; with the columns of docs.

    Rows with null ids stay. Of repeated rows with one id and text one stays.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch(jaccard_components(docs, words, percent).filter("doc_id is not null").select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("goes")), "judged")
    n_gone = judged.filter("goes").count()
    marked = unused(docs, "marked_id")
    gone = judged.filter("goes").select(F.col("doc_id").alias(marked))
    stays = join_bounded(docs, gone, docs["doc_id"].cast("long") == F.col(marked), "left_anti", n_gone)
    # only ids that occur again can be repeated rows; the others' texts are not shuffled
    again = scratch(judged.filter("not goes").groupBy(F.col("doc_id").alias(marked)).count().filter("count > 1").select(marked), "again")
    n_again = again.count()
    if not n_again:
        return stays
    on = stays["doc_id"].cast("long") == F.col(marked)
    once = join_bounded(stays, again, on, "left_anti", n_again)
    return once.unionByName(join_bounded(stays, again, on, "left_semi", n_again).dropDuplicates(["doc_id", "text"]))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)

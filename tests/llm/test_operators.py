"""Each operator against a brute-force version, on a small fixture with nulls, empty and long texts, ties, repeated rows and
columns whose names clash."""

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyvane.llm import audio, jaccard, mixing, packing, pii, scoring, sharding, substring, topk, toxicity
from tallyvane.sources.staging import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, ids string, position int, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def make_docs():
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(120)]
    texts = [" ".join(base)]
    for k in range(12):  # near copies, each with one more word changed than the one before
        near = base[:]
        for j in range(k % 4 + 1):
            near[rng.randrange(len(near))] = f"edit{k}x{j}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 5 + ["", "one", "one two", "ONE  two", "é ß Ünï 東京 😀", "\t\n ", "word " * 3000, "x" * 5000]
    texts += ["mail a.b@c.de, card 4111 1111 1111 1111 ip 10.0.0.1 call +49 30 1234567", "1.2.3.4.5.6.7.8 a@b.com_x@c.org 999.1.1.1", "IBAN GB82 WEST 1234 5698 7654 32"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = [(i, t, "en", ["a", "b", None][i % 3] if i % 7 else "hot") for i, t in enumerate(texts)]
    rows += [(200, None, None, None), (201, None, "en", "a"), (None, texts[0], "en", "b"), (202, "tail " + texts[3], "en", "z")]
    rows += [rows[30]] * 3
    return [(i, t, g, s, None, -1, 0.5, "clash", 9, "clash") for i, t, g, s in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- packing


def test_packing_round_trip(docs, rows, nothing):
    pieces = packing.pack(docs, sequence=64).toPandas()
    tokenizer = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    wanted = collections.Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    by = collections.defaultdict(list)
    for p in pieces.to_dict("records"):
        by[p["doc_id"] if p["doc_id"] == p["doc_id"] else None].append(p)
    for key in {k for k, _ in wanted}:
        copies = sum(n for (k, _), n in wanted.items() if k == key)
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(by[key], key=lambda p: p["start"])])
        for (_, text), n in ((x, n) for x, n in wanted.items() if x[0] == key):
            assert sorted(ids.tolist()) == sorted(text * n) and n == copies
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"]).tolist()[:-1]] and group["length"].sum() <= 64
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("texts", [[None], ["", ""], ["   "], [None, "", "\t\n"]])
def test_packing_of_blank_texts_alone(spark, texts):
    """A slice of texts without a single id: each is a document of one token."""
    got = packing.piece_digests(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert all((r["start"], r["length"], r["doc_tokens"]) == (0, 1, 1) and r["ids_crc32"] == zlib.crc32(struct.pack("<I", packing.END_ID)) for r in got)


def test_packing_puts_copies_together(docs, rows):
    keys = {r["doc_id"]: r["curve_key"] for r in packing.pack(docs).select("doc_id", "curve_key").collect()}
    assert keys[0] == keys[13] == keys[17]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_word_tokenizer_equals_the_whole(text):
    words = packing._tokenizer(packing.default_tokenizer())
    texts = [text, None, "", text + " plain Über <|endoftext|> don't", "x" * 50 + text]
    ids, lengths = words.encode(pa.array(texts, pa.string()))
    wanted = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == wanted


def test_tokenizer_on_long_and_foreign_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_RUNS", 20)
    monkeypatch.setattr(packing, "KEPT", 5)
    words = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["naïve", "東京", "𝛼", "re-do", "a'll", "ÀÉ", "x\x0by", "\u00a0", "e\u0301", "123"]) + str(rng.randrange(99)) for _ in range(20_000)), "z" * 30_000]
    ids, lengths = words.encode(pa.array(texts))
    wanted = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == wanted


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "", "c", "y" * 9])], names=["text"])
    parts = [x.column("text").to_pylist() for x in packing.slices(batch, "text", 10)]
    assert [x for p in parts for x in p] == batch.column("text").to_pylist() and len(parts) > 2


def test_hilbert_curve_is_one_path():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((d * 2 - 9 * (d > 4)) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def found_spans(frame):
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return [(r["text"], r["s"].split(",") if r["s"] else []) for r in pii.find_spans(frame).select("text", pii._joined(base).alias("s")).collect()]


def test_pii_base_spans(docs, nothing):
    assert all(s == plain_spans(t) for t, s in found_spans(docs))
    assert pii.find_spans(nothing).count() == 0


def test_pii_random_texts(spark):
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", " ", "-", "+", "4111111111111111", "1", "25", "256", "(", ")", "_x", "😀", "é", "+1 555 123 4567", "10.0.0.1", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(30)) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(s == plain_spans(t) for t, s in found_spans(frame))


def test_pii_many_matches_are_placed(spark):
    frame = spark.createDataFrame([("1.2.3.4 " * 1000,)], "text string")
    assert all(s == plain_spans(t) for t, s in found_spans(frame))


def test_pii_added_kinds_and_redaction(spark):
    frame = spark.createDataFrame([("my iban GB82 WEST 1234 5698 7654 32", 1), ("GB82 WEST 1234 5698 7654 33", 2), ("ssn 123-45-6789", 3), ("part 123-45-6789", 4), (None, 5), ("é a@b.cd 😀", 6)], "text string, k int")
    assert [r["text"] for r in pii.redact(frame).orderBy("k").collect()] == ["my iban [iban]", "GB82 WEST 1234 5698 7654 33", "ssn [ssn]", "part 123-45-6789", None, "é [email] 😀"]
    assert pii.redact(frame).columns == ["text", "k"]


def plain_ibans(text):
    out, at = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
        good = []
        for end in range(m.end(), min(len(text), m.start() + 67) + 1):
            piece = text[m.start() : end]
            packed = piece.replace(" ", "")
            if not re.fullmatch(r"[A-Z0-9]+(?: [A-Z0-9]+)*", piece) or re.match("[A-Za-z0-9]", text[end : end + 1]) or not 15 <= len(packed) <= 34:
                continue
            if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
                good.append((f"{packed[:2]}{len(packed)}" in pii.IBAN_LENGTHS, len(packed), end))
        if good and m.start() >= at:
            at = max(good)[2]
            out.append((m.start(), at))
    return out


def test_pii_account_numbers_before_other_words(spark):
    number = "GB82 WEST 1234 5698 7654 32"
    texts = [f"iban {number}{x}" for x in (" Please pay", " OK", " 2024-01-01", " DE89 3704 0044 0532 0130 00 A", "OK", ", NO93 8601 1117 947 X", " " + "A1B2 " * 9)]
    rng = random.Random(4)
    parts = [number, "GB82WEST12345698765432", "NO9386011117947", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", " ", " ", " ", "  ", "OK", "Ok", "2024", "-", "\U0001f600", "AB12", "AB12 CD34"]
    texts += ["".join(rng.choice(parts) for _ in range(14)) for _ in range(300)] + ["AB12 " * 3000]
    got = pii.find_spans(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in got:
        assert [(x["start"], x["end"]) for x in r["pii"] if x["kind"] == "iban"] == plain_ibans(r["text"]), r["text"]
    assert [len(plain_ibans(t)) for t in texts[:7]] == [1, 1, 1, 2, 0, 2, 1]


# --- mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_copies(docs, rows, nothing):
    got = mixing.plan_mix(docs.select("doc_id", "source", "text")).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["target"] == pytest.approx(target[r["source"]]) and math.floor(rate) <= r["copies"] <= min(3, math.floor(rate) + 1)
    again = mixing.plan_mix(docs.select("doc_id", "source", "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(nothing).count() == 0


CLASHING = "doc_id long, text string, source string, size int, source_size string, target string, copies long, copy_no string, target_source string, row int, body string, pii string, _all string, _m_email string, toxicity string"


def test_no_column_of_the_corpus_is_lost_or_changed(spark):
    rows = [(i, t, "s", -1, "b", "t", -7, "keep", "u", i, "body", "pii", "all", "m", "x") for i, t in enumerate(["hello there", None, "", "plain words"])]
    frame = spark.createDataFrame(rows, CLASHING)
    for done in (mixing.mix(frame), pii.redact(frame), toxicity.drop_toxic(frame, toxicity.fit([], []))):
        assert done.schema.names == frame.schema.names and sorted(map(tuple, done.collect())) == rows
    found = pii.find_spans(frame, spans="copies").collect()
    assert sorted(tuple(r)[:6] for r in found) == [r[:6] for r in rows] and all(r["copies"] == [] and r["_all"] == "all" for r in found)


def test_mixing_comes_near_its_targets(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("source"), F.lit("w x y z").alias("text"))
    for r in mixing.plan_mix(frame).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("target")).collect():
        assert r["t"] == pytest.approx(r["target"], rel=0.06)


# --- top k


@pytest.mark.parametrize("rows,asked", [(4096, 512), (37, 2)])
def test_topk_equals_brute_force(spark, monkeypatch, rows, asked):
    monkeypatch.setattr(topk, "BLOCK_ROWS", rows)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", asked)
    monkeypatch.setattr(topk, "MEET_ROWS", 3 if rows < 100 else 4)
    monkeypatch.setattr(topk, "MEET_QUERIES", 2)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, []), (None, vectors[0][1]), (306, vectors[1][1])]
    vectors += [(400, [9e4, -7e4]), (401, [1.0, 2.0]), (402, [0.5, 0.5])] + [vectors[50]] * 2 + [vectors[7]] * 2
    frame = spark.createDataFrame([(i, v, 1, "x", 0, 2) for i, v in vectors], "vec_id long, embedding array<float>, dims int, block string, q int, v int")
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    copies = collections.Counter(i for i, _ in vectors)
    for q in (i for i in usable if i % 50 == 0):
        scores = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]) for _ in range(copies[i]))[:5]
        assert got.pop(q) == [(i, -s) for s, i in scores]
    assert not got
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_rows_are_dealt_alike_when_a_task_is_redone(spark):
    """The block of a row hangs on its content and its staged place alone, not on the order in which rows arrive."""
    frame = spark.createDataFrame([(i % 40, [float(i % 7), 1.0], i) for i in range(200)], "vec_id long, v array<double>, place long")
    scratch = Scratch(spark)
    members = []
    for k, rows in enumerate((frame.repartition(3), frame.orderBy(F.desc("place")).repartition(5))):
        blocks = topk._blocks(rows, 37, scratch, f"blocks-{k}").collect()
        members.append({r["block"]: sorted(topk._unpacked(r["ids"]).tolist()) for r in blocks})
    assert members[0] == members[1] and len(members[0]) > 3
    scratch.close()


def test_impact_index_never_loses_a_member():
    rng = np.random.default_rng(4)
    for scale in (1, 30, 10_000):
        values = rng.integers(-scale, scale + 1, (700, 12))
        index = topk.ImpactIndex(np.arange(700), values)
        for q in range(25):
            ids, scores = topk.best_of(*index.search(values[q], q, 5, None), 5)
            every = values @ values[q]
            wanted = sorted((-int(s), i) for i, s in enumerate(every) if i != q)[:5]
            assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(i, -s) for s, i in wanted]


# --- Jaccard


def plain_components(rows, n, percent):
    sets = []
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")
        w = words_of(w)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[find(i)], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(docs, rows, nothing, n, percent):
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(docs, n, percent).collect())
    assert got == plain_components(rows, n, percent)
    if n == 3:
        assert jaccard.jaccard_components(nothing, n, percent).count() == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(5)
    scheme = jaccard.PartEnum(percent)
    for _ in range(300):
        size = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        edits = int(rng.integers(0, size // 8 + 1))
        b = np.unique(np.concatenate([a[: len(a) - edits], rng.integers(0, 1 << 63, int(rng.integers(0, edits + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_no_similar_sets_of_any_size_miss_each_other():
    rng = np.random.default_rng(8)
    scheme = jaccard.PartEnum(80)
    missed = []
    for size in [25] * 4000 + [286] * 2500:  # the smaller set lies in the band below, so that they share one band only
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.sort(rng.permutation(a)[: -(-size * 80 // 100)])  # at the limit of similarity
        if not len(np.intersect1d(scheme.signatures(a), scheme.signatures(b))):
            missed.append(size)
    assert not missed


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(9)
    for size in (1, 5, 200, 255, 256, 300, 1000, 3000):
        for share in (1.0, 0.9, 0.8, 0.4, 0.0):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + size // 9)), dtype=np.uint64)]))
            assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_buckets_over_batches(spark):
    small, large = jaccard.SMALL_BUCKET, jaccard.SMALL_BUCKET + 40
    buckets = {1: 1, 2: 2, 3: small, 4: small + 1, 5: large, 6: 3}
    rows = [(s, 100 * s + c) for s, n in buckets.items() for c in range(n) for _ in range(2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        met = jaccard.bucket_pairs(spark.createDataFrame(rows, "sig long, cls long").coalesce(1).sortWithinPartitions("sig", "cls")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {(s, 100 * s + c, 100 * s + d) for s, n in buckets.items() if n <= small for c in range(n) for d in range(c)}
    wanted |= {(s, 100 * s + c, None) for s, n in buckets.items() if n > small for c in range(n)}
    assert {tuple(r) for r in met} == wanted and len(met) == len(wanted)


def test_sketches_in_blocks_equal_those_in_pairs():
    rng = np.random.default_rng(10)
    base = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[: int(n)][rng.random(int(n)) < keep], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)])) for n in (5, 150, 250, 300, 600, 900) for keep in (0.5, 0.9, 0.95, 1.0)]
    sizes, sketches = np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets]
    got = jaccard.may_link(sizes, sketches, 80)
    for i in range(len(sets)):
        for j in range(len(sets)):
            fits = 180 * jaccard.least_difference(sketches[i], sketches[j]) <= 20 * (sizes[i] + sizes[j])
            assert got[i, j] == (i == j or bool(fits and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])))


def test_long_near_copies_in_many_blocks_equal_brute_force(spark, monkeypatch):
    """Sets of 500 to 2,000 n-grams around a similarity of 0.8, a large bucket of them, a passage in common, small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 9_000)
    rng = np.random.default_rng(11)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, texts = new(300), []
    for size in (500, 900, 2000):
        base = new(size)
        for share in (1.0, 0.93, 0.9, 0.89, 0.88, 0.8):  # words of the base that a copy keeps at its front
            texts += [base[: int(size * share)] + new(size - int(size * share)) for _ in range(2)]
    base = new(510)
    texts += [base + new(k) for k in range(20)] + [passage + new(310) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    assert got == plain_components(rows, 5, 80)


@pytest.mark.parametrize("percent", [90, 80])
def test_similar_sets_share_a_rare_gram_whatever_the_counts(percent):
    rng = np.random.default_rng(12)
    for cells in (1, 50, 10**6):  # all counts alike, many ties, none
        counts = rng.integers(0, cells, jaccard.CELLS)
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.85, 0.95, 1.0])], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 8)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.rare_grams(a, counts, percent), jaccard.rare_grams(b, counts, percent)))


def test_texts_that_share_a_passage_do_not_meet_by_it(spark):
    """20,000 texts, half of each a licence: rows that meet stay near the number of texts, and near copies are found."""
    rng = np.random.default_rng(13)
    passage, n = " ".join(f"licence{i}" for i in range(60)), 20_000
    own = [" ".join(x) for x in np.char.add("w", rng.integers(0, 10**9, (n, 60)).astype(str))]
    rows = [(i, f"{passage} {x}") for i, x in enumerate(own)] + [(n + i, f"{passage} {x} more") for i, x in enumerate(own[:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch = Scratch(spark)
    sets = scratch(jaccard.shingle_sets(docs, 5, True), "sets").withColumnRenamed("key_lo", "cls")
    counts = jaccard.gram_counts(sets)
    met = jaccard.bucket_pairs(jaccard.rare_rows(sets, counts, 80).repartition("sig").sortWithinPartitions("sig", "cls"))
    assert counts.sum() == sets.agg(F.sum("n_shingles")).first()[0]
    assert met.count() < 2 * n and met.filter("v is null").isEmpty()
    scratch.close()
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(docs, 5, 80).collect()}
    assert got == {i: (i % n, int(i % n < 300)) for i, _ in rows}


def test_members_of_a_bucket_meet_where_sizes_allow(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    sizes = [int(100 * 1.3**k) for k in range(12) for _ in range(6)] + [5, 6]
    rows = [(1, i, n) for i, n in enumerate(sizes)] + [(2, 1000, 9), (2, 1001, 900)]
    scratch = Scratch(spark)
    n_blocks = F.ceil(F.count("*") / 4).cast("int")
    met = jaccard.in_blocks(spark.createDataFrame(rows, "sig long, u long, n_u long"), "sig", "u", "n_u", n_blocks, 80, scratch).collect()
    scratch.close()
    groups = collections.defaultdict(set)
    for r in met:
        assert r["u"] not in groups[r["sig"], r["p"], r["q"]]
        groups[r["sig"], r["p"], r["q"]].add(r["u"])
    together = {(a, b) for ids in groups.values() for a in ids for b in ids if a < b}
    assert {(i, j) for i, a in enumerate(sizes) for j, b in enumerate(sizes) if i < j and 100 * min(a, b) >= 80 * max(a, b)} <= together
    assert (1000, 1001) in together and (0, 70) not in together and len(met) < 8 * len(rows)


def test_near_copies_keep_every_column(spark):
    rows = [(1, "a b c d e f", "x", 7, "k"), (2, "a b c d e f", "y", 8, "k"), (3, "other words here", "z", 9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, marked_id string, component_id long, goes string")
    assert sorted(tuple(r) for r in jaccard.drop_near_duplicates(frame).collect()) == [rows[0], rows[2]]


def test_linked_pairs_of_large_groups_equal_small_ones():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)])) for _ in range(40)]
    got = jaccard.linked_pairs(sets, 90)
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (i == j or 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both))


def test_drop_near_duplicates_keeps_one(spark):
    long = " ".join(f"w{i}" for i in range(100))
    frame = spark.createDataFrame([(3, long), (1, long), (2, long + " more"), (4, "other text here"), (5, None), (6, ""), (None, "x")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in jaccard.drop_near_duplicates(frame).collect()) == ["1", "4", "5", "6", "None"]


# --- language model


@pytest.mark.parametrize("order,block", [(2, 1_000_000), (2, 700), (3, 700), (1, 10**6)])
def test_scoring_equals_brute_force(docs, rows, nothing, monkeypatch, order, block):
    monkeypatch.setattr(scoring, "BLOCK_WORDS", block)
    monkeypatch.setattr(scoring, "TABLE_GRAMS", block)
    got = collections.Counter((r["doc_id"], r["n_words"], round(r["log_score"], 6), r["n_backoff"]) for r in scoring.score_documents(docs, order).collect())
    cut = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    grams = lambda x: collections.Counter(tuple(x[i : i + k]) for k in range(1, order + 1) for i in range(len(x) - k + 1))
    every = sum((grams(x) for _, x in cut), collections.Counter())
    total, wanted = sum(len(x) for _, x in cut), collections.Counter()
    for key, x in cut:
        own, score, backed = grams(x), 0.0, 0
        left = lambda g: every[g] - own[g]  # noqa: B023, E731
        for i in range(len(x)):
            factor, at = 1.0, order
            while at > 1 and (i < at - 1 or left(tuple(x[i - at + 1 : i + 1])) <= 0):
                factor, at = factor * 0.4, at - 1
            backed += order == 1 or at < order
            if at > 1:
                score += math.log(factor * left(tuple(x[i - at + 1 : i + 1])) / left(tuple(x[i - at + 1 : i])))
            else:
                score += math.log(factor * max(1, left((x[i],))) / max(1, total - len(x)))
        wanted[key, len(x), round(score, 6), backed] += 1
    assert got == wanted
    assert order != 3 or scoring.score_documents(nothing).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50, unique=True))
def test_sorted_packing(values):
    x = np.array(sorted(values), np.uint64)
    assert (scoring.unpack_sorted(scoring.pack_sorted(x)) == x).all()


# --- toxicity


def test_worst_windows_and_word_scores_equal_plain_ones():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 1, 2, 3, 4, 50, 0, 7])
    scores = rng.normal(size=int(lengths.sum()))
    best, at = toxicity.worst_windows(scores, lengths)
    begin = 0
    for k, n in enumerate(lengths.tolist()):
        x, w = scores[begin : begin + n], min(n, toxicity.WINDOW)
        means = [x[i : i + w].mean() for i in range(n - w + 1)] if n else [0.0]
        assert best[k] == pytest.approx(max(means)) and at[k] - begin == (int(np.argmax(means)) if n else 0)
        begin += n
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS))
    for word in ("a", "abc", "über", "東京", "x" * 40):
        raw = b"<" + word.encode() + b">"
        _, alone = toxicity.subwords([word])
        _, among = toxicity.subwords(["other", word, "more"])
        owner, _ = toxicity.subwords(["other", word, "more"])
        assert sorted(alone.tolist()) == sorted(among[owner == 1].tolist())
        assert len(alone) == 1 + sum(max(0, len(raw) - n + 1) for n in toxicity.NGRAMS)
        assert model.word_scores([word])[0] == pytest.approx(model.weights[alone].mean())


def test_scores_of_documents_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 2.0, -1.0)
    texts = ["one two three four five", "", None, "Ünï x", "word " * 25_000 + "bad"] + [" ".join(rng.choice(WORDS, 30)) for _ in range(20)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        x = [model.weights[toxicity.subwords([w])[1]].mean() for w in words]
        w = min(len(x), 3)
        worst = max((float(np.mean(x[k : k + w])) for k in range(len(x) - w + 1)), default=0.0) if x else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(2.0 * worst - 1.0))))


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(7)
    clean = ["river", "stone", "window", "garden", "paper", "music", "market", "winter", "bottle", "silver"]
    bad = ["horrible", "wretched", "nasty"]
    texts, labels = [], []
    for k in range(600):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        labels.append(int(k % 4 == 0))
        if labels[-1]:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
    model = toxicity.fit(texts, labels)
    frame = spark.createDataFrame([("river stone " * 400 + "horrible",), ("river stone " * 400,), ("you horrrible window",), (None,), ("",)], "text string")
    scores = [r["score"] for r in toxicity.score_documents(frame, model).collect()]
    assert scores[0] > 0.5 > scores[1] and scores[2] > scores[1] and scores[3] == scores[4] < 0.5
    kept = toxicity.drop_toxic(frame, model)
    assert kept.count() == 4 - (scores[2] >= 0.5) and kept.columns == ["text"]


def test_toxicity_without_labels(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    scored = toxicity.score_documents(docs, model)
    assert scored.filter("score >= 0.5 or score is null").count() == 0 and scored.count() == docs.count()
    assert toxicity.score_documents(nothing, model).count() == 0


def test_held_out_rows_are_never_learned(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, _, _ = toxicity.training_sample(docs, labels)
    assert texts and all(zlib.crc32(t[1:].encode()) % 5 for t in texts)


# --- substring deduplication


def plain_cut(rows):
    cut = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for key, x in cut:
        for p in range(len(x) - 49):
            if key is not None:
                w = tuple(x[p : p + 50])
                first[w] = min(first.get(w, key), key)
    out = collections.Counter()
    for key, x in cut:
        gone = set()
        for p in range(len(x) - 49):
            if key is not None and first[tuple(x[p : p + 50])] < key:
                gone.update(range(p, p + 50))
        out[key, len(x), len(gone), b" ".join(w for i, w in enumerate(x) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("batches,max_runs", [(1, 4), (3, 1), (5, 2)])
def test_substring_equals_brute_force(docs, rows, nothing, batches, max_runs):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring.remove_repeats(docs, batches, max_runs).collect())
    assert got == plain_cut(rows)
    if batches == 1:
        assert substring.remove_repeats(nothing, 2).count() == 0


def test_index_compacts(spark):
    """With one run at most, the third batch meets what the first two were merged into; replaced runs are gone."""
    index = substring.FingerprintIndex(Scratch(spark), max_runs=1)
    for k in range(4):
        run = index.append(spark.createDataFrame([(k, k), (9, k)], "fp long, doc_id long"))
        shared = sorted(tuple(r) for r in index.shared_with(run).collect())
        assert shared == ([(9, i) for i in range(k + 1)] if k else [])
        with index.scratch._settings():
            plans = [index.merged(run, old, "left")._jdf.queryExecution().executedPlan().toString() for _, old in index.runs[:-1]]
        assert len(plans) == min(k, 1) and not any("Exchange" in p or "Sort [" in p for p in plans)
        index.compact()
    assert len(index.runs) == 1 and sorted(tuple(r) for r in index.runs[0][1].collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), (9, 0, 3)]
    assert sum(name.startswith("run-") for name in index.scratch.tables) == 1
    index.scratch.close()


# --- audio


def test_audio_round_trip(docs, rows, nothing):
    got = collections.defaultdict(set)
    for r in audio.audio_features(audio.store_audio(docs)).collect():
        got[r["doc_id"]].add((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], bytes(r["media"]), bytes(r["tensors"])))
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        (found,) = got[r[0]]
        assert found[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) and audio.from_wav(found[4])[1] == payload
        spans = audio.from_tensors(found[5])
        assert spans.schema.field("log_mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS] and spans["end_s"][0].as_py() > spans["begin_s"][0].as_py()
    assert got[0] == got[13]
    assert audio.audio_features(audio.store_audio(nothing)).count() == 0


def test_log_mel_equals_plain_sums_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", audio.HOP * audio.DOWN * 3)
    payload = bytes(np.random.default_rng(1).integers(0, 256, 9 * 576, dtype=np.uint8))
    mel, spans = audio.features_of(payload, audio.RATE)
    rate = audio.RATE * audio.UP // audio.DOWN
    x = audio.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128).astype(np.float64)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    for f in range(len(mel)):
        frame = np.zeros(audio.FRAME)
        part = x[f * audio.HOP : f * audio.HOP + audio.FRAME]
        frame[: len(part)] = part
        turn = np.exp(-2j * math.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
        power = np.abs(turn @ (frame * hann)) ** 2
        for m in range(audio.MELS):
            weights = [max(0.0, min((b * rate / audio.FRAME - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - b * rate / audio.FRAME) / (edges[m + 2] - edges[m + 1]))) for b in range(audio.FRAME // 2 + 1)]
            assert mel[f, m] == pytest.approx(math.log10(float(np.dot(weights, power)) + audio.FLOOR), abs=2e-3)
    assert len(mel) == max(1, -(-max(0, len(x) - audio.FRAME) // audio.HOP) + 1) and (spans[:, 0] < spans[:, 1]).all()
    frame = spark.createDataFrame([(1, "some text " * 200), (2, None)], "doc_id long, text string")
    stored = audio.store_features(audio.store_audio(frame)).collect()
    for r in stored:
        mel = audio.features_of((("some text " * 200).encode() if r["doc_id"] == 1 else b"").ljust(r["payload_bytes"], b"\xff"), audio.RATE)[0]
        flat = np.concatenate([np.asarray(t.as_py()).reshape(-1) for t in audio.from_tensors(bytes(r["tensors"]))["log_mel"].combine_chunks().storage])
        assert np.allclose(flat[: mel.size], mel.reshape(-1)) and r["media_sha256"] == hashlib.sha256(audio.to_wav((("some text " * 200).encode() if r["doc_id"] == 1 else b"").ljust(r["payload_bytes"], b"\xff"))).hexdigest()


def test_resampling_is_a_filtered_signal():
    x = np.random.default_rng(0).normal(size=3000).astype(np.float32)
    taps = audio._phases(audio.UP, audio.DOWN, audio.TAPS)
    h = np.zeros(audio.UP * audio.TAPS)
    for r in range(audio.UP):
        h[r :: audio.UP] = taps[r]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = audio.resample(x)
    assert np.allclose(y, np.convolve(up, h)[: len(up)][:: audio.DOWN][: len(y)], atol=1e-5)


def test_segments_have_hysteresis():
    assert audio.segments(np.array([-2.0, 2.0, 0.0, 0.0, -2.0, 0.0, 2.0])).tolist() == [[1, 4], [6, 7]]


def test_wav_header_is_plain_pcm():
    wav = audio.to_wav(b"\x80" * 4)
    assert wav[:4] == b"RIFF" and struct.unpack_from("<I", wav, 4)[0] == len(wav) - 8
    with pytest.raises(ValueError):
        audio.from_wav(b"nonsense, not a file")


# --- sharding


def test_sharding_balances_and_numbers(docs, rows, nothing):
    got = sharding.shard_documents(docs, 5, 64).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for group in by.values():
        assert sorted(r["position"] for r in group) == list(range(len(group)))
    sizes = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32(r[1].encode()) if r[1] is not None else None) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    totals = [sum(r["size"] for r in g) for g in by.values()]
    assert max(totals) - min(totals) <= max(sum(r["size"] for r in got if r["v_slot"] == s) for s in {r["v_slot"] for r in got})
    assert sharding.shard_documents(nothing).count() == 0


def test_map_edits():
    rng = random.Random(1)
    loads = {k: (rng.randrange(1, 1000), rng.randrange(1, 9)) for k in range(512)}
    first = sharding.first_map(loads, 512, 8)
    grown = sharding.grow(first, loads, 8)
    moved = {a["slot"]: b["shard"] for a, b in zip(first, grown, strict=True) if a["shard"] != b["shard"]}
    assert set(moved.values()) == {8} and grown[0]["version"] == 2
    totals = collections.Counter()
    for r in grown:
        totals[r["shard"]] += r["bytes"]
    assert max(totals.values()) <= 1.02 * min(totals.values())
    skewed = {k: (b * (20 if k < 40 else 1), n) for k, (b, n) in loads.items()}
    again = sharding.rebalance(first, skewed, 8)
    after = collections.Counter()
    for r in again:
        after[r["shard"]] += r["bytes"]
    assert max(after.values()) <= 1.1 * min(after.values()) and sum(a["shard"] != b["shard"] for a, b in zip(first, again, strict=True)) < 100


def test_a_stored_map_is_loaded_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    records = spark.createDataFrame([(i, i % 64, 10 + i % 7) for i in range(1000)], "doc_id long, v_slot int, size long")
    first = sharding.store_map(spark, sharding.first_map(sharding.slot_loads(records), 64, 4), path)
    second = sharding.edit_map(spark, path, 1, sharding.slot_loads(records), 4, more=True)
    a, b = sharding.load_map(spark, path, 1), sharding.load_map(spark, path, 2)
    assert {r["version"] for r in a} == {1} and {r["version"] for r in b} == {2} and [r["slot"] for r in a] == [r["slot"] for r in b] == list(range(64))
    moved = {y["shard"] for x, y in zip(a, b, strict=True) if x["shard"] != y["shard"]}
    assert moved == {4}
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.place(records, m).collect()} for m in (first, second))
    assert all(after[i] in (s, 4) for i, s in before.items()) and set(after.values()) == {0, 1, 2, 3, 4}
    sharding.edit_map(spark, path, 2, sharding.slot_loads(records.union(records.filter("v_slot < 5"))), 5, more=False)
    assert sharding.load_map(spark, path, 3)[0]["version"] == 3
    with pytest.raises(Exception, match="already exists"):
        sharding.store_map(spark, sharding.load_map(spark, path, 2), path)


def test_documents_lie_where_the_second_version_says(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    got = sharding.shard_documents(docs, 5, 64, path).collect()
    second = {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, 2)}
    assert {r["version"] for r in sharding.load_map(spark, path, 1)} == {1} and all(r["version"] == 2 and second[r["v_slot"]] == r["shard"] for r in got)


def test_many_slots_are_rebalanced_soon():
    rng = random.Random(5)
    loads = {k: (int(rng.paretovariate(1.5) * 1000), 3) for k in range(1 << 16)}
    full = [{"version": 1, "slot": k, "shard": 0, "bytes": 0, "n_rows": 0, "first_row": 0} for k in range(1 << 16)]
    began = time.time()
    after = collections.Counter()
    for r in sharding.rebalance(full, loads, 40):
        after[r["shard"]] += r["bytes"]
    assert time.time() - began < 20 and len(after) == 40 and max(after.values()) - min(after.values()) <= max(0.011 * sum(after.values()) / 40, max(b for b, _ in loads.values()))


def test_rows_without_id_and_text_spread(spark):
    frame = spark.createDataFrame([(None, None)] * 200, "doc_id long, text string")
    got = sharding.shard_documents(frame, 4, 64).collect()
    assert len(got) == 200 and len({r["v_slot"] for r in got}) > 20 and {r["text_crc32"] for r in got} == {None}


def test_groups_are_compared_in_rounds(spark, monkeypatch):
    """No round moves more n-grams than the classes have, though each class takes part in many pairs of blocks."""
    for name, value in (("BLOCK_SETS", 4), ("BLOCK_GRAMS", 2_000), ("ROUND_GRAMS", 1)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(40):
        words = base[:]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    staged = []
    write = Scratch.__call__

    def watched(self, df, name, *args, **options):
        staged.append((name, set(df.columns)))
        return write(self, df, name, *args, **options)

    monkeypatch.setattr(Scratch, "__call__", watched)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect())
    sets = [set(jaccard.gram_hashes(t.encode(), 5).tolist()) for _, t in rows]
    links = [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]
    assert got == [(i, len(sets[i]), 0, links[i]) for i in range(40)]
    assert sum(name.startswith("verified-") for name, _ in staged) > 5 and all("grams" not in columns for name, columns in staged if name == "places")

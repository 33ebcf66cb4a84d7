"""Collocations against a plain count, on pieces that repeat, overlap and cross languages."""

import collections
import itertools
import random
import re

import pytest

from tallyvane.llm import collocation

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, m string, piece string, rank double"


def make_rows():
    rng = random.Random(5)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "Éa", "x-y", "😀"]
    texts = ["The cat sat on. the cat; the  cat\tsat\nthe cat sat!"] * 12
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) + rng.choice([".", ", ", "\r\n", "\x0b", " "]) for _ in range(150)]
    texts += ["aa aa aa aa aa aa aa aa aa aa aa aa aa", "", "   ", ".,;", None, "one", "word " * 20_000, "x" * 5000, "a b c\x1cd " * 11]
    rows = [(i, t, [None, "und", "en", "de"][i % 4] if i % 5 else "en") for i, t in enumerate(texts)]
    rows += [rows[0]] * 3 + [(None, "the cat sat on the mat " * 30, "en")]
    return [(i, t, g, "clash", -1, "clash", "clash", 0.5) for i, t, g in rows]


def plain(rows, least, longest, cover, top):
    counts, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: f for key, f in counts.items() if f >= least and len(key[1]) > 1}
    most = collections.defaultdict(int)
    for (lang, words), f in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                most[lang, words[i : i + k]] = max(most[lang, words[i : i + k]], f)
    out = []
    for (lang, words), a in found.items():
        cuts = [(collocation.SCALE * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if not (most[lang, words] and 100 * most[lang, words] >= cover * a):
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    ranked = []
    for lang, group in itertools.groupby(sorted(out), key=lambda x: x[0]):
        ranked += [(lang, i, p.decode(), -a, lo, r, n[lang], -s) for i, (_, s, a, p, lo, r) in enumerate(itertools.islice(group, top), 1)]
    return ranked


@pytest.mark.parametrize("settings", [(10, 3, 50, 2000), (2, 4, 80, 7), (1, 2, 50, 50)])
def test_collocations_equal_plain_counts(spark, settings):
    rows = make_rows()
    got = collocation.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), *settings)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, *settings))


def test_collocations_of_nothing(spark):
    assert collocation.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocation.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", 2 * big - 1)], "lang string, phrase string, f long")
    assert collocation.scored(candidates, counts).first()["score"] == collocation.SCALE * big * big // ((big + 1) * (2 * big - 1))


def test_a_task_counts_in_goes(spark, monkeypatch):
    """What one count in duckdb takes is bounded: with too many phrases it would fail for want of memory, disk or not."""
    import pyarrow as pa

    monkeypatch.setattr(collocation, "MEMORY", "20MB")
    monkeypatch.setattr(collocation, "RUN_BYTES", 16 << 20, raising=False)

    def batches():
        for at in range(0, 2_000_000, 20_000):
            phrases = pa.array([f"palabra{i % 997} wort{i} {i * 7919}" for i in range(at, at + 20_000)])
            yield pa.RecordBatch.from_arrays([pa.repeat("es", 20_000), phrases, pa.repeat(pa.scalar(1, pa.int64()), 20_000)], schema=collocation.COUNTS)

    assert sum(sum(b.column("f").to_pylist()) for b in collocation.added_up()(batches())) == 2_000_000


def test_buckets_are_as_many_as_the_bytes_ask_for(spark, monkeypatch):
    from tallyvane.sources.staging import Scratch

    monkeypatch.setattr(collocation, "BUCKET_BYTES", 500, raising=False)
    found = spark.createDataFrame([("en", f"w{i % 50} v{i % 7} u{i}", 3) for i in range(400)], "lang string, piece string, m long")
    ones = collocation.count_ngrams(found, 2, 10, Scratch(spark))[0]
    assert len(ones.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["phrase"]: r["f"] for r in ones.filter("phrase like 'w%'").collect()} == {f"w{i}": 24 for i in range(50)}


def test_hashes_are_of_the_bytes_alone():
    """A string has one hash wherever it stands, or the filter would drop what is frequent."""
    import pyarrow as pa

    rng = random.Random(11)
    strings = ["", "a", "ab", "ba", "é", "😀", "x" * 5000, ""] + ["".join(rng.choice("abé😀") for _ in range(rng.randrange(9))) for _ in range(3000)] + [""]
    hashes = collocation._hashes(pa.array(strings))
    by_string = dict(zip(strings, hashes.tolist(), strict=True))
    assert [by_string[s] for s in strings] == hashes.tolist() and len(set(by_string.values())) == len(by_string)
    assert collocation._hashes(pa.array(strings).slice(1000, 50)).tolist() == hashes[1000:1050].tolist()
    assert collocation._hashes(pa.array(strings), 7).tolist() == hashes.tolist()
    assert not len(collocation._hashes(pa.array([], pa.string()))) and collocation._hashes(pa.array(["", ""])).tolist() == [by_string[""]] * 2


def test_hashing_words_costs_about_what_finding_them_does():
    """Hashes took seven times the CPU of cutting pieces into words, at each level, even where no filter asks for them."""
    import time

    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(12)
    made = [pa.array([" ".join(f"w{rng.randrange(20_000)}" for _ in range(9)) for _ in range(2000)]) for _ in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.repeat("en", 2000), pieces], names=["lang", "piece"]) for pieces in made]

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            for batch in batches:
                run(batch)
            took.append(time.process_time() - began)
        return min(took)

    found = least(lambda batch: pc.split_pattern(batch.column("piece"), " ").flatten().dictionary_encode())
    assert least(lambda batch: collocation.Words(batch).hash) < 5 * found
    assert "hash" not in vars(collocation.Words(batches[0]))

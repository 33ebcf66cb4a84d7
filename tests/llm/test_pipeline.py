"""The corpus pipeline's stages and their chain, on a small fixture, against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvane.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def make_rows():
    rng = random.Random(12)
    texts = []
    for _ in range(6):  # texts of 340 words; copies with a tail at a similarity just above and just below 0.8
        base = [f"w{rng.randrange(10**6)}" for _ in range(340)]
        tail = [f"t{rng.randrange(10**6)}" for _ in range(169)]
        texts += [" ".join(base), " ".join(base + tail[:84]), " ".join(base + tail[84:])]
    texts += ["mail a.b@c.de for it", "iban GB82 WEST 1234 5698 7654 32 Please pay", "short one", "", None]
    return [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain_kept(rows):
    sets = {r[0]: grams(r[1]) for r in rows}
    least = {i: i for i in sets}
    for _ in rows:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    return {i for i, k in least.items() if i == k}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(make_rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_chain_of_stages(spark, folder):
    rows = make_rows()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = STAGES["toxicity"](spark, docs, folder)  # no labels: none is toxic
    assert sorted(r["doc_id"] for r in clean.collect()) == [r[0] for r in rows]
    kept = STAGES["jaccard"](spark, docs, folder)
    ids = plain_kept(rows)
    assert {r["doc_id"] for r in kept.collect()} == ids and len(ids) == 17
    redacted = {r["doc_id"]: r["text"] for r in STAGES["pii"](spark, docs, folder).collect()}
    assert redacted == {r[0]: r[1] for r in rows} | {18: "mail [email] for it", 19: "iban [iban] Please pay"}
    one_source = docs.filter(F.col("doc_id").isin(*ids)).withColumn("source", F.lit("a"))  # its target is its size
    mixed = STAGES["mixing"](spark, one_source, folder)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(ids)


def test_run_packs_what_the_stages_leave(spark, folder):
    ids = plain_kept(make_rows())
    plain = {18: "mail [email] for it", 19: "iban [iban] Please pay"}
    left = spark.createDataFrame([(i, plain.get(i, t), *rest) for i, t, *rest in make_rows() if i in ids], SCHEMA)
    copies = collections.Counter(r["doc_id"] for r in mixing.mix(left).collect())
    tokenizer = packing.WordTokenizer(packing.default_tokenizer()).tokenizer
    texts = {r["doc_id"]: r["text"] or "" for r in left.collect()}
    wanted = {i: n * (len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()}
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == wanted

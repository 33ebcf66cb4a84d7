"""Core queries against their SQL on the smallest tables."""

import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
#: One of each family; the driver compares all of them.
NAMES = (
    "a4_a5_hallucination_chm", "a7_pooled_chm", "a11_auroc", "a12_reliability_bins", "a30_tier_rollup", "a39_a40_threshold_sweep", "w1_w2_spearman", "w10_precision_cliff", "r1_r2_route",
    "ml4_composite", "d2_w6_disjoint_split", "f1_normalise", "f3_f5_match_f1", "f29_distinct_ngrams", "c1_chunks", "c2_sections", "j11_t1_knn", "m4_t3_prune", "m7_d11_consolidate", "stream_sessions",
)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 8) + 0.0 if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            db.sql(f"create view {name[:-8]} as select * from '{FOLDER}/{name}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from tallyvane.plans import catalog

    got = catalog.QUERIES[name](spark, FOLDER)
    wanted = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    order = ", ".join(f'"{c}"' for c in sorted(got.columns))
    theirs = duck.sql(f"select {order} from wanted").fetchall()
    ours = got.select(*sorted(got.columns)).collect()
    key = lambda row: tuple(str(plain(v)) for v in row)
    assert sorted(map(key, ours)) == sorted(map(key, theirs))


def test_labels_have_ascii_word_edges_as_in_the_sql(spark, tmp_path):
    import duckdb

    from tallyvane.plans import catalog

    texts = ["x noñco", "yesíquebo, no laes", "ñyes", "it supportsé", "éno_", "no", "refuteó not enough info", None]
    spark.createDataFrame([(k * 8 + 7, t, "es", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    plain_rows = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = plain_rows(catalog.QUERIES["f9_f11_labels"](spark, str(tmp_path)).collect())
    assert got == plain_rows(db.sql(catalog.ORACLE_SQL["f9_f11_labels"]).fetchall())
    assert got[0][2] == "no" and sum(r[2] in ("yes", "no") for r in got) == 4

"""Corpus, memory, nearest neighbours and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.operators import corpus, entropy, memory
from tallyvane.operators.vector import knn_join, mean_pairwise, threshold_forest
from tallyvane.plans.queries import query
from tallyvane.sources.fixtures import MEMORY_SQL, table
from tallyvane.sources.fixtures import memory as entries_of
from tallyvane.sources.staging import Scratch
from tallyvane.streaming import cycles

ME = f"WITH m AS ({MEMORY_SQL})"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_SP = r"[ \t\n\r\x0b\x0c]+"


_W = lambda x: f"list_filter(regexp_split_to_array({x}, '{_SP}'), lambda x: x <> '')"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


@query("c1_chunks", f"WITH w AS (SELECT doc_id, lang, {_W('text')} AS w FROM documents), c AS (SELECT doc_id, lang, unnest(range(0, (len(w) - 10) // 90 + 1)) AS i, w FROM w WHERE len(w) >= 10) SELECT doc_id, i::INT AS chunk_no, md5(concat(lang, ': ', array_to_string(w[i * 90 + 1:i * 90 + 100], ' '))) AS chunk FROM c")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Word windows, each after a title, which here is the language."""
    return corpus.chunks(table(spark, d, "documents"), ["doc_id"], "text", "lang").withColumn("chunk", F.md5("chunk"))


_SECTIONS = (
    f"p AS (SELECT doc_id, source, string_split({_STRIP('text')}, chr(10) || chr(10)) AS ps FROM documents WHERE len({_W('text')}) >= 20), r AS (SELECT doc_id, source, unnest(range(0, len(ps))) AS section_no, ps FROM p), "
    f"l AS (SELECT doc_id, source, section_no, {_STRIP('ps[section_no + 1]')} AS par FROM r), m AS (SELECT *, string_split(par, chr(10)) AS ls FROM l WHERE par <> ''), f AS (SELECT *, {_STRIP('ls[1]')} AS fl FROM m), "
    f"t AS (SELECT *, len(ls) >= 2 AND len({_W('fl')}) <= 7 AND NOT contains(fl, '.') AS titled FROM f), b AS (SELECT doc_id, source, section_no, CASE WHEN titled THEN fl END AS t, CASE WHEN titled THEN {_STRIP('array_to_string(ls[2:], chr(10))')} ELSE par END AS body FROM t), "
    "c AS (SELECT doc_id, section_no, t, COALESCE(last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), source) AS title, body FROM b), "
    f"kept AS (SELECT doc_id, section_no, title, body FROM c WHERE (t IS NULL OR lower(t) NOT IN ({', '.join(repr(x) for x in corpus.NOISE)})) AND body <> '')"
)


@query("c2_sections", f"WITH {_SECTIONS} SELECT doc_id, section_no::INT AS section_no, title, md5(body) AS body FROM kept")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sections(table(spark, d, "documents"), "doc_id", "text", "source").withColumn("body", F.md5("body"))


@query("c1_c2_passages", f"WITH {_SECTIONS}, w AS (SELECT doc_id, section_no, title, {_W('body')} AS w FROM kept), k AS (SELECT *, unnest(range(0, (len(w) - 10) // 90 + 1)) AS i FROM w WHERE len(w) >= 10) SELECT doc_id, section_no::INT AS section_no, i::INT AS chunk_no, md5(concat(title, CASE WHEN title <> '' THEN ': ' ELSE '' END, array_to_string(w[i * 90 + 1:i * 90 + 100], ' '))) AS chunk FROM k")
def passages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.passages(table(spark, d, "documents"), "doc_id", "text", "source").withColumn("chunk", F.md5("chunk"))


@query("c2_page_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body FROM pages")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(corpus.strip_html(F.col("html"))).alias("body"))


@query("j11_t1_knn", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT('a.embedding', 'b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5")
def knn(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest neighbours of a stated set of query vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn_join(e.filter("id % 50 = 0"), e, 5).withColumn("similarity", F.round("similarity", 6))


@query("p2_novelty", f"{ME}, c AS (SELECT a.entry_id, max({_DOT('a.embedding', 'b.embedding')}) AS best FROM m a JOIN m b ON a.storage_cycle = 5 AND b.storage_cycle < 5 GROUP BY 1) SELECT entry_id FROM c WHERE best <= 0.4e0")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the last cycle that nothing stored before resembles; the limit fits these vectors."""
    m = entries_of(spark, d).select("entry_id", "embedding", "storage_cycle")
    return memory.novel(m.filter("storage_cycle = 5").drop("storage_cycle"), m.filter("storage_cycle < 5"), 0.4).select("entry_id")


_VALUE = "0.7e0 * (0.4e0 * (storage_cycle + 1) / 11 + 0.3e0 * retrieval_count / greatest(max(retrieval_count) OVER (), 1) + 0.2e0 * success_rate + 0.1e0 * u_stored) + 0.3e0 * exp(-0.01e0 * age_s)"


@query("m3_value", f"{ME} SELECT entry_id, round({_VALUE}, 9) AS value FROM m")
def value(spark: SparkSession, d: str) -> DataFrame:
    return memory.with_value(entries_of(spark, d)).select("entry_id", F.round("value", 9).alias("value"))


@query("m4_t3_prune", f"{ME}, v AS (SELECT entry_id, {_VALUE} AS value FROM m), r AS (SELECT entry_id, row_number() OVER (ORDER BY value, entry_id) AS rn, count(*) OVER () AS n FROM v) SELECT entry_id FROM r WHERE rn > greatest(1, floor(n * 0.2e0))")
def prune(spark: SparkSession, d: str) -> DataFrame:
    return memory.prune(entries_of(spark, d)).select("entry_id")


@query("m2_w12_feedback")
def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Entries after the feedback that events stand for: purchases accept, errors reject."""
    m = entries_of(spark, d)
    uses = table(spark, d, "events").filter("event_type in ('purchase', 'error')").select((F.col("user_id") * 3).alias("entry_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("accepted"))
    return memory.feedback(m, uses).select("entry_id", "retrieval_count", F.round("success_rate", 9).alias("success_rate"), F.round("u_stored", 9).alias("u_stored"), "hit_counter")


@query("m6_retroverify", f"{ME}, s AS (SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN NULL ELSE (entry_id % 11) / 10e0 END AS new_u FROM m WHERE entry_id % 2 = 0) SELECT entry_id, CASE WHEN new_u > u_stored THEN new_u ELSE u_stored END AS u_stored, CASE WHEN new_u IS NOT NULL THEN 0 ELSE hit_counter END AS hit_counter, new_u IS NOT NULL OR retroverified AS retroverified FROM m LEFT JOIN s USING (entry_id) WHERE answer <> 'answer 3' AND (new_u IS NULL OR new_u >= 0.5e0)")
def retroverify(spark: SparkSession, d: str) -> DataFrame:
    """New scores may only raise; one answer's chains count as loops."""
    m = entries_of(spark, d)
    k = F.col("entry_id")
    scores = m.filter(k % 2 == 0).select("entry_id", F.when(k % 3 == 0, None).otherwise((k % 11) / 10).alias("new_u"))
    return memory.retroverify(m, scores, loops=F.col("answer") == "answer 3", downgrade=False).select("entry_id", "u_stored", "hit_counter", "retroverified")


@query("m5_remove_update", f"{ME}, v AS (SELECT user_id AS entry_id, avg(value) / 40 - 0.5e0 AS value FROM events GROUP BY 1) SELECT entry_id, round(CASE WHEN value IS NULL THEN u_stored ELSE greatest(0e0, least(1e0, value)) END, 9) AS u_stored FROM m LEFT JOIN v USING (entry_id) WHERE NOT (u_stored < 0.1e0)")
def remove_update(spark: SparkSession, d: str) -> DataFrame:
    """Entries after weak ones are removed and some, unknown ones among them, get scores that may lie beyond [0, 1]."""
    m = entries_of(spark, d)
    values = table(spark, d, "events").groupBy(F.col("user_id").alias("entry_id")).agg((F.avg("value") / 40 - 0.5).alias("value"))
    left = memory.update_scores(memory.remove(m, m.filter("u_stored < 0.1")), values)
    return memory.get(left, m).select("entry_id", F.round("u_stored", 9).alias("u_stored"))


_NEAR = f"""WITH RECURSIVE m AS ({MEMORY_SQL}), s AS (SELECT a.entry_id AS u, b.entry_id AS v, a.pool AS pu, b.pool AS pv, {_DOT('a.embedding', 'b.embedding')} AS sim FROM m a, m b),
 k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rn FROM s), x AS (SELECT u, v, pu, pv FROM k WHERE rn <= 20 AND sim >= 0.35e0 AND u <> v),
 e AS (SELECT u, v FROM x WHERE pu = pv UNION SELECT v, u FROM x WHERE pu = pv), r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u),
 c AS (SELECT node, min(root) AS root FROM r GROUP BY node), j AS (SELECT c.root, m.* FROM c JOIN m ON m.entry_id = c.node),
 g AS (SELECT root, count(*) AS n, arg_max(entry_id, {{'a': u_stored, 'b': -storage_cycle, 'c': -entry_id}}) AS keeper, CASE WHEN count(DISTINCT answer) > 1 THEN 'answer_mismatch' WHEN max(u_stored) - min(u_stored) > 0.15e0 THEN 'u_spread' ELSE 'merged' END AS outcome,
 sum(retrieval_count)::BIGINT AS uses, sum(retrieval_count * success_rate) AS succ, sum(hit_counter)::BIGINT AS hits, bool_or(retroverified) AS flag FROM j GROUP BY root), w AS (SELECT * FROM g WHERE outcome = 'merged')"""
_NAMES = "CASE WHEN merged_names = '' THEN []::VARCHAR[] ELSE string_split(merged_names, ',') END"


@query("m7_audit", f"{_NEAR} SELECT root, entry_id, keeper, n, outcome FROM j JOIN g USING (root) UNION ALL SELECT u, v, NULL, 2, 'cross_pool' FROM x WHERE pu <> pv")
def consolidation_audit(spark: SparkSession, d: str) -> DataFrame:
    """What became of each member of a group of near entries, and of near entries of different pools."""
    return memory.consolidate(entries_of(spark, d), Scratch(spark), near=0.35)[1]


@query("m7_d11_consolidate", f"""{_NEAR}, kp AS (SELECT w.*, j.source_benchmark AS src, {_NAMES} AS l FROM w JOIN j ON j.root = w.root AND j.entry_id = w.keeper),
 o AS (SELECT root, entry_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT j.root, j.entry_id, list_concat([source_benchmark], {_NAMES}) AS l FROM j JOIN w USING (root) WHERE j.entry_id <> w.keeper) q),
 f AS (SELECT root, l[pos] AS name, min({{'a': entry_id, 'b': pos}}) AS first FROM o WHERE l[pos] IS NOT NULL GROUP BY ALL), b AS (SELECT kp.root, list(f.name ORDER BY f.first) AS more FROM f JOIN kp USING (root) WHERE f.name IS DISTINCT FROM kp.src AND NOT list_contains(kp.l, f.name) GROUP BY 1)
 SELECT m.entry_id, COALESCE(uses, retrieval_count) AS retrieval_count, round(COALESCE(CASE WHEN uses > 0 THEN succ / uses END, success_rate), 9) AS success_rate, COALESCE(hits, hit_counter) AS hit_counter, COALESCE(flag, retroverified) AS retroverified,
 array_to_string(CASE WHEN kp.root IS NULL THEN {_NAMES} ELSE list_concat(kp.l, COALESCE(b.more, [])) END, ',') AS benchmarks FROM m LEFT JOIN kp ON kp.keeper = m.entry_id LEFT JOIN b ON b.root = kp.root WHERE m.entry_id NOT IN (SELECT entry_id FROM j JOIN w USING (root) WHERE entry_id <> keeper)""")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Entries after near ones of one pool are merged; the similarity fits these vectors."""
    kept, _ = memory.consolidate(entries_of(spark, d), Scratch(spark), near=0.35)
    return kept.select("entry_id", "retrieval_count", F.round("success_rate", 9).alias("success_rate"), "hit_counter", "retroverified", F.array_join("merged_benchmarks", ",").alias("benchmarks"))


@query("m7_pools", f"{ME}, l AS (SELECT entry_id, list_filter(list_concat([source_benchmark], {_NAMES}), lambda x: x IS NOT NULL) AS l FROM m) SELECT CASE WHEN list_has_any(l, ['truthfulqa', 'strategyqa']) THEN 'transfer' WHEN len(l) > 0 AND list_has_all(['fever', 'triviaqa', 'commonsense_qa'], l) THEN 'training' ELSE 'untagged' END AS pool, count(*) AS n FROM l GROUP BY 1")
def pools(spark: SparkSession, d: str) -> DataFrame:
    """The pool of each entry by all benchmarks that it stands for."""
    return entries_of(spark, d).groupBy(memory.pool_of(F.col("source_benchmark"), F.col("merged_benchmarks")).alias("pool")).agg(F.count("*").alias("n"))


@query("m8_t4_force_queue", f"{ME} SELECT entry_id, hit_counter FROM m WHERE hit_counter >= 10")
def force_queue(spark: SparkSession, d: str) -> DataFrame:
    return memory.force_queue(entries_of(spark, d)).select("entry_id", "hit_counter")


@query("m9_deferred_fifo", f"{ME} SELECT entry_id FROM (SELECT entry_id, row_number() OVER (ORDER BY entry_id DESC) AS rn FROM m) WHERE rn <= 100")
def deferred_fifo(spark: SparkSession, d: str) -> DataFrame:
    m = entries_of(spark, d).select("entry_id")
    return memory.push_deferred(m.filter("entry_id < 300"), m.filter("entry_id >= 300"), "entry_id", 100)


@query("m10_reconsider", f"{ME}, b AS (SELECT entry_id, embedding, (entry_id % 2)::INT AS age FROM m WHERE u_stored >= 0.45e0 AND u_stored < 0.6e0), s AS (SELECT entry_id, success_rate AS new_u, CASE WHEN success_rate >= 0.5e0 THEN 'STORE' ELSE 'DISCARD' END AS new_decision FROM m WHERE hit_counter > 2), o AS (SELECT b.*, CASE WHEN new_decision IS NULL THEN 'kept' WHEN new_decision = 'STORE' AND new_u >= 0.6e0 THEN 'promoted' WHEN age + 1 >= 2 THEN 'dropped' ELSE 'kept' END AS outcome, CASE WHEN new_decision IS NOT NULL AND NOT (new_decision = 'STORE' AND new_u >= 0.6e0) AND age + 1 < 2 THEN age + 1 ELSE age END AS new_age FROM b LEFT JOIN s USING (entry_id)), i AS (SELECT o.entry_id, max({_DOT('o.embedding', 'm.embedding')}) <= 0.4e0 AS inserted FROM o JOIN m ON o.outcome = 'promoted' AND m.u_stored >= 0.6e0 GROUP BY 1) SELECT o.entry_id, outcome, new_age AS age, inserted FROM o LEFT JOIN i USING (entry_id)")
def reconsider(spark: SparkSession, d: str) -> DataFrame:
    """Every deferred entry after its new score; promoted ones are stored unless they resemble what is stored."""
    m = entries_of(spark, d)
    buffer = m.filter("u_stored >= 0.45 and u_stored < 0.6").select("entry_id", "embedding", (F.col("entry_id") % 2).cast("int").alias("age"))
    scores = m.filter("hit_counter > 2").select("entry_id", F.col("success_rate").alias("new_u"), F.when(F.col("success_rate") >= 0.5, "STORE").otherwise("DISCARD").alias("new_decision"))
    done = memory.reconsider(buffer, scores)
    stored = memory.promote(done, m.filter("u_stored >= 0.6").select("entry_id", "embedding"), 0.4).select("entry_id", "inserted")
    return done.select("entry_id", "outcome", "age").join(stored, "entry_id", "left")


@query("m11_summary", f"{ME} SELECT pool, count(*) AS n, round(avg(u_stored), 9) AS mean_u, sum(retrieval_count)::BIGINT AS retrievals FROM m GROUP BY pool")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return entries_of(spark, d).groupBy("pool").agg(F.count("*").alias("n"), F.round(F.avg("u_stored"), 9).alias("mean_u"), F.sum("retrieval_count").alias("retrievals"))


@query("s14_cached_search", f"WITH s AS (SELECT a.vec_id AS query_id, a.label, b.vec_id AS id, {_DOT('a.embedding', 'b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank::INT AS rank, CASE WHEN label < 5 THEN 'cache' ELSE 'live' END AS source FROM r WHERE rank <= 3")
def cached_search(spark: SparkSession, d: str) -> DataFrame:
    """Three passages for each of a stated set of queries: from stored results of five where a question has them, else live."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("question "), F.col("id")).alias("question"), "embedding", "label")
    known = asked.filter("label < 5").select(F.col("query_id").alias("id"), "question", "embedding")
    found = knn_join(known, e, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("r"))
    cache = known.join(found.withColumnRenamed("query_id", "id"), "id").select("question", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"))).alias("results"))
    return memory.cached_search(asked.drop("label"), cache, e, 3).withColumn("similarity", F.round("similarity", 6))


@query("t2_rerank", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, {_DOT('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM s), r AS (SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, id) AS rank FROM k WHERE rn <= 20) SELECT query_id, id, rank::INT AS rank FROM r WHERE rank <= 3")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    """The three of each query's twenty nearest that another score, here the label, puts first."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = knn_join(e.filter("id % 50 = 0"), e, 20).select("query_id", "id").join(e.select("id", "label"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("label"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("query_id", "id", "rank")


@query("v3_mean_similarity", f"WITH p AS (SELECT a.label, {_DOT('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), m AS (SELECT label, avg(s) AS s FROM p GROUP BY label) SELECT label, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0.5e0 ELSE greatest(0e0, least(1e0, max(s))) END, 6) AS s_avg FROM embeddings LEFT JOIN m USING (label) GROUP BY label")
def mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    return mean_pairwise(table(spark, d, "embeddings"), "label", "embedding").withColumn("s_avg", F.round("s_avg", 6))


@query("a29_kernel_entropy")
def kernel_entropies(spark: SparkSession, d: str) -> DataFrame:
    """Kernel entropy of chains, eight vectors a query."""
    chains = table(spark, d, "embeddings").select((F.col("vec_id") / 8).cast("long").alias("query_id"), "embedding")
    return entropy.kernel_entropy(chains, "query_id", "embedding").withColumn("kle", F.round("kle", 9))


_LINKS = f"SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DOT('a.embedding', 'b.embedding')} >= 0.25e0 AND (a.vec_id + b.vec_id) % 5 <> 0"


@query("a28_semantic_entropy", f"WITH RECURSIVE l AS ({_LINKS}), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u), c AS (SELECT node, min(root) AS root FROM r GROUP BY node), k AS (SELECT label, COALESCE(root, vec_id) AS cluster, count(*) AS c FROM embeddings LEFT JOIN c ON node = vec_id GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY label) AS n FROM k) SELECT label, max(n)::BIGINT AS n, count(*) AS clusters, round(abs(sum(-(c / n) * log2(c / n))), 9) AS entropy, round(abs(sum(-(c / n) * log2(c / n))) / log2(max(n)), 9) AS h_norm FROM t GROUP BY label")
def semantic_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each label's vectors over clusters of mutual entailment; near vectors entail, but for some one way only."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", "embedding")
    scratch = Scratch(spark)
    forest = threshold_forest(e, "sample_id", "embedding", 0.25, "label", lambda a, b: (a[:, None] + b[None, :]) % 5 != 0, scratch)
    links = forest.select("u", "v", F.lit(True).alias("forward"), F.lit(True).alias("backward"))
    clustered = entropy.entailment_clusters(e.select("sample_id", "label"), links, scratch)
    return entropy.cluster_entropy(clustered, "label", "cluster").withColumns({"entropy": F.round("entropy", 9), "h_norm": F.round("h_norm", 9)})


@query("k7_upsert_history", "SELECT n_regionkey AS cycle, count(*) AS n, 'new' AS origin FROM nation GROUP BY 1 UNION ALL SELECT r, 0::BIGINT, 'old' FROM range(5, 8) t(r)")
def upsert_history(spark: SparkSession, d: str) -> DataFrame:
    """Records of cycles 0-7 after those of cycles 0-4 are replaced."""
    fresh = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("cycle")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("new"))
    old = spark.range(8).select(F.col("id").alias("cycle"), F.lit(0).cast("long").alias("n"), F.lit("old").alias("origin"))
    return old.join(fresh.select("cycle"), "cycle", "left_anti").unionByName(fresh)


@query("stream_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return cycles.event_windows(table(spark, d, "events"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return cycles.sessions(table(spark, d, "events"))

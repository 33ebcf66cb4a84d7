"""Queries over answers as the verifier takes them: claims, options, entities, heads, negation, facts, aliases, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.functions import answers as A
from tallyvane.functions import confidence as C
from tallyvane.functions import text as T
from tallyvane.operators.entities import alias_overlap, alias_table
from tallyvane.plans.queries import over, query
from tallyvane.plans.texts import _NORM, _WORDS, turns
from tallyvane.sources.fixtures import table

_Q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_IN = lambda values: "(" + ", ".join(_Q(v) for v in values) + ")"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"
#: A text in which letters of other scripts are underscores, so that ASCII word edges are those of all scripts.
_ASCII = lambda x: f"regexp_replace({x}, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC]', '_', 'g')"
_E = r"(^|[^\p{L}\p{N}_])"

#: Multiple-choice questions that hold a document's whole text, and answers of every form to them.
ASKED = {
    "query": "CASE WHEN doc_id % 11 = 0 THEN text WHEN doc_id % 11 = 1 THEN concat('Answer yes or no. Question: ', text) WHEN doc_id % 11 = 2 THEN concat('Supports, refutes, not enough info? Claim: ', text) "
    "ELSE concat(text, chr(10), 'Choices: (A) ', lang, '. (B) ', source, '; (C) x (y) (D) both ( E ) none (A) ', source, chr(10), 'Answer with just the letter.') END",
    "answer": "CASE doc_id % 13 WHEN 0 THEN ' B ' WHEN 1 THEN 'a)' WHEN 2 THEN 'e' WHEN 3 THEN concat('the ', source, ' .') WHEN 4 THEN 'Yes.' WHEN 5 THEN concat('Answer: ', lang) WHEN 6 THEN 'I do not know' "
    "WHEN 7 THEN concat(source, ' is it') WHEN 8 THEN concat('Reasoning. Answer : (c) Answer: d, ', text) WHEN 9 THEN 'Answer: not  enough info' WHEN 10 THEN concat(text, ' Answer: no') WHEN 11 THEN 'd. ' ELSE text END",
}
ASKED_SQL = "SELECT doc_id, text, lang, source, " + ", ".join(f"{e} AS {n}" for n, e in ASKED.items()) + " FROM documents"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "text", "lang", "source", *(f"{e} AS {n}" for n, e in ASKED.items()))


_BLOCK = f"regexp_extract(query, {_Q(A.CHOICES)}, 1)"
_OF = lambda k: f"list_filter(list_zip(ks, vs), lambda p: p[1] = '{k}' AND p[2] <> '')[-1][2] AS option_{k.lower()}"


@query(
    "f20_f21_options",
    f"WITH a AS ({ASKED_SQL}), b AS (SELECT *, {_BLOCK} AS block FROM a), o AS (SELECT *, regexp_extract_all(block, '\\(([A-E])\\)\\s*', 1) AS ks, "
    f"list_transform(regexp_split_to_array(block, '\\([A-E]\\)\\s*')[2:], lambda x: rtrim(regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '[.,; ]+\\z', ''))) AS vs FROM b) "
    f"SELECT doc_id, regexp_matches(query, {_Q(A.ASKS_FOR_LETTER)}) AS asks, nullif(upper(regexp_extract(answer, {_Q(A.ANSWER_LETTER)}, 1)), '') AS letter, " + ", ".join(_OF(k) for k in "ABCDE") + " FROM o",
)
def options(spark: SparkSession, d: str) -> DataFrame:
    """Whether each query asks for a letter, the letter answered, and the choices by letter."""
    found = asked(spark, d).select("doc_id", "query", "answer", A.options(F.col("query")).alias("o"))
    return found.select("doc_id", A.asks_for_letter(F.col("query")).alias("asks"), A.answer_letter(F.col("answer")).alias("letter"), *(F.try_element_at("o", F.lit(k)).alias(f"option_{k.lower()}") for k in "ABCDE"))


_MARKS = r"[\s.?!,:;''\"]+"


@query(
    "f19_canonical_answer",
    f"WITH a AS ({ASKED_SQL}), r AS (SELECT doc_id, {_STRIP('answer')} AS raw, string_split(regexp_replace({_STRIP(_BLOCK)}, '(\\([A-Ea-e]\\))', chr(1) || '\\1', 'g'), chr(1)) AS pieces FROM a), "
    f"l AS (SELECT *, upper(regexp_extract(raw, {_Q(A.OPENING_LETTER)}, 1)) AS letter, {_STRIP(f'''regexp_replace(regexp_replace(raw, '{_MARKS}\\z', ''), '^{_MARKS}', '')''')} AS bare FROM r), "
    f"o AS (SELECT *, COALESCE(list_filter(list_transform(pieces, lambda p: [upper(regexp_extract(p, {_Q(A.OPTION_AT_END)}, 1)), {_STRIP(f'regexp_extract(p, {_Q(A.OPTION_AT_END)}, 2)')}]), lambda x: x[1] = letter)[1][2], '') AS option, {_WORDS('lower(bare)')} AS tokens FROM l) "
    f"SELECT doc_id, CASE WHEN raw = '' OR starts_with(lower(raw), 'answer:') THEN raw WHEN letter <> '' AND option <> '' THEN concat('Answer: ', regexp_replace(option, '\\.+\\z', ''), '.') "
    f"WHEN bare <> '' AND lower(bare) NOT IN {_IN((*A.REFUSALS, *A.DECLARATIVE))} AND NOT regexp_matches(bare, '^[A-Ea-e]\\z') AND len(tokens) <= {A.LONGEST_ENTITY} AND NOT list_has_any(tokens, [{', '.join(_Q(v) for v in A.VERBS)}]) "
    "THEN concat('Answer: ', bare, '.') ELSE raw END AS claim FROM o",
)
def canonical_answer(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("doc_id", A.canonical_answer(F.col("query"), F.col("answer")).alias("claim"))


_COT = lambda x: f"CASE WHEN contains({x}, 'Answer:') THEN trim(string_split({x}, 'Answer:')[-1]) WHEN {_SUFFIX(x)} <> '' THEN trim({_SUFFIX(x)}) ELSE trim({x}) END"
_SUFFIX = lambda x: f"regexp_extract({x}, '(?i)(?:^|[^A-Za-z0-9_])(?:so|therefore)?,?\\s*the\\s+answer\\s+is[:\\s]+(.+?)(?:[.!?](?:\\s|$)|$)', 1)"


@query("f18_display_answer", f"WITH a AS ({ASKED_SQL}) SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {_Q(A.INSUFFICIENT)} WHEN answer = '' THEN '' ELSE {_COT('answer')} END AS shown FROM a")
def display_answer(spark: SparkSession, d: str) -> DataFrame:
    """What users see of each answer, a quarter of which is withheld."""
    return asked(spark, d).select("doc_id", A.display_answer(F.col("answer"), F.when(F.col("doc_id") % 4 == 0, "ABSTAIN").otherwise("STORE")).alias("shown"))


@query("f26_entities", f"WITH r AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({_ASCII('text')}, {_Q(A.ENTITY_RUN)}), lambda x: {_STRIP('x')}), lambda x: len(x) >= 2 AND lower(x) NOT IN ('the', 'a', 'an')) AS r FROM documents) SELECT doc_id, len(r)::INT AS n, md5(array_to_string(r, '|')) AS entities FROM r")
def entities(spark: SparkSession, d: str) -> DataFrame:
    runs = A.entities(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(runs).alias("n"), F.md5(F.array_join(runs, "|")).alias("entities"))


_CHAINS = "unnest([text, concat('The ', source, ' of ', lang), split_part(text, '.', 1), CASE WHEN doc_id % 3 = 0 THEN 'in 1999 it was' ELSE 'd) it' END])"


@query(
    "f24_f25_heads",
    f"WITH c AS (SELECT doc_id, {_CHAINS} AS chain FROM documents), t AS (SELECT doc_id, {_STRIP('chain')} AS t FROM c), p AS (SELECT doc_id, t, regexp_extract(t, {_Q(A.HEAD_LETTER)}, 1) AS letter, "
    f"{_WORDS(f'COALESCE(regexp_extract_all({_ASCII(chr(116))}, {_Q(A.HEAD_RUN)})[-1], {_Q(str())})')} AS toks, regexp_extract({_ASCII('t')}, '\\b([0-9]{{4}})\\b', 1) AS year, "
    f"list_filter(regexp_extract_all(t, '[A-Za-z0-9''\\-]+'), lambda w: lower(w) NOT IN {_IN(A.STOP_WORDS)})[1] AS first FROM t), "
    f"k AS (SELECT *, COALESCE(list_max(list_transform(toks, lambda w, i: CASE WHEN lower(w) IN {_IN(A.STOP_WORDS)} THEN 0 ELSE i END)), 0) AS kept FROM p), "
    "h AS (SELECT doc_id, lower(CASE WHEN letter <> '' THEN letter WHEN kept > 0 THEN array_to_string(toks[1:kept], ' ') WHEN year <> '' THEN year ELSE COALESCE(first, '') END) AS head FROM k), "
    "g AS (SELECT doc_id, head, count(*) AS c FROM h WHERE head <> '' GROUP BY ALL), s AS (SELECT doc_id, sum(c) AS n, sum(c * (c - 1) / 2e0) AS same, md5(string_agg(head, '|' ORDER BY head)) AS heads FROM g GROUP BY doc_id) "
    "SELECT d.doc_id, CASE WHEN COALESCE(n, 0) < 2 THEN 0.5e0 ELSE same / (n * (n - 1) / 2e0) END AS agreement, COALESCE(heads, md5('')) AS heads FROM documents d LEFT JOIN s USING (doc_id)",
)
def heads(spark: SparkSession, d: str) -> DataFrame:
    """Heads of four chains of each document and how far they agree."""
    first = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    last = F.when(F.col("doc_id") % 3 == 0, "in 1999 it was").otherwise("d) it")
    chains = table(spark, d, "documents").select("doc_id", F.array("text", F.concat(F.lit("The "), "source", F.lit(" of "), "lang"), first, last).alias("c"))
    distinct = F.array_sort(F.array_distinct(F.filter(F.transform("c", A.head_noun), lambda h: h != "")))
    return chains.select("doc_id", A.head_consistency(F.col("c")).alias("agreement"), F.md5(F.array_join(distinct, "|")).alias("heads"))


#: Claims of every polarity that hold a whole text.
_CLAIM = "CASE doc_id % 9 WHEN 0 THEN concat(text, ' It is not so') WHEN 1 THEN concat(text, ' We do not know it') WHEN 2 THEN concat('They can''t. ', text) WHEN 3 THEN concat('It hasn''t been. ', text) WHEN 4 THEN concat('It has been so: ', text) WHEN 5 THEN concat('It may not. ', text) WHEN 6 THEN '  ' ELSE text END"
_EDGE = r"([^\p{L}\p{N}_]|\z)"


def _negated(text: str) -> str:
    """SQL of the rules: a word's edge is consumed and put back; what may not follow is marked before and unmarked after."""
    cases = []
    for pattern, put in A.UNDO:
        core = pattern.removeprefix(r"\b")
        ends = core.endswith(r"\b")
        core = core.removesuffix(r"\b")
        groups = 1 + core.count("(")
        find = "(?i)" + _E + core + (_EDGE if ends else "")
        back = "\\1" + put.replace("$2", "\\2") + (f"\\{groups + 1}" if ends else "")
        cases.append((find, f"regexp_replace({text}, {_Q(find)}, {_Q(back)})"))
    for pattern, _ in A.ADD:
        verbs, after = pattern.removeprefix(r"\b").split(r"\b(?!\s+")
        after = after.removesuffix(")").removesuffix(r"\b")
        after = after if after.startswith("(") else f"(?:{after})"
        marked = f"regexp_replace({text}, {_Q('(?i)' + _E + verbs + chr(92) + 's+' + after.replace('(?:', '(', 1) + _EDGE)}, concat('\\1', chr(1), '\\2 \\3\\4'), 'g')"
        find = "(?i)" + _E.replace("_]", "_\\x01]") + verbs + _EDGE
        cases.append((find, f"replace(regexp_replace({marked}, {_Q(find)}, '\\1\\2 not\\3'), chr(1), '')", marked))
    whens = " ".join(f"WHEN regexp_matches({c[2] if len(c) > 2 else text}, {_Q(c[0])}) THEN {c[1]}" for c in cases)
    return f"CASE {whens} END"


@query("f23_negation", f"WITH c AS (SELECT doc_id, {_STRIP(_CLAIM)} AS t FROM documents), n AS (SELECT doc_id, {_STRIP('regexp_replace(' + _negated('t') + ', $$\\s+$$, $$ $$, $$g$$)')} AS s FROM c) SELECT doc_id, md5(CASE WHEN s IS NULL THEN NULL WHEN regexp_matches(s, '[.!?]\\z') OR s = '' THEN s ELSE concat(s, '.') END) AS negated FROM n")
def negation(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "documents").selectExpr("doc_id", f"{_CLAIM.replace(chr(39) * 2, chr(92) + chr(39))} AS claim")
    return claims.select("doc_id", F.md5(A.negate(F.col("claim"))).alias("negated"))


_SQUEEZE = lambda x: f"regexp_replace(lower(COALESCE({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(
    "f28_atomic_facts",
    f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN concat(text, ' no_facts') WHEN doc_id % 5 = 1 THEN concat('Here are the facts in short', chr(10), '1. ', replace(text, '. ', concat(chr(10), '2) '))) ELSE text END AS raw, split_part(text, chr(10), 2) AS echo, source FROM documents), "
    f"l AS (SELECT *, list_transform(regexp_split_to_array(raw, {_Q(A.LINE_ENDS)}), lambda x: {_STRIP(f'CASE WHEN regexp_extract(x, {_Q(A.FACT_LINE)}, 1) <> {_Q(str())} THEN regexp_extract(x, {_Q(A.FACT_LINE)}, 1) ELSE x END')}) AS ts FROM r), "
    f"g AS (SELECT doc_id, CASE WHEN contains(upper(raw), 'NO_FACTS') THEN [] ELSE list_filter(ts, lambda t: t <> '' AND NOT ends_with(t, ':') AND NOT regexp_matches(t, {_Q(A.META_LINE)}) AND len({_WORDS('t')}) >= 4 AND {_SQUEEZE('t')} <> {_SQUEEZE('echo')} AND {_SQUEEZE('t')} <> {_SQUEEZE('source')}) END AS ts FROM l), "
    "k AS (SELECT doc_id, ts, list_transform(ts, lambda t: lower(t)) AS ks FROM g), f AS (SELECT doc_id, list_filter(ts, lambda t, i: list_position(ks, lower(t)) = i) AS fs FROM k) "
    "SELECT doc_id, len(fs)::INT AS n_facts, md5(array_to_string(fs, '|')) AS facts FROM f",
)
def atomic_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of whole texts, some numbered, some refused, with the second line as the answer that is not to be echoed."""
    text = F.col("text")
    listed = F.concat(F.lit("Here are the facts in short\n1. "), F.replace(text, F.lit(". "), F.lit("\n2) ")))
    raw = F.when(F.col("doc_id") % 25 == 0, F.concat(text, F.lit(" no_facts"))).when(F.col("doc_id") % 5 == 1, listed).otherwise(text)
    facts = table(spark, d, "documents").select("doc_id", A.atomic_facts(raw, F.split_part(text, F.lit("\n"), F.lit(2)), F.col("source")).alias("f"))
    return facts.select("doc_id", F.size("f").alias("n_facts"), F.md5(F.array_join("f", "|")).alias("facts"))


_FLAG = lambda x, p: f"CASE WHEN regexp_matches({_ASCII(x)}, {_Q('(?i)' + p)}) THEN 1e0 ELSE 0e0 END"
_LOW = f"lower({_STRIP('text')})"
_QF = {"q_token_len": f"len({_WORDS('text')})::DOUBLE"} | {n: _FLAG("text", p) for n, p in A.CUES.items()}
_QF |= {f"interrog_{w}": f"CASE WHEN starts_with({_LOW}, '{w}') THEN 1e0 ELSE 0e0 END" for w in A.INTERROGATIVES}
_QF["interrog_yesno"] = f"CASE WHEN NOT regexp_matches({_LOW}, '^(?:{'|'.join(A.INTERROGATIVES)})') AND regexp_matches({_ASCII(_LOW)}, {_Q(A.YES_NO)}) THEN 1e0 ELSE 0e0 END"


@query("f37_question_features", "SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in _QF.items()) + " FROM conversations")
def question_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", *(c.alias(n) for n, c in A.question_features(F.col("text")).items()))


_PF = {n: _FLAG("pred", p) for n, p in A.PHRASING.items()}
for _name, (_asks, _has) in A.EXPECTS.items():
    _PF |= {f"q_expects_{_name}": _FLAG("pred", _asks), f"passage_has_{_name}": _FLAG("gold", _has), f"{_name}_match": f"{_FLAG('pred', _asks)} * {_FLAG('gold', _has)}"}
_TURNS = "SELECT a.conv_id, a.turn, a.text AS pred, b.text AS gold FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"


@query("f38_phrasing_features", f"WITH t AS ({_TURNS}) SELECT conv_id, turn, " + ", ".join(f"{e} AS {n}" for n, e in _PF.items()) + " FROM t")
def phrasing_features(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", *(c.alias(n) for n, c in A.phrasing_features(F.col("pred"), F.col("gold")).items()))


_TASK = "CASE WHEN regexp_matches(query, '(?i)supports\\s*,\\s*refutes\\s*,\\s*not enough info') THEN 'fever' WHEN regexp_matches(query, '(?i)^\\s*answer\\s+yes\\s+or\\s+no(?:[^\\p{L}\\p{N}_]|\\z)') THEN 'strategyqa' END"
_AFTER = lambda name: f"nullif({_STRIP(f'''regexp_extract(query, '(?s){name}:\\s*(.+?)(?:\\s*\\z|\\n)', 1)''')}, '')"
_LABELLED = f"CASE task WHEN 'fever' THEN regexp_replace(lower(regexp_extract(answer, {_Q(A.LABELS)}, 1)), '\\s+', ' ', 'g') WHEN 'strategyqa' THEN lower(regexp_extract(answer, '(?i)answer\\s*:\\s*(yes|no)(?:[^\\p{{L}}\\p{{N}}_]|\\z)', 1)) END"


@query("f22_f36_claims", f"WITH a AS ({ASKED_SQL}), t AS (SELECT *, {_TASK} AS task FROM a) SELECT doc_id, task, md5(CASE task WHEN 'fever' THEN {_AFTER('Claim')} WHEN 'strategyqa' THEN {_AFTER('Question')} END) AS claim, nullif({_LABELLED}, '') AS label FROM t")
def claims(spark: SparkSession, d: str) -> DataFrame:
    """Each query's task, what it claims or asks, and the label that the answer gives."""
    q, a = F.col("query"), F.col("answer")
    return asked(spark, d).select("doc_id", A.claim_task(q).alias("task"), F.md5(A.claim_of(q)).alias("claim"), A.claim_label(q, a).alias("label"))


_SCORES = "SELECT l_orderkey AS okey, l_linenumber AS line, CASE l_partkey % 4 WHEN 0 THEN 'supports' WHEN 1 THEN 'refutes' WHEN 2 THEN 'not enough info' END AS label, l_discount * 10e0 AS pos_max, l_discount * 5e0 + 0.3e0 AS pos_mean, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax * 12.5e0 END AS neg_max, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax * 3e0 + 0.4e0 END AS neg_mean FROM lineitem"
_CERTAIN = lambda side: f"greatest(0e0, least(1e0, 1e0 - (CASE WHEN greatest(abs(pos_{side} - 0.5e0), abs(neg_{side} - 0.5e0)) > 0.1e0 THEN 4e0 ELSE 2e0 END) * greatest(abs(pos_{side} - 0.5e0), abs(neg_{side} - 0.5e0))))"
_DIR = lambda side: f"CASE WHEN label = 'supports' THEN pos_{side} WHEN neg_max IS NULL THEN NULL WHEN label = 'refutes' THEN neg_{side} WHEN label = 'not enough info' THEN {_CERTAIN(side)} END"


@query("v7_v9_directional", f"WITH s AS ({_SCORES}), g AS (SELECT label, {_DIR('max')} AS gmax, {_DIR('mean')} AS gmean, pos_max, pos_mean FROM s) SELECT label, count(*) AS n, count(gmax) AS directional, round(avg(COALESCE(gmax, pos_max)), 9) AS p_ground_max, round(avg(COALESCE(gmean, pos_mean)), 9) AS p_ground_mean FROM g GROUP BY label")
def directional(spark: SparkSession, d: str) -> DataFrame:
    """Grounding by the answer's direction; what has none falls back to the plain scores."""
    s = over(spark, _SCORES, lineitem=table(spark, d, "lineitem"))
    g = s.withColumn("g", C.directional(F.col("label"), *map(F.col, ("pos_max", "pos_mean", "neg_max", "neg_mean"))))
    mean = lambda side: F.round(F.avg(F.coalesce(f"g.p_ground_{side}", f"pos_{side}")), 9).alias(f"p_ground_{side}")
    return g.groupBy("label").agg(F.count("*").alias("n"), F.count("g.p_ground_max").alias("directional"), mean("max"), mean("mean"))


_RUNS = lambda x: f"list_filter(list_transform(regexp_extract_all({_ASCII(x)}, {_Q(A.ENTITY_RUN)}), lambda x: {_STRIP('x')}), lambda x: len(x) >= 2 AND lower(x) NOT IN ('the', 'a', 'an'))"


@query(
    "f27_j12_alias_overlap",
    f"WITH n AS (SELECT DISTINCT unnest({_RUNS('text')}) AS surface FROM benchmark), p AS (SELECT surface, substr(surface, 1, 4) AS alias FROM n), m AS (SELECT surface AS g, surface AS x FROM p UNION SELECT surface, alias FROM p), "
    "r AS (SELECT DISTINCT lower(a.x) AS k, lower(b.x) AS v FROM m a JOIN m b USING (g)), "
    f"t AS (SELECT conv_id, turn, {_RUNS('pred')} AS a, {_RUNS('gold')} AS p FROM ({_TURNS}) u), "
    "ps AS (SELECT DISTINCT conv_id, turn, lower(unnest(p)) AS s FROM t), pa AS (SELECT * FROM ps UNION SELECT conv_id, turn, r.v FROM ps JOIN r ON r.k = ps.s), "
    "xs AS (SELECT conv_id, turn, unnest(range(1, len(a) + 1)) AS i, lower(unnest(a)) AS s FROM t), xa AS (SELECT * FROM xs UNION SELECT conv_id, turn, i, r.v FROM xs JOIN r ON r.k = xs.s), "
    "c AS (SELECT conv_id, turn, count(DISTINCT i) AS covered FROM xa JOIN pa USING (conv_id, turn, s) GROUP BY ALL) "
    "SELECT t.conv_id, t.turn, CASE WHEN len(a) = 0 OR len(p) = 0 THEN 0.5e0 ELSE COALESCE(covered, 0)::DOUBLE / len(a) END AS overlap FROM t LEFT JOIN c USING (conv_id, turn)",
)
def aliases(spark: SparkSession, d: str) -> DataFrame:
    """How far the next turn names a turn's entities, by themselves or by an alias; aliases are the first letters of names."""
    names = table(spark, d, "benchmark").select(F.explode(A.entities(F.col("text"))).alias("surface")).distinct()
    pairs = names.select("surface", F.substring("surface", 1, 4).alias("alias"))
    rows = turns(spark, d).select("conv_id", "turn", A.entities(F.col("pred")).alias("said"), A.entities(F.col("gold")).alias("found"))
    return alias_overlap(rows, ["conv_id", "turn"], "said", "found", alias_table(pairs)).select("conv_id", "turn", F.col("alias_overlap").alias("overlap"))


@query("f33_question_hash", f"SELECT conv_id, turn, substr(sha256({_STRIP('text')}), 1, 16) AS qhash FROM conversations")
def question_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_hash(F.col("text")).alias("qhash"))


_VERDICTS = "SELECT l_suppkey % 3 AS batch, CASE l_partkey % 4 WHEN 0 THEN ' Supports' WHEN 1 THEN 'REFUTES ' WHEN 2 THEN 'not enough info' ELSE 'unsure' END AS said, CASE l_orderkey % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS gold FROM lineitem"


@query("f8_label_accuracy", f"SELECT batch, count(*) AS n, avg(CASE WHEN lower(trim(said)) = lower(trim(gold)) THEN 1e0 ELSE 0e0 END) AS accuracy FROM ({_VERDICTS}) v GROUP BY batch")
def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on claims against their gold labels, whatever case and spacing they come in."""
    rows = over(spark, _VERDICTS, lineitem=table(spark, d, "lineitem"))
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.avg(T.label_accuracy(F.col("said"), F.col("gold"))).alias("accuracy"))


_F1 = lambda p, g: f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1e0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0e0 ELSE 2e0 * COALESCE(list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({g}, lambda y: y = x))))), 0) / (len({p}) + len({g})) END"


@query("f6_best_token_f1", f"WITH t AS (SELECT conv_id, turn, {_WORDS(_NORM('pred'))} AS p, {_WORDS(_NORM('gold'))} AS g, {_WORDS(_NORM('concat(pred, gold)'))} AS h FROM ({_TURNS}) u) SELECT conv_id, turn, greatest({_F1('p', 'g')}, {_F1('p', 'h')}) AS f1 FROM t")
def best_token_f1(spark: SparkSession, d: str) -> DataFrame:
    """A turn against two golds: the next turn, and both together."""
    golds = F.array(F.col("gold"), F.concat("pred", "gold"))
    return turns(spark, d).select("conv_id", "turn", T.best_token_f1(F.col("pred"), golds).alias("f1"))

"""Answers before they are verified: canonical claims, options, entities and their heads, negation, atomic facts and the
features of questions. Column -> Column, inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.text import cot_answer, let, words

# Words that decide what an answer or a span is.
REFUSALS = ("i do not know", "i don't know", "no answer", "unknown", "not enough info", "not enough information")
DECLARATIVE = ("yes", "no", "supports", "refutes")
VERBS = (
    "is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "should", "may", "might",
    "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't",
)
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "and", "or", "but", "is", "are", "was", "were", "be", "been",
    "this", "that", "these", "those", "it", "its", "as", "by",
)
LONGEST_ENTITY = 5
LEAST_FACT_WORDS = 4
# Patterns. A word's edge counts letters of all scripts, hence (?U).
CHOICES = r"(?is)choices:\s*(.+?)(?:\n\s*answer\s+with|\z)"
ASKS_FOR_LETTER = r"(?is)choices:\s*.*?\([A-E]\).*?answer\s+with\s+(?:just\s+)?the\s+(?:multiple\s+choice\s+)?letter"
NOT_A_WORD = r"[^\p{L}\p{N}_]"
ANSWER_LETTER = rf"(?i)answer\s*:\s*([A-E])(?:{NOT_A_WORD}|\z)"
OPTION_AT_END = r"\(\s*([A-Ea-e])\s*\)\s*([^()]+)\z"
OPENING_LETTER = r"^([A-Ea-e])(?:[.)\]:]|\z)"
HEAD_LETTER = rf"^([A-Ea-e])(?:[.)\]:]|{NOT_A_WORD}|\z)"
NAME = r"[A-Z][a-zA-Z'\-]+"
HEAD_RUN = rf"\b{NAME}(?:\s+(?:of|the|de|von|van|du|la|le|der|den)\s+)?(?:\s+{NAME})*\b"
_JOINS = r"\s+(?:of|the|de|von|van|du|la|le)\s+"
ENTITY_RUN = rf"\b{NAME}(?:{_JOINS}{NAME})*(?:{_JOINS})?(?:\s+{NAME})*\b"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FACT_LINE = r"^\s*[0-9]+[.):\-]\s*(.+?)\s*$"
META_LINE = r"(?i)^(?:numbered|list|statement|question|answer|claim|decompose|fact|facts|here\s+(?:are|is)|the\s+following|note|output)[:\s]"
CUES = {
    "negation_present": r"\b(?:not|never|no|none|nobody|nothing|neither|nor|n['’]?t)\b",
    "temporal_cue": r"\b(?:recently|currently|now|today|yesterday|tomorrow|last\s+(?:week|month|year)|nowadays|present|modern)\b|\b(?:19|20)[0-9]{2}\b",
    "numerical_cue": r"\b[0-9]+(?:[.,][0-9]+)?\b|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|hundred|thousand|million|billion)\b",
    "myth_regex_hit": r"is\s+it\s+(?:true|safe|real|legal)|do\s+(?:people|most|some|many)\s+(?:believe|think|say)|common\s+(?:misconception|myth|belief)|what\s+happens\s+if\s+you"
    r"|can\s+(?:you|i)\s+(?:get|catch|die\s+from)|is\s+it\s+possible\s+to\s+",
}
YES_NO = r"^(?:is|are|was|were|do|does|did|can|could|should|would|will|has|have|had)\b"
PHRASING = {
    "is_adversarial_phrasing": r"\b(?:is\s+it\s+(?:true|safe|real|legal|possible|okay)|do\s+(?:most\s+|some\s+|many\s+)?people\s+(?:believe|think|say|claim)|can\s+you\s+(?:actually|really|truly)"
    r"|what\s+happens\s+if\s+you|are\s+you\s+supposed\s+to|common\s+(?:misconception|myth|belief))",
    "is_opinion_seeking": r"\b(?:should|would|might|could|prefer|opinion|believe|feel|think)\b",
    "is_open_ended": r"\b(?:why|how\s+to|describe|explain|discuss|what\s+is\s+the\s+(?:meaning|purpose))\b",
}
EXPECTS = {"year": (r"\b(?:what\s+year|when\s+(?:did|was|were|is))\b", r"\b(?:19|20)[0-9]{2}\b"), "number": (r"\bhow\s+(?:many|much)\b", r"\b[0-9]+(?:\.[0-9]+)?\b")}
INTERROGATIVES = ("who", "what", "when", "where", "why", "how")
# What asks for a verdict or a yes or no, the line that a name opens, and an answer of yes or no.
ASKS_VERDICT = r"(?i)supports\s*,\s*refutes\s*,\s*not enough info"
ASKS_YES_NO = rf"(?i)^\s*answer\s+yes\s+or\s+no(?:{NOT_A_WORD}|\z)"
NAMED_LINE = r":\s*(.+?)(?:\s*\z|\n)"
ANSWERS_YES_NO = rf"(?i)answer\s*:\s*(yes|no)(?:{NOT_A_WORD}|\z)"
# Rules of negation in order: what goes first, then what is added where none of those is found.
UNDO = (
    (r"\b(is|are|was|were)\s+not\s+", "$2 "), (r"\b(does|do|did)\s+not\s+", ""), (r"\b(cannot|can't)\b", "can"), (r"\bwon't\b", "will"), (r"\bwouldn't\b", "would"),
    (r"\bshouldn't\b", "should"), (r"\bhasn't\b", "has"), (r"\bhaven't\b", "have"), (r"\bhadn't\b", "had"), (r"\bdidn't\b", "did"), (r"\bdoesn't\b", "does"),
    (r"\bdon't\b", "do"), (r"\bisn't\b", "is"), (r"\baren't\b", "are"), (r"\bwasn't\b", "was"), (r"\bweren't\b", "were"),
)
ADD = (
    (r"\b(is|are|was|were)\b(?!\s+not\b)", "$2 not"), (r"\b(can|will|would|should|could|may|might|must)\b(?!\s+not\b)", "$2 not"),
    (r"\b(has|have|had)\b(?!\s+(?:not|been|only)\b)", "$2 not"),
)
INSUFFICIENT = "I don't have enough evidence to answer this reliably."
LABELS = r"(?i)answer\s*:\s*(supports|refutes|not\s+enough\s+info)(?:[^\p{L}\p{N}_]|\z)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def choices_block(query: Column) -> Column:
    """What stands between "Choices:" and the instruction after it; "" without one."""
    return F.regexp_extract(F.coalesce(query, F.lit("")), CHOICES, 1)


def asks_for_letter(query: Column) -> Column:
    """Whether a query lists choices and asks for a letter."""
    return F.coalesce(query, F.lit("")).rlike(ASKS_FOR_LETTER)


def answer_letter(answer: Column) -> Column:
    """The letter after "Answer:", null without one."""
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(answer, F.lit("")), ANSWER_LETTER, 1)), F.lit(""))


def options(query: Column) -> Column:
    """map<letter, text> of the choices block; of a letter that comes twice the last text counts, empty texts do not."""

    def read(block: Column) -> Column:
        letters = F.regexp_extract_all(block, F.lit(r"\(([A-E])\)\s*"), F.lit(1))
        texts = F.slice(F.split(block, r"\([A-E]\)\s*"), 2, F.greatest(F.size(letters), F.lit(1)))
        clean = F.transform(texts, lambda t: F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"[.,; ]+\z", "")))
        return F.filter(F.arrays_zip(letters.alias("k"), clean.alias("v")), lambda p: p["v"] != "")

    def last_of_each(pairs: Column) -> Column:
        later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"])
        return F.map_from_entries(F.transform(F.filter(pairs, lambda p, i: ~later(p, i)), lambda p: F.struct(p["k"], p["v"])))

    return let(let(choices_block(query), read), last_of_each)


def _bare(text: Column) -> Column:
    marks = r"[\s.?!,:;'\"]+"
    return stripped(F.regexp_replace(F.regexp_replace(text, marks + r"\z", ""), "^" + marks, ""))


def canonical_answer(query: Column, answer: Column) -> Column:
    """An answer as a claim: an option's letter becomes its text, a short name is wrapped, everything else stays.

    Null and empty answers are empty. What starts with "Answer:" is a claim already, so that the function is idempotent.
    """

    def claim(s: Column) -> Column:
        raw, bare = s["raw"], s["bare"]
        letter = F.upper(F.regexp_extract(raw, OPENING_LETTER, 1))
        pieces = F.split(F.regexp_replace(stripped(s["block"]), r"(\([A-Ea-e]\))", "\x01$1"), "\x01")
        named = F.transform(pieces, lambda p: F.struct(F.upper(F.regexp_extract(p, OPTION_AT_END, 1)).alias("k"), stripped(F.regexp_extract(p, OPTION_AT_END, 2)).alias("v")))
        option = F.coalesce(F.get(F.filter(named, lambda x: x["k"] == letter), F.lit(0))["v"], F.lit(""))
        tokens = words(F.lower(bare))
        name = (
            (bare != "") & ~F.lower(bare).isin(*REFUSALS, *DECLARATIVE) & ~bare.rlike(r"^[A-Ea-e]\z") & (F.size(tokens) <= LONGEST_ENTITY)
            & ~F.exists(tokens, lambda w: w.isin(*VERBS))
        )
        return (
            F.when((raw == "") | F.lower(raw).startswith("answer:"), raw)
            .when((letter != "") & (option != ""), F.concat(F.lit("Answer: "), F.regexp_replace(option, r"\.+\z", ""), F.lit(".")))
            .when(name, F.concat(F.lit("Answer: "), bare, F.lit("."))).otherwise(raw)
        )

    raw = stripped(F.coalesce(answer, F.lit("")))
    return let(F.struct(raw.alias("raw"), _bare(raw).alias("bare"), choices_block(query).alias("block")), claim)


def display_answer(answer: Column, decision: Column) -> Column:
    """What a user sees: the final answer of a chain, or the message that evidence is missing where the answer is withheld."""
    shown = F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(cot_answer(answer))
    return F.when(F.coalesce(decision == "ABSTAIN", F.lit(False)), INSUFFICIENT).otherwise(shown)


def entities(text: Column) -> Column:
    """Capitalised runs, joined by "of", "the" and the like; none for null."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + ENTITY_RUN), F.lit(0)), stripped)
    return F.filter(runs, lambda r: (F.length(r) >= 2) & ~F.lower(r).isin("the", "a", "an"))


def head_noun(text: Column) -> Column:
    """A lower-case head: an option's letter, else the last capitalised run without stop words at its end, else four digits,
    else the first word that is no stop word, else ""."""

    def head(t: Column) -> Column:
        letter = F.regexp_extract(t, HEAD_LETTER, 1)
        runs = F.regexp_extract_all(t, F.lit("(?U)" + HEAD_RUN), F.lit(0))
        tokens = words(F.get(runs, F.size(runs) - 1))
        kept = F.array_max(F.transform(tokens, lambda w, i: F.when(F.lower(w).isin(*STOP_WORDS), 0).otherwise(i + 1)))
        run = F.when(F.coalesce(kept, F.lit(0)) > 0, F.array_join(F.slice(tokens, F.lit(1), F.greatest(kept, F.lit(1))), " ")).otherwise("")
        year = F.regexp_extract(t, r"(?U)\b([0-9]{4})\b", 1)
        first = F.get(F.filter(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9'\-]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP_WORDS)), F.lit(0))
        return F.lower(F.when(letter != "", letter).when(run != "", run).when(year != "", year).otherwise(F.coalesce(first, F.lit(""))))

    return let(stripped(F.coalesce(text, F.lit(""))), head)


def head_consistency(chains: Column) -> Column:
    """Share of the pairs of chains whose heads agree; one half with fewer than two heads."""

    def agreeing(heads: Column) -> Column:
        n = F.size(heads)
        same = F.aggregate(F.array_distinct(heads), F.lit(0.0), lambda s, h: s + _choose2(F.size(F.filter(heads, lambda x: x == h))))
        return F.when(n < 2, 0.5).otherwise(same / _choose2(n))

    heads = F.filter(F.transform(F.coalesce(chains, F.array().cast("array<string>")), head_noun), lambda h: h != "")
    return let(heads, agreeing)


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2.0


def negate(claim: Column) -> Column:
    """A claim with its polarity turned by the first rule that fits, once; null where none does."""

    def turned(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, replacement in reversed((*UNDO, *ADD)):
            out = F.when(text.rlike("(?iU)" + pattern), F.regexp_replace(text, "(?isU)^(.*?)" + pattern, "$1" + replacement)).otherwise(out)
        return out

    def tidy(text: Column) -> Column:
        single = stripped(F.regexp_replace(text, r"\s+", " "))
        return F.when(single.rlike(r"[.!?]\z") | (single == ""), single).otherwise(F.concat(single, F.lit(".")))

    return let(let(stripped(claim), turned), tidy)


def atomic_facts(raw: Column, question: Column | None = None, answer: Column | None = None) -> Column:
    """The claims that a listing of facts names: numbers stripped, headings, fragments and echoes of the question or answer left
    out, the first of those that differ in case alone. A listing that says NO_FACTS has none."""
    squeezed = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\W+", "")
    body = F.coalesce(raw, F.lit(""))

    def claims(s: Column) -> Column:
        lines = F.transform(F.split(s["body"], LINE_ENDS), lambda x: F.struct(F.regexp_extract(x, FACT_LINE, 1).alias("m"), x.alias("x")))
        texts = F.transform(lines, lambda x: stripped(F.when(x["m"] != "", x["m"]).otherwise(x["x"])))
        good = F.filter(
            texts,
            lambda t: (t != "") & ~t.endswith(":") & ~t.rlike(META_LINE) & (F.size(words(t)) >= LEAST_FACT_WORDS) & (squeezed(t) != s["q"]) & (squeezed(t) != s["a"]),
        )
        return F.when(F.contains(F.upper(s["body"]), F.lit("NO_FACTS")), F.array().cast("array<string>")).otherwise(let(good, _first_by_case))

    echo = lambda x: squeezed(F.lit("") if x is None else x)
    return let(F.struct(body.alias("body"), echo(question).alias("q"), echo(answer).alias("a")), claims)


def _first_by_case(texts: Column) -> Column:
    return let(F.transform(texts, F.lower), lambda keys: F.filter(texts, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1))


def question_features(question: Column) -> dict[str, Column]:
    """Length, cue flags and a one-hot of the question word."""
    q = F.coalesce(question, F.lit(""))
    low = F.lower(stripped(q))
    out = {"q_token_len": F.size(words(q)).cast("double")} | {n: q.rlike("(?iU)" + p).cast("double") for n, p in CUES.items()}
    before = F.lit(False)
    for word in INTERROGATIVES:
        out[f"interrog_{word}"] = (low.startswith(word) & ~before).cast("double")
        before = before | low.startswith(word)
    out["interrog_yesno"] = (~before & low.rlike("(?U)" + YES_NO)).cast("double")
    return out


def phrasing_features(question: Column, passage: Column) -> dict[str, Column]:
    """How a question is put, whether it expects a year or a number, and whether the passage has one."""
    q, p = F.coalesce(question, F.lit("")), F.coalesce(passage, F.lit(""))
    out = {n: q.rlike("(?iU)" + x).cast("double") for n, x in PHRASING.items()}
    for name, (asked, found) in EXPECTS.items():
        expects, has = q.rlike("(?iU)" + asked).cast("double"), p.rlike("(?U)" + found).cast("double")
        out |= {f"q_expects_{name}": expects, f"passage_has_{name}": has, f"{name}_match": expects * has}
    return out


def claim_task(query: Column) -> Column:
    """"fever", "strategyqa" or null, by what a query asks for."""
    q = F.coalesce(query, F.lit(""))
    return F.when(q.rlike(ASKS_VERDICT), "fever").when(q.rlike(ASKS_YES_NO), "strategyqa")


def claim_of(query: Column) -> Column:
    """The line after "Claim:" or "Question:", by the query's task; null without one."""
    after = lambda name: F.nullif(stripped(F.regexp_extract(query, "(?s)" + name + NAMED_LINE, 1)), F.lit(""))
    return F.when(claim_task(query) == "fever", after("Claim")).when(claim_task(query) == "strategyqa", after("Question"))


def claim_label(query: Column, answer: Column) -> Column:
    """The label after "Answer:" in the terms of the query's task; null without one."""
    a = F.coalesce(answer, F.lit(""))
    fever = F.regexp_replace(F.lower(F.regexp_extract(a, LABELS, 1)), r"\s+", " ")
    yes_no = F.lower(F.regexp_extract(a, ANSWERS_YES_NO, 1))
    return F.nullif(F.when(claim_task(query) == "fever", fever).when(claim_task(query) == "strategyqa", yes_no), F.lit(""))

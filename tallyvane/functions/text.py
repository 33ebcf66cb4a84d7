"""Text and answer-scoring functions, Column -> Column. Everything stays inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters that normalisation deletes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[ \t\n\r\x0b\x0c]+"
# Answers that leak a template or evade the question.
TEMPLATE_LEAK = (
    r"<(?:concise|factual|your|scaffold|answer)[a-z_ ]*>",
    r"\[(?:your\s+answer|answer\s+here)\]",
    r"<(?:supports|refutes|yes|no)/",
)
EVASIVE = (
    r"the\s+context\s+(?:does\s*not|doesn'?t)\s+(?:mention|provide|contain|discuss)",
    r"no\s+information\s+(?:is\s+)?(?:provided|given|available|mentioned)",
    r"information\s+(?:is\s+)?not\s+provided",
    r"cannot\s+(?:determine|verify|be\s+determined)",
    r"(?:none\s+of\s+the\s+given|none\s+of\s+the\s+listed)\s+(?:options|choices|models|items)",
)
# Where an answer stands in a text, the labels it may be, and how queries of a task open.
ANSWER_IS = r"(?i)(?:^|\W)(?:so|therefore)?,?\s*the\s+answer\s+is[:\s]+(.+?)(?:[.!?](?:\s|$)|$)"
ANSWER_MARK = "Answer:"
ANSWER_LINE = r"(?i)answer\s*:\s*([^\n]*)"
ANSWER_AGAIN = r"(?i)^(?:answer\s*:\s*)+"
REASONING_FIRST = r"(?i)^\s*reasoning\s*:\s*"
FEVER_FORMS = r"\b(?:not enough info(?:rmation)?|refut(?:e|es|ed)|support(?:s|ed)?)\b"
YES_NO = r"\b(?:yes|no)\b"
OPENING_LETTER = r"^\(?\[?([A-Ea-e])\)?\]?(?:[\s.:)\-].*)?$"
LONE_LETTER = r"(?:^|[\s(\[|,/])([A-E])(?=$|[\s)\].:,|/])"
FEVER_QUERY, YES_NO_QUERY = "answer with one of: supports, refutes, not enough info.", "answer yes or no."
CHOICE_QUERY, FIFTH_CHOICE = ("choices:", "multiple choice letter"), "(e)"


#: Those that the hallucination rates look for.
MEASURED_LEAK, MEASURED_EVASIVE = TEMPLATE_LEAK[:2], EVASIVE[:4]


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def words(text: Column) -> Column:
    """Non-empty runs between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def normalise(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, SPACE), lambda x: ~x.isin("", "a", "an", "the")), " ")


def norm_words(text: Column) -> Column:
    """Lower case; all but a-z, 0-9 and space become a space; single spaces."""
    return F.array_join(words(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " ")), " ")


def cot_answer(text: Column) -> Column:
    """What follows the last "Answer:"; else what "the answer is" names, up to the end of its sentence; else all."""
    suffix = F.regexp_extract(text, ANSWER_IS, 1)
    return F.when(F.contains(text, F.lit(ANSWER_MARK)), F.trim(F.element_at(F.split(text, ANSWER_MARK), -1))).when(suffix != "", F.trim(suffix)).otherwise(F.trim(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body, or a lambda in it, refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalise(prediction) == normalise(gold)).cast("double")


def any_exact_match(prediction: Column, golds: Column) -> Column:
    return let(normalise(prediction), lambda p: F.coalesce(F.exists(golds, lambda g: normalise(g) == p).cast("double"), F.lit(0.0)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over tokens with multiplicity; both empty 1, one empty or none common 0."""

    def score(s: Column) -> Column:
        p, g = s["p"], s["g"]
        common = F.size(F.array_intersect(_numbered(p), _numbered(g)))
        f1 = F.lit(2.0) * common / (F.size(p) + F.size(g))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)

    return let(F.struct(words(normalise(prediction)).alias("p"), words(normalise(gold)).alias("g")), score)


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that a set of these is a multiset of tokens."""

    def number(x: Column) -> Column:
        return F.transform(x, lambda t, i: F.concat_ws("\x01", t, i + 1 - F.array_position(x, t)))

    return let(F.array_sort(tokens), number)


def best_token_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def label_accuracy(prediction: Column, gold: Column) -> Column:
    return (F.lower(F.trim(prediction)) == F.lower(F.trim(gold))).cast("double")


#: A word's edge where only ASCII letters, digits and the underscore make words; Java's own counts letters of all scripts.
ASCII_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def last_match(text: Column, pattern: str, ascii_edges: bool = False) -> Column:
    """A pattern's right-most match, "" if there is none; its word edges may be asked to know ASCII alone."""
    own = pattern.replace(r"\b", ASCII_EDGE) if ascii_edges else pattern
    return F.regexp_extract(text, rf"(?is)^.*({own})", 1)


def fever_label(text: Column, ascii_edges: bool = False) -> Column:
    """The label family that the right-most mention belongs to, else ""."""
    found = F.lower(last_match(text, FEVER_FORMS, ascii_edges))
    return F.when(found.startswith("not"), "not enough info").when(found.startswith("refut"), "refutes").when(found.startswith("support"), "supports").otherwise("")


def strategyqa_label(text: Column, ascii_edges: bool = False) -> Column:
    return F.lower(last_match(text, YES_NO, ascii_edges))


def choice_label(text: Column, n_choices: int = 4) -> Column:
    """The first isolated letter of the answer, else its first isolated digit as a letter; n_choices is held to 4 or 5."""
    last = max(4, min(int(n_choices), 5))
    top = "ABCDE"[last - 1]
    answer = cot_answer(text)
    letter = F.upper(F.regexp_extract(answer, rf"\b([A-{top}a-{top.lower()}])\b", 1))
    digit = F.translate(F.regexp_extract(answer, rf"\b([1-{last}])\b", 1), "12345", "ABCDE")
    return F.when(letter != "", letter).otherwise(digit)


def final_answer_line(text: Column) -> Column:
    """First line after the last "answer:"; without one, the last line after a leading "reasoning:"."""
    body = F.coalesce(text, F.lit(""))
    marked = F.regexp_extract_all(body, F.lit(ANSWER_LINE), F.lit(1))
    line = F.regexp_replace(F.trim(F.element_at(marked, -1)), ANSWER_AGAIN, "")
    rest = F.regexp_replace(F.regexp_replace(body, REASONING_FIRST, ""), r"^\s+|\s+$", "")
    return F.when(F.size(marked) > 0, line).otherwise(F.element_at(F.split(rest, "\n"), -1))


def csqa_letter(answer: Column) -> Column:
    """The one letter A-E that an answer opens with; null if there is none, or another is named too."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    first = F.upper(F.regexp_extract(a, OPENING_LETTER, 1))
    others = F.array_distinct(F.regexp_extract_all(a, F.lit(LONE_LETTER), F.lit(1)))
    return F.when((first != "") & (F.size(F.array_union(others, F.array(first))) == 1), first)


def uniform_score(benchmark: Column, prediction: Column, golds: Column, gold_label: Column) -> Column:
    """struct<em, lenient_em> by each benchmark's rule. A benchmark without a uniform rule is refused: the row raises an error."""
    line = final_answer_line(prediction)
    plain = norm_words(line)
    label = F.lower(F.trim(F.coalesce(gold_label, F.element_at(golds, 1), F.lit(""))))
    fever = F.lit("")
    for name in ("refutes", "supports", "not enough info"):
        fever = F.when(plain.startswith(name), name).otherwise(fever)
    first = F.element_at(F.split(plain, " "), 1)
    strict = any_exact_match(line, golds)
    inside = F.exists(golds, lambda g: (norm_words(g) != "") & F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(F.lit(" "), norm_words(g), F.lit(" "))))
    em = (
        F.when(benchmark == "fever", ((fever != "") & (fever == label)).cast("double"))
        .when(benchmark == "strategyqa", (first.isin("yes", "no") & (first == label)).cast("double"))
        .when(benchmark == "commonsense_qa", F.coalesce(csqa_letter(line) == F.upper(label), F.lit(False)).cast("double"))
        .when(benchmark.isin("triviaqa", "natural_questions"), strict)
        .otherwise(F.raise_error(F.concat(F.lit("no uniform rule for "), F.coalesce(benchmark, F.lit("null")))).cast("double"))
    )
    lenient = F.when(benchmark.isin("triviaqa", "natural_questions"), F.greatest(strict, F.coalesce(inside, F.lit(False)).cast("double")))
    return F.struct(em.alias("em"), lenient.alias("lenient_em"))


def is_unstorable(answer: Column) -> Column:
    """Empty, a leaked template, or an evasion."""
    body = F.coalesce(answer, F.lit(""))
    return (body == "") | body.rlike(any_of(TEMPLATE_LEAK)) | body.rlike(any_of(EVASIVE))


def question_hash(question: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a trimmed question, by which pools are compared; null stays null."""
    return F.substring(F.sha2(F.regexp_replace(question, r"^\s+|\s+\z", ""), 256), 1, 16)


def content_id(question: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the first 500 characters of the trimmed question; a missing one is empty."""
    return F.substring(F.sha2(F.substring(F.trim(F.coalesce(question, F.lit(""))), 1, 500), 256), 1, 16)


def distinct_ngram_ratio(tokens: Column, n: int = 4) -> Column:
    """Distinct over all n-grams; 1 for fewer than n tokens."""

    def ratio(t: Column) -> Column:
        zipped = F.arrays_zip(*(F.slice(t, k + 1, F.size(t) - n + 1).alias(f"w{k}") for k in range(n)))
        grams = F.transform(zipped, lambda g: F.concat_ws(" ", *(g[f"w{k}"] for k in range(n))))  # strings: sets of structs are compared pairwise
        return F.when(F.size(t) < n, 1.0).otherwise(F.size(F.array_distinct(grams)) / (F.size(t) - n + 1))

    return let(tokens, ratio)


# Task family of each benchmark that names its own.
TASKS = {
    "fever": "fever", "strategyqa": "strategyqa", "arc_challenge": "arc", "arc": "arc", "commonsense_qa": "csqa", "csqa": "csqa",
    "hotpotqa": "hotpotqa", "hotpot_qa": "hotpotqa", "triviaqa": "open", "natural_questions": "open", "truthfulqa": "open", "asqa": "open",
}


def query_task(query: Column, hint: Column) -> Column:
    """The hint's task family; without a known hint, by the query's form."""
    known = F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair])
    q = F.lower(F.trim(query))
    choices = F.contains(q, F.lit(CHOICE_QUERY[0])) & F.contains(q, F.lit(CHOICE_QUERY[1]))
    form = (
        F.when(q.startswith(FEVER_QUERY), "fever")
        .when(q.startswith(YES_NO_QUERY), "strategyqa")
        .when(choices & F.contains(q, F.lit(FIFTH_CHOICE)), "csqa").when(choices, "arc").otherwise("open")
    )
    return F.coalesce(F.element_at(known, F.lower(hint)), form)

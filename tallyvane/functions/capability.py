"""Lenient scoring by benchmark: what an answer says in its "Answer:" line, else in its last words that could be one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvane.functions.answers import stripped

# Patterns. A word's edge counts letters of all scripts, hence (?U).
ANSWER_LINE = r"(?i)answer\s*[:\-]\s*([^\n\r.]+)"
CHOICE = r"(?U)\b([A-E])\b"
YES_NO = r"(?iU)\b(yes|no|true|false)\b"
VERDICT = r"(?iU)\b(supports|refutes|nei|not[\s\-]?enough[\s\-]?info)\b"
# What counts as the same answer.
AS_YES, AS_NO = ("yes", "true", "1"), ("no", "false", "0")


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.get(found, F.size(found) - 1)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def answer_line(text: Column) -> Column:
    """What follows the last "Answer:" up to the end of its line or sentence; null without one."""
    return stripped(_last(F.coalesce(text, F.lit("")), ANSWER_LINE))


def _said(text: Column, pattern: str) -> Column:
    """The first match in the answer line, else the last in the whole text."""
    body = F.coalesce(text, F.lit(""))
    return F.coalesce(_first(answer_line(body), pattern), _last(body, pattern))


def choice_said(text: Column) -> Column:
    return _said(text, CHOICE)


def yes_no_said(text: Column) -> Column:
    found = F.lower(_said(text, YES_NO))
    return F.when(found.isin(*AS_YES), "yes").when(found.isin(*AS_NO), "no")


def verdict_said(text: Column) -> Column:
    """SUPPORTS, REFUTES or NOT ENOUGH INFO; a run of letters without spaces, "notenoughinfo", is none."""
    found = stripped(F.translate(F.lower(_said(text, VERDICT)), "-_", "  "))
    return F.when(found == "supports", "SUPPORTS").when(found == "refutes", "REFUTES").when(found.isin("nei", "not enough info"), "NOT ENOUGH INFO")


def _yes_no_gold(gold: Column) -> Column:
    g = F.lower(stripped(gold))
    return F.when(g.isin(*AS_YES), "yes").when(g.isin(*AS_NO), "no").otherwise(F.nullif(g, F.lit("")))


def _verdict_gold(gold: Column) -> Column:
    g = F.translate(F.upper(stripped(gold)), "-_", "  ")
    return F.when(g.contains("NOT ENOUGH INFO") | (g == "NEI"), "NOT ENOUGH INFO").otherwise(F.nullif(g, F.lit("")))


def capability_em(prediction: Column, gold: Column, benchmark: Column) -> Column:
    """1 or 0 by the benchmark's lenient reading; null for open benchmarks and without a gold answer."""
    bench, right = F.lower(benchmark), lambda said, wanted: F.coalesce((said == wanted).cast("double"), F.lit(0.0))
    return F.when(F.coalesce(gold, F.lit("")) != "", F.when(bench.contains("commonsense") | (bench == "csqa"), right(choice_said(prediction), F.upper(stripped(gold))))
        .when(bench.contains("strategy"), right(yes_no_said(prediction), _yes_no_gold(gold))).when(bench == "fever", right(verdict_said(prediction), _verdict_gold(gold))))

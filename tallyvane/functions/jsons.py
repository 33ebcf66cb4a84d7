"""Objects inside free text: the first balanced one, read, and annotations checked against their fixed form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What an annotation may say.
RETRIEVE = ("[Retrieve]", "[No-Retrieve]")
PASSAGE = ("[Relevant]", "[Irrelevant]")
SUPPORT = ("[Supported]", "[Partial]", "[NoSupport]")
USEFUL = tuple(f"[Useful:{i}]" for i in range(1, 6))

#: Outside a string: what opens, closes or quotes. A string as a whole, with what is escaped in it, or one that never ends.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?P<shut>")?|[{}]', re.DOTALL)


def first_object(text: str | None) -> str | None:
    """From the first "{" to the brace that closes it, braces in strings left aside; one pass over the text."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for mark in _MARKS.finditer(text, start):
        found = mark.group()
        if found == "{":
            depth += 1
        elif found == "}":
            depth -= 1
            if not depth:
                return text[start : mark.end()]
        elif mark.group("shut") is None:
            return None
    return None


@F.pandas_udf(StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    """The first balanced object of each text, null without one: nesting is beyond Spark's own patterns."""
    return text.map(first_object, na_action="ignore")


def json_object(text: Column) -> Column:
    """The first balanced object of a text as a variant; null where there is none or it is no JSON. A key given twice makes it
    none."""
    return F.try_parse_json(balanced_object(text))


def _typed(value: Column, path: str, kind: str) -> Column:
    """A field of a variant if it has exactly this type."""
    field = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(field) == kind.upper(), F.try_variant_get(value, path, kind))


def valid_annotation(value: Column, n_passages: Column) -> Column:
    """Whether an annotation names a retrieval decision, one decision for each passage, support, usefulness and an answer, all
    in their fixed terms."""
    passages = F.try_variant_get(value, "$.passage_decisions", "variant")
    kind = F.schema_of_variant(passages)
    listed = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, "$.passage_decisions", "array<string>"))
    among = lambda path, values: _typed(value, path, "string").isin(*values)
    good = (
        among("$.retrieve_decision", RETRIEVE) & among("$.support_decision", SUPPORT) & among("$.useful_score", USEFUL)
        & _typed(value, "$.annotated_answer", "string").isNotNull() & (F.size(listed) == n_passages) & F.forall(listed, lambda p: F.coalesce(p.isin(*PASSAGE), F.lit(False)))
    )
    return F.coalesce(good, F.lit(False))

"""Scores of answers by the rule of their benchmark, and counts of answers whose form is suspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import text as T
from tallyvane.operators.loops import best_rouge_l

# Benchmarks with a rule, and the LCS F1 beyond which a long answer counts as right.
UNIFORM = ("fever", "strategyqa", "commonsense_qa", "triviaqa", "natural_questions")
LONG_FORM = {"truthfulqa": 0.15, "asqa": 0.20}
# Forms of answers that the audit counts, and how long an answer without a mark may be.
MARKED, MARK_LAST, REASONING_ONLY = r"(?is)answer\s*:", r"(?is)answer\s*:\s*\z", "reasoning:"
REFUSAL, REFUSAL_TAIL = r"(?i)i do not know|i don.t know|cannot (?:be )?determine|not enough info", 120
FEVER_MARKED = r"(?i)answer\s*:\s*(?:supports|refutes|not enough info)(?:[^\p{L}\p{N}_]|\z)"
LETTER_MARKED = r"(?i)answer\s*:\s*\(?[A-E]\)?\s*\.?\s*\z"
LONG_ANSWER = 300
BENCHMARKS = (*UNIFORM, *LONG_FORM, "arc_challenge")


def harness_scores(rows: DataFrame) -> DataFrame:
    """rows (benchmark, prediction, golds, gold_label) with em and f1.

    Closed benchmarks and the open ones with aliases follow the uniform rule (f1 is em, or the best token F1 over golds);
    long-form ones take the best LCS F1 over golds and a threshold; multiple choice compares letters; any other compares the
    extracted answer with the first gold. Only long-form rows bring their texts to Python.
    """
    answer, first = T.cot_answer(F.col("prediction")), F.coalesce(F.get("golds", F.lit(0)), F.lit(""))
    is_long = F.col("benchmark").isin(*LONG_FORM)
    measured = rows.withColumns({"_p": F.when(is_long, answer), "_g": F.when(is_long, F.col("golds"))})
    measured = best_rouge_l(measured, "_p", "_g")
    uniform = F.when(F.col("benchmark").isin(*UNIFORM), T.uniform_score(F.col("benchmark"), F.col("prediction"), F.col("golds"), F.col("gold_label"))["em"])
    limit = F.lit(0.0)
    for name, value in LONG_FORM.items():
        limit = F.when(F.col("benchmark") == name, value).otherwise(limit)
    letters = T.exact_match(T.choice_label(answer), first)
    other = ~F.col("benchmark").isin(*BENCHMARKS) | F.col("benchmark").isNull()
    em = F.when(F.col("benchmark").isin(*UNIFORM), uniform).when(is_long, (F.col("rouge_l") > limit).cast("double")).when(F.col("benchmark") == "arc_challenge", letters).when(other, T.exact_match(answer, first))
    f1 = (
        F.when(F.col("benchmark").isin("triviaqa", "natural_questions"), T.best_token_f1(answer, F.col("golds"))).when(is_long, F.col("rouge_l"))
        .when(other, T.token_f1(answer, first)).otherwise(F.col("em"))
    )
    return measured.withColumn("em", em).withColumn("f1", f1).drop("_p", "_g", "rouge_l")


def format_counts(rows: DataFrame) -> DataFrame:
    """benchmark, n, and for each fault of form the number of answers that have it; `identical` is how often the most frequent
    answer of the benchmark comes."""
    x = F.coalesce("answer", F.lit(""))
    marked = x.rlike(MARKED)
    on = lambda name: F.col("benchmark") != name
    faults = {
        "empty": (F.trim(x) == "") | (F.lower(F.trim(x)) == REASONING_ONLY),
        "no_answer_line": ~marked,
        "empty_answer_line": x.rlike(MARK_LAST),
        "refusal": F.right(x, F.lit(REFUSAL_TAIL)).rlike(REFUSAL),
        "fever_label_on_other": on("fever") & x.rlike(FEVER_MARKED),
        "letter_on_other": on("commonsense_qa") & F.trim(x).rlike(LETTER_MARKED),
        "likely_truncated": (F.length(x) > LONG_ANSWER) & ~marked,
    }
    flagged = rows.select("benchmark", F.xxhash64(x).alias("h"), F.md5(x).alias("k"), *(c.cast("int").alias(n) for n, c in faults.items()))
    same = flagged.groupBy("benchmark", "h", "k").agg(F.count("*").alias("c"), *(F.sum(n).alias(n) for n in faults))
    return same.groupBy("benchmark").agg(F.sum("c").alias("n"), *(F.sum(n).alias(n) for n in faults), F.max("c").alias("identical"))

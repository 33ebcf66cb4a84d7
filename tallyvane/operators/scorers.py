"""Scorers of premise and hypothesis that users bring, and what is made of their scores.

A scorer is a function of two Arrow arrays with declared outputs. It is registered by name and runs in tasks, a batch at a
time. Hypotheses are written from a query and its answer: a claim and its negation, the text of a chosen option, a bare name as
a sentence, or the answer itself; each meets every passage, and the first kind that applies says how well the answer stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import answers as A
from tallyvane.functions import confidence as C
from tallyvane.functions.text import let, words

# How an option and a bare name are written as hypotheses, and answers that are no name.
OPTION_HYPOTHESIS, NAME_HYPOTHESIS = "The answer to the question is: ", "Answer: "
NO_NAME = (*A.REFUSALS, *A.DECLARATIVE)
#: Answers shorter than this are not split into facts.
LEAST_TOKENS = 12
#: Kinds of hypotheses, the first that applies counts.
KINDS = ("directional", "multichoice", "entity", "plain")

Score = Callable[[pa.Array, pa.Array], Mapping[str, pa.Array]]


@dataclass(frozen=True)
class Scorer:
    """outputs are the columns of doubles that the function returns for premises and hypotheses, a value a pair."""

    name: str
    function: Score
    outputs: tuple[str, ...] = ("entail",)

    def check(self, found: Mapping[str, pa.Array], rows: int) -> list[pa.Array]:
        if set(found) != set(self.outputs) or any(len(x) != rows for x in found.values()):
            raise ValueError(f"{self.name} must return {self.outputs}, a value a pair")
        return [pc.cast(found[c], pa.float64()) for c in self.outputs]


SCORERS: dict[str, Scorer] = {}


def register(scorer: Scorer) -> Scorer:
    if scorer.name in SCORERS:
        raise ValueError(f"a scorer is already called {scorer.name}")
    SCORERS[scorer.name] = scorer
    return scorer


def score_pairs(pairs: DataFrame, scorer: Scorer | str, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """pairs with the scorer's columns, held to [0, 1]; NaN and infinite scores are null. A null text is an empty one."""
    known = SCORERS[scorer] if isinstance(scorer, str) else scorer
    taken = {c.lower() for c in pairs.columns} & {c.lower() for c in known.outputs}
    if taken:
        raise ValueError(f"pairs already have {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pc.fill_null(batch.column(c), "") for c in (premise, hypothesis)]
            found = known.check(known.function(*texts), batch.num_rows)
            held = [pc.min_element_wise(pc.max_element_wise(pc.if_else(pc.is_finite(x), x, None), 0.0, skip_nulls=False), 1.0, skip_nulls=False) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *held], names=[*batch.schema.names, *known.outputs])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *(StructField(c, DoubleType()) for c in known.outputs)]))


def is_bare_name(answer: Column) -> Column:
    """Whether an answer is a short name: at most five words, no verb, no refusal or label."""
    bare = F.lower(_trimmed(answer))
    tokens = words(bare)
    return (bare != "") & ~bare.isin(*NO_NAME) & (F.size(tokens) <= A.LONGEST_ENTITY) & ~F.exists(tokens, lambda w: w.isin(*A.VERBS))


def _trimmed(answer: Column) -> Column:
    return A.stripped(F.regexp_replace(A.stripped(F.coalesce(answer, F.lit(""))), r"[\s.?!,:;'\"]+\z", ""))


def hypotheses(query: Column, answer: Column) -> Column:
    """array<struct<kind, negated, hypothesis>> of an answer, in the order of KINDS; the plain one is always there."""

    def made(s: Column) -> Column:
        q, a = s["q"], s["a"]
        claim, label = A.claim_of(q), A.claim_label(q, a)
        option = F.try_element_at(A.options(q), F.coalesce(A.answer_letter(a), F.lit("")))
        one = lambda kind, negated, text: F.struct(F.lit(kind).alias("kind"), F.lit(negated).alias("negated"), text.alias("hypothesis"))
        directional = claim.isNotNull() & label.isNotNull()
        return F.filter(
            F.array(
                one("directional", False, F.when(directional, claim)),
                one("directional", True, F.when(directional, A.negate(claim))),
                one("multichoice", False, F.when(A.asks_for_letter(q), F.concat(F.lit(OPTION_HYPOTHESIS), option))),
                one("entity", False, F.when(A.claim_task(q).isNull() & ~A.asks_for_letter(q) & is_bare_name(a), F.concat(F.lit(NAME_HYPOTHESIS), _trimmed(a), F.lit(".")))),
                one("plain", False, a),
            ),
            lambda h: h["hypothesis"].isNotNull(),
        )

    return let(F.struct(F.coalesce(query, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a")), made)


def ground(rows: DataFrame, key: str, scorer: Scorer | str, output: str = "entail", query: str = "query", answer: str = "answer", passages: str = "passages") -> DataFrame:
    """key, kind, p_ground_max, p_ground_mean: how far a row's passages bear its answer out, by the first kind of hypothesis
    that has scores: a claim and its negation by the answer's direction, an option's text, a bare name, the answer itself.

    A row's passages and hypotheses are scored where it lies, and a key's scores meet in partial aggregates; passages that
    the scorer gives no score are left out; a row without passages, or whose key is null, is missing. A key names one row.
    """
    q, a = F.col(query), F.col(answer)
    made = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), A.claim_label(q, a).alias("label"), F.explode(hypotheses(q, a)).alias("h"), F.col(passages).alias("p"))
    pairs = made.select("k", "label", "h.*", F.explode("p").alias("premise"))
    scored = score_pairs(pairs, scorer)
    of = lambda f, kind, negated: f(F.when((F.col("kind") == kind) & (F.col("negated") == negated), F.col(output)))
    sides = [(kind, negated) for kind in KINDS for negated in ((False, True) if kind == "directional" else (False,))]
    sums = scored.groupBy("k").agg(F.max("label").alias("label"), *(of(f, *s).alias(f"{s[0]}_{s[1]}_{n}") for s in sides for f, n in ((F.max, "max"), (F.avg, "mean"))))
    directional = C.directional(F.col("label"), *(F.col(f"directional_{s}_{n}") for s in (False, True) for n in ("max", "mean")))
    pair = lambda kind: F.when(F.col(f"{kind}_False_max").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_False_max").alias("p_ground_max"), F.col(f"{kind}_False_mean").alias("p_ground_mean")))
    named = F.when(F.col("d").isNotNull() & F.col("d.p_ground_max").isNotNull(), F.struct(F.lit("directional").alias("kind"), "d.p_ground_max", "d.p_ground_mean"))
    best = sums.withColumn("d", directional).select("k", F.coalesce(named, *(pair(kind) for kind in KINDS[1:])).alias("b"))
    return best.select(F.col("k").alias(key), "b.kind", "b.p_ground_max", "b.p_ground_mean").filter("kind is not null")


def atomic_grounding(rows: DataFrame, facts: DataFrame, key: str, answer: str = "answer", mean: str = "p_ground_mean", fact: str = "fact", score: str = "score") -> DataFrame:
    """key, p_ground_atomic: the least over an answer's facts (key, fact, score) of the most over passages; the mean grounding
    of answers of fewer than LEAST_TOKENS words, and of those without scored facts."""
    best = facts.groupBy(key, fact).agg(F.max(score).alias("best")).groupBy(key).agg(F.min("best").alias("least"))
    joined = rows.select(key, F.size(words(F.col(answer))).alias("n"), F.col(mean).alias("mean")).join(best, key, "left")
    return joined.select(key, F.when(F.col("n") < LEAST_TOKENS, F.col("mean")).otherwise(F.coalesce("least", "mean")).alias("p_ground_atomic"))


def verify(rows: DataFrame, key: str, scorer: Scorer | str, knots: Mapping[str, Sequence[tuple[float, float]]], weights: Mapping[str, float] | None = None, intercept: float = 0.0, output: str = "entail") -> DataFrame:
    """From signals to a decision: rows (key, query, answer, passages, u_token, u_dropout and other signals) with u_internal,
    kind, p_ground_max, p_ground_mean, early, u_stored and decision.

    Grounding comes from the scorer; a row without it counts as not grounded. A confident answer without grounding leaves
    early with a score of 0; others get the composite of the calibrated signals that `knots` names, among them u_internal
    and grounding where wanted, and a decision by its thresholds.
    """
    grounded = ground(rows, key, scorer, output)
    joined = rows.join(grounded, key, "left").withColumn("u_internal", C.u_internal(F.col("u_token"), F.col("u_dropout")))
    bare = F.coalesce("p_ground_max", F.lit(0.0))
    early = F.coalesce(C.early_exit(F.col("u_internal"), bare), F.lit(False))
    score = C.composite({name: F.col(name) for name in knots}, knots, weights, intercept)
    judged = joined.withColumn("early", early).withColumn("u_stored", F.when(F.col("early"), 0.0).otherwise(score))
    return judged.withColumn("decision", F.when(F.col("early"), "DISCARD").otherwise(C.decide(F.col("u_stored"), bare)))


def ensemble(name: str, parts: Sequence[Scorer], how: str, output: str = "entail") -> Scorer:
    """One score of several scorers: the least ("min"), the largest ("max"), or 1 where more than half reach one half and 0
    elsewhere ("majority"). What a scorer leaves out counts for neither side."""
    if how not in ("min", "max", "majority") or not parts:
        raise ValueError("an ensemble is the min, max or majority of some scorers")

    def score(premises: pa.Array, texts: pa.Array) -> dict[str, pa.Array]:
        found = [pc.cast(p.function(premises, texts)[output], pa.float64()) for p in parts]
        if how != "majority":
            return {output: (pc.min_element_wise if how == "min" else pc.max_element_wise)(*found)}
        votes = [pc.fill_null(pc.greater_equal(x, 0.5), False).cast(pa.int64()) for x in found]
        total = votes[0]
        for v in votes[1:]:
            total = pc.add(total, v)
        return {output: pc.greater(pc.multiply(total, 2), len(found)).cast(pa.float64())}

    return Scorer(name, score, (output,))


def by_length(name: str, short: Scorer, long: Scorer, words_: int = 408, output: str = "entail") -> Scorer:
    """Pairs of at most so many words go to one scorer, longer ones to another; each sees its own pairs alone."""

    def score(premises: pa.Array, texts: pa.Array) -> dict[str, pa.Array]:
        n = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.binary_join_element_wise(premises, texts, " "))))
        small = pc.less_equal(n, words_)
        at = pc.indices_nonzero(small), pc.indices_nonzero(pc.invert(small))
        parts = [pc.cast(s.function(premises.take(i), texts.take(i))[output], pa.float64()) if len(i) else pa.array([], pa.float64()) for s, i in zip((short, long), at, strict=True)]
        order = pc.sort_indices(pa.concat_arrays([*at]))
        return {output: pa.concat_arrays(parts).take(order)}

    return Scorer(name, score, (output,))


def _overlap(premises: pa.Array, hypotheses_: pa.Array) -> dict[str, pa.Array]:
    """Share of a hypothesis' words that the premise has; 0 without words."""
    split = lambda x: pc.split_pattern(pc.utf8_lower(x), " ").to_pylist()
    out = []
    for p, h in zip(split(premises), split(hypotheses_), strict=True):
        there, asked = set(p), {w for w in h if w}
        out.append(len(asked & there) / len(asked) if asked else 0.0)
    return {"entail": pa.array(out, pa.float64())}


#: A plain scorer, for tests and where no model is at hand.
OVERLAP = register(Scorer("word_overlap", _overlap))

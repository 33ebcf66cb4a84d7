"""Routing, verification and calibration rules as Column expressions. Thresholds are parameters with the usual defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def apply_temperature(p: Column, temperature: Column | float, eps: float = 1e-6) -> Column:
    """A probability with its logit divided by a temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return sigmoid(logit(clip(p, eps, 1 - eps)) / t)


def pre_confidence(u_token: Column, c_conv: Column) -> Column:
    """Confidence before routing, from token certainty and convergence of the stored chain."""
    return clip(0.6 * u_token + 0.4 / (1.0 + c_conv))


def route(similarity: Column, u_stored: Column, u_pre: Column, floor: Column, share: float = 0.7, tier1: float = 0.9, tier2: float = 0.75) -> Column:
    """Tier 3 whatever the match where confidence is under the floor; else 1 from tier1 of the score, 2 above tier2 of the
    similarity, 3 otherwise."""
    score = share * similarity + (1 - share) * u_stored
    return F.when(u_pre < floor, 3).when(score >= tier1, 1).when(similarity > tier2, 2).otherwise(3)


def linear_probability(features: Mapping[str, Column], weights: Mapping[str, float], intercept: float) -> Column:
    """A logistic model over named features; a feature without a value counts nothing."""
    total = F.lit(intercept)
    for name, w in weights.items():
        total = total + F.coalesce(features[name], F.lit(0.0)) * w
    return sigmoid(total)


def consult(tier: Column, p_retrieve: Column, threshold: float = 0.5) -> Column:
    """At tier 3 a utility model may send the query to 2 (answer directly); without a probability nothing changes."""
    return F.when((tier == 3) & p_retrieve.isNotNull() & (p_retrieve < threshold), 2).otherwise(tier)


def u_internal(u_token: Column, u_dropout: Column) -> Column:
    return 0.5 * u_token + 0.5 * (1.0 - u_dropout)


def early_exit(u_int: Column, p_ground_max: Column, confident: float = 0.70, grounded: float = 0.20) -> Column:
    return (u_int >= confident) & (p_ground_max <= grounded)


def decide(u_stored: Column, p_ground_max: Column, store: float = 0.60, defer: float = 0.45, grounded: float = 0.20) -> Column:
    return F.when(u_stored >= store, "STORE").when(u_stored >= defer, "DEFERRED").when(p_ground_max < grounded, "ABSTAIN").otherwise("DISCARD")


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y) knots in order, flat beyond the ends: a chain of conditions, no arrays."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        piece = F.lit(float(y1)) if x1 == x0 else F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(x < x1, piece).otherwise(out)
    return F.when(x <= knots[0][0], float(knots[0][1])).otherwise(out)


def composite(signals: Mapping[str, Column], knots: Mapping[str, Sequence[tuple[float, float]]], weights: Mapping[str, float] | None = None, intercept: float = 0.0) -> Column:
    """Mean (or weighted sum) of calibrated log odds over the signals that are there; one half if none is."""
    total, n = F.lit(intercept), F.lit(0)
    for name, points in knots.items():
        p = clip(interpolate(signals[name], points), 0.02, 0.98)
        total = total + F.when(signals[name].isNull(), 0.0).otherwise(logit(p) * (weights or {}).get(name, 1.0))
        n = n + signals[name].isNotNull().cast("int")
    scaled = total if weights else total / F.greatest(n, F.lit(1))
    return F.when(n == 0, 0.5).otherwise(sigmoid(scaled))


# Weights of the composite without a fit; h_norm, an entropy, counts by what it leaves to 1.
FALLBACK = {
    "p_ground_mean": 0.22, "p_ground_max": 0.18, "p_ground_atomic": 0.06, "p_entail": 0.14, "q_a_relevance": 0.20, "s_avg": 0.10, "u_internal": 0.08, "h_norm": 0.02,
}


def weighted_composite(signals: Mapping[str, Column], weights: Mapping[str, float] = FALLBACK) -> Column:
    """Weighted sum of signals, held to [0, 1]; one without a value counts one half."""
    total = F.lit(0.0)
    for name, w in weights.items():
        value = F.coalesce(signals[name], F.lit(0.5))
        total = total + (1.0 - value if name == "h_norm" else value) * w
    return clip(total)


# Tag, label and icon of each decision, and what users are told.
ENVELOPES = {
    "STORE": ("verified", "high", "check"), "DEFERRED": ("provisional", "moderate", "tilde"), "DISCARD": ("conflicting", "low", "warning"), "ABSTAIN": ("insufficient", "very_low", "cross"),
}
DISCARD_CAVEAT = "Evidence exists but some signals disagree \u2014 independent verification is recommended."
DEFERRED_CAVEAT = "I'll reconsider this at my next learning cycle. Please ask again later for an updated answer."
CADENCES = {
    "nightly": "in my nightly learning cycle. Please ask again tomorrow", "hourly": "in my next hourly update. Please ask again in about an hour",
    "continuous": "shortly as my learning queue clears. Please ask again in a few minutes", "shortly": "shortly. Please check back in a few minutes",
}


def deferred_caveat(eta: Column, cadence: Column) -> Column:
    """When an answer will be looked at again: by a stated time, else by a cadence, else in general."""
    known = F.create_map(*[F.lit(x) for pair in CADENCES.items() for x in pair])
    phrase = F.coalesce(F.try_element_at(known, cadence), F.concat(F.lit("in my "), cadence, F.lit(" learning cycle. Please check back soon")))
    return (
        F.when(F.coalesce(eta, F.lit("")) != "", F.concat(F.lit("I'll reconsider this around "), eta, F.lit(". Please ask again then.")))
        .when(F.coalesce(cadence, F.lit("")) != "", F.concat(F.lit("I'll reconsider this "), phrase, F.lit("."))).otherwise(DEFERRED_CAVEAT)
    )


def envelope(answer: Column, u_stored: Column, decision: Column, eta: Column | None = None, cadence: Column | None = None) -> Column:
    """struct<answer, confidence, tag, label, icon, show_answer, caveat, decision> for an answer on its way out; null for an
    unknown decision. A withheld answer is null."""
    nothing = F.lit(None).cast("string")
    pick = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for d, e in ENVELOPES.items() for x in (d, e[k])]), decision)
    caveat = F.when(decision == "DISCARD", DISCARD_CAVEAT).when(decision == "DEFERRED", deferred_caveat(nothing if eta is None else eta, nothing if cadence is None else cadence))
    made = F.struct(
        F.when(decision != "ABSTAIN", answer).alias("answer"), clip(u_stored).alias("confidence"), pick(0).alias("tag"), pick(1).alias("label"), pick(2).alias("icon"),
        (decision != "ABSTAIN").alias("show_answer"), caveat.alias("caveat"), decision.alias("decision"),
    )
    return F.when(decision.isin(*ENVELOPES), made)


def drift(worst: Column, safe: float = 1e-3, warn: float = 1e-2) -> Column:
    """Gate of a largest absolute difference; a bound itself belongs to the better side."""
    return F.when(worst > warn, "UNSAFE").when(worst > safe, "WARN").otherwise("SAFE")


def relevance(logit_: Column) -> Column:
    """Probability of a relevance logit held to [-30, 30]; one half without a finite one."""
    finite = logit_.isNotNull() & ~F.isnan(logit_) & (F.abs(logit_) != float("inf"))
    return F.when(finite, sigmoid(clip(logit_, -30.0, 30.0))).otherwise(0.5)


def uncertainty(positive: Column, negative: Column) -> Column:
    """How near one half both of two scores are: 1 at it, falling twice as fast beyond a tenth."""
    far = F.greatest(F.abs(positive - 0.5), F.abs(negative - 0.5))
    return clip(1.0 - F.when(far > 0.10, 4.0).otherwise(2.0) * far)


def directional(label: Column, pos_max: Column, pos_mean: Column, neg_max: Column, neg_mean: Column) -> Column:
    """struct<p_ground_max, p_ground_mean> by what an answer says of its claim: scores of the claim for "supports", of its
    negation for "refutes", nearness of both to one half for "not enough info"; null without a label, or where the claim
    has no negation and one is needed."""
    needs = label.isin("refutes", "not enough info")
    pick = lambda pos, neg: F.when(label == "supports", pos).when(label == "refutes", neg).otherwise(uncertainty(pos, neg))
    made = F.struct(pick(pos_max, neg_max).alias("p_ground_max"), pick(pos_mean, neg_mean).alias("p_ground_mean"))
    return F.when((label == "supports") | (needs & neg_max.isNotNull()), made)


def explain_route(u_pre: Column, similarity: Column, u_stored: Column, floor: float = 0.38, share: float = 0.7, tier1: float = 0.9, tier2: float = 0.75) -> Column:
    """A sentence or two on why a query goes to its tier."""
    score = share * similarity + (1 - share) * u_stored
    f = lambda x, places=4: F.format_string(f"%.{places}f", x)
    t = lambda x: F.lit(f"{x:.2f}")
    unsafe = F.concat(F.lit("u_pre="), f(u_pre), F.lit(" is below the safety floor "), t(floor), F.lit(": tier 3 whatever the match."))
    head = F.concat(F.lit("u_pre="), f(u_pre), F.lit(" is safe (floor "), t(floor), F.lit("). Score "), t(share), F.lit(" x "), f(similarity), F.lit(" + "), t(1 - share), F.lit(" x "), f(u_stored), F.lit(" = "), f(score))
    first = F.concat(head, F.lit(" reaches "), t(tier1), F.lit(": tier 1, direct retrieval."))
    second = F.concat(head, F.lit(" misses "), t(tier1), F.lit(", similarity exceeds "), t(tier2), F.lit(": tier 2, guided generation."))
    third = F.concat(head, F.lit(" misses "), t(tier1), F.lit(", similarity does not exceed "), t(tier2), F.lit(": tier 3, full retrieval."))
    tier = route(similarity, u_stored, u_pre, F.lit(floor), share, tier1, tier2)
    return F.when(u_pre < floor, unsafe).when(tier == 1, first).when(tier == 2, second).otherwise(third)

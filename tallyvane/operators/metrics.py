"""Metrics over answer records, each one pass of conditional aggregates. Counts stay integers until the last division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.operators.ranks import upto

from tallyvane.functions.text import MEASURED_EVASIVE, MEASURED_LEAK, any_of

SUBTYPES = (
    "confident_confabulation", "factual_fabrication", "factual_contradiction", "logical_fabrication", "off_topic",
    "defensive_evasion", "template_leak", "false_refusal", "over_long",
)
#: What the composite averages: all but contradiction.
MEASURED = tuple(s for s in SUBTYPES if s != "factual_contradiction")


def is_wrong() -> Column:
    """A missing em counts as wrong; a fractional one as neither wrong nor right."""
    return F.coalesce(F.col("em"), F.lit(0.0)) == 0.0


def is_correct() -> Column:
    return F.coalesce(F.col("em"), F.lit(0.0)) == 1.0


def subtype_flags() -> dict[str, Column]:
    """A condition for each kind of hallucination; missing grounding, entailment and relevance never fire."""
    below = lambda name, t: F.coalesce(F.col(name) < t, F.lit(False))
    said = F.coalesce(F.col("prediction"), F.lit(""))
    return {
        "confident_confabulation": is_wrong() & (F.coalesce("u_stored", F.lit(0.0)) >= 0.5),
        "factual_fabrication": is_wrong() & below("p_ground_atomic", 0.3),
        "factual_contradiction": is_wrong() & (F.coalesce("p_contra", F.lit(0.0)) > 0.3),
        "logical_fabrication": is_wrong() & below("p_entail", 0.3),
        "off_topic": is_wrong() & below("q_a_relevance", 0.5),
        "defensive_evasion": is_wrong() & said.rlike(any_of(MEASURED_EVASIVE)),
        "template_leak": said.rlike(any_of(MEASURED_LEAK)),
        "false_refusal": is_correct() & F.coalesce(F.col("decision").isin("ABSTAIN", "DISCARD"), F.lit(False)),
        "over_long": is_wrong() & (F.length(said) > 600),
    }


def rate(condition: Column) -> Column:
    """Share of rows where condition holds."""
    return F.count(F.when(condition, 1)) / F.count(F.lit(1))


def hallucination_table(samples: DataFrame, by: list[str]) -> DataFrame:
    """Rates of all subtypes, their composite and the share of rows with any, per group."""
    flags = subtype_flags()
    flagged = samples.select(*by, *(c.alias(n) for n, c in flags.items()))
    hits = {n: F.count(F.when(F.col(n), 1)) for n in SUBTYPES}
    either = F.lit(False)
    for n in SUBTYPES:
        either = either | F.col(n)
    counted = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(f"{n}_hits") for n, c in hits.items()), F.count(F.when(either, 1)).alias("any_hits"))
    measured = sum((F.col(f"{n}_hits") for n in MEASURED), F.lit(0))
    return counted.select(
        *by, "n", *((F.col(f"{n}_hits") / F.col("n")).alias(f"{n}_rate") for n in SUBTYPES),
        (measured / (F.col("n") * len(MEASURED))).alias("chm"), (F.col("any_hits") / F.col("n")).alias("union_rate"),
    )


def sample_chm() -> Column:
    """A row's own share of measured subtypes; its mean is the composite."""
    flags = subtype_flags()
    return sum((flags[n].cast("int") for n in MEASURED), F.lit(0)) / len(MEASURED)


def routing_distribution(samples: DataFrame, by: list[str]) -> DataFrame:
    """Shares of tiers 1-3 among rows with such a tier, and of the others among all."""
    valid = F.col("tier").isin(1, 2, 3)
    n_valid = F.count(F.when(valid, 1))
    share = lambda t: F.coalesce(F.count(F.when(F.col("tier") == t, 1)) / F.nullif(n_valid, F.lit(0)), F.lit(0.0))
    return samples.groupBy(*by).agg(
        *(share(t).alias(f"tier{t}_frac") for t in (1, 2, 3)), n_valid.alias("n_valid"), rate(F.coalesce(~valid, F.lit(True))).alias("crash_frac")
    )


def auroc(rows: DataFrame, score: str, label: str, by: list[str], one_class: float | None = 0.5, times: str | None = None) -> DataFrame:
    """Area under the ROC curve from counts per distinct score: ties count half; one class alone gives `one_class`, which may
    be null. `times` may name a column that says how many rows one stands for.

    Sorting happens on distinct scores, and on pieces of their order, never on all of a group.
    """
    number = lambda which: F.sum(F.when(which, F.col(times) if times else F.lit(1)).otherwise(0))
    counts = rows.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        number(F.col(label) == 1).alias("pos"), number(F.coalesce(F.col(label) != 1, F.lit(True))).alias("neg")
    )
    ranked = upto(counts, by, score, {"below": "neg"})
    wins = F.sum(F.col("pos") * (F.col("below") * 2 + F.col("neg")))
    both = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.coalesce(wins / F.nullif(both * 2, F.lit(0)), F.lit(one_class).cast("double")).alias("auroc"))


def reliability_bins(rows: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    """bin, n, mean score and accuracy; every bin is listed, an empty one with its middle, 0 and 0."""
    width = 1.0 / n_bins
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    found = rows.groupBy(F.least(F.floor(clipped / F.lit(width)), F.lit(n_bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("conf"), F.avg(F.coalesce(F.col(label), F.lit(0.0))).alias("acc")
    )
    bins = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(found), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("conf", (F.col("bin") + 0.5) * F.lit(width)).alias("conf"), F.coalesce("acc", F.lit(0.0)).alias("acc")
    )


def expected_calibration_error(rows: DataFrame, score: str, label: str, n_bins: int = 10) -> DataFrame:
    bins = reliability_bins(rows, score, label, n_bins)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def edge_calibration_error(rows: DataFrame, score: str, label: str, by: list[str], n_bins: int = 15) -> DataFrame:
    """by, n, ece over bins [i/n, (i+1)/n), the last one closed: a score beyond [0, 1] counts in n but lies in no bin."""
    edges = [i / n_bins for i in range(1, n_bins)]
    c = F.col(score)
    bin_ = F.when((c >= 0) & (c <= 1), sum(((c >= e).cast("int") for e in edges), F.lit(0)))
    bins = rows.filter(c.isNotNull() & F.col(label).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg(score).alias("conf"), F.avg(label).alias("acc"))
    gap = F.when(F.col("bin").isNotNull(), F.col("k") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return bins.groupBy(*by).agg(F.sum("k").alias("n"), (F.sum(gap) / F.sum("k")).alias("ece"))


def floor_fit(rows: DataFrame, score: str, label: str, by: str, pooled: float = 0.38, target: float = 0.5, least: int = 20) -> DataFrame:
    """by, floor: the smallest of 0.00, 0.01 ... 1.00 from which at least the target share of rows is right; `pooled` with
    fewer than `least` rows, or where fewer than max(10, least / 2) are left before the target is reached.

    One pass: rows are counted by the highest step that they reach, and sums from above give what each step keeps.
    """
    # the steps are i * 0.01 as floats have them, so a row's step is the last that it reaches, not a quotient
    u = F.col(score).cast("double")
    guess = F.floor(u * 100).cast("int")
    at = lambda i: i.cast("double") * F.lit(0.01)
    step = F.when(u >= at(guess + 1), guess + 1).when(u >= at(guess), guess).otherwise(guess - 1)
    held = F.greatest(F.lit(-1), F.least(F.lit(100), step))
    known = rows.filter(u.isNotNull() & ~F.isnan(u) & (F.abs(u) != float("inf")) & F.col(by).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(by, held.alias("step")).agg(F.count("*").alias("n"), F.count(F.when(F.col(label) != 0, 1)).alias("hits"))
    listed = counts.groupBy(by).agg(F.sum("n").alias("total"), F.collect_list(F.struct("step", "n", "hits")).alias("s"))  # at most 102 steps
    steps = listed.select(by, "total", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i"), "s")
    from_ = lambda c: F.aggregate(F.filter("s", lambda x: x["step"] >= F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    judged = steps.select(by, "total", "i", from_("n").alias("kept"), from_("hits").alias("right"))
    thin = F.min(F.when(F.col("kept") < max(10, least // 2), F.col("i")))
    good = F.min(F.when((F.col("kept") > 0) & (F.col("right") / F.col("kept") >= target), F.col("i")))
    fitted = judged.groupBy(by).agg(F.max("total").alias("total"), thin.alias("thin"), good.alias("good"))
    fits = (F.col("total") >= least) & F.col("good").isNotNull() & (F.col("thin").isNull() | (F.col("good") < F.col("thin")))
    return fitted.select(by, F.when(fits, at(F.col("good"))).otherwise(pooled).alias("floor"))


def ces_axes(samples: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """by, n_samples, n_conf, acc, epi, cal for each group: mean em, 1 less the composite of hallucination, and 1 less twice the
    calibration error, held to one half. What has no rows to be measured on is null."""
    u, em = F.col("u_stored"), F.col("em")
    bin_ = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)) / F.lit(1.0 / n_bins)), F.lit(n_bins - 1))
    bins = samples.filter(u.isNotNull() & em.isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg("u_stored").alias("conf"), F.avg("em").alias("hit"))
    error = F.sum(F.col("k") * F.abs(F.col("conf") - F.col("hit"))) / F.sum("k")
    cal = bins.groupBy(*by).agg((1.0 - 2.0 * F.least(error, F.lit(0.5))).alias("cal"))
    plain = samples.groupBy(*by).agg(F.count("em").alias("n_samples"), F.count("u_stored").alias("n_conf"), F.avg("em").alias("acc"))
    chm = hallucination_table(samples, by).select(*by, (1.0 - F.col("chm")).alias("epi"))
    return plain.join(chm, by, "left").join(cal, by, "left")


def roll_up_axes(axes: DataFrame, by: list[str], eps: float = 0.01) -> DataFrame:
    """Axes of several benchmarks (acc, epi, ret, cal, ver with n_samples and n_conf) as one: means weighed by samples, cal by
    scored samples, without what is null; ces is made of the means, a null axis counting eps."""

    def mean(axis: str, weight: str) -> Column:
        w = F.when(F.col(axis).isNotNull() & (F.col(weight) > 0), F.col(weight))
        return (F.sum(F.col(axis) * w) / F.sum(w)).alias(axis)

    names = ("acc", "epi", "ret", "cal", "ver")
    rolled = axes.groupBy(*by).agg(*(mean(a, "n_conf" if a == "cal" else "n_samples") for a in names), F.sum("n_samples").alias("n_samples"), F.sum("n_conf").alias("n_conf"))
    return rolled.withColumn("ces", geometric_score(*(F.coalesce(a, F.lit(eps)) for a in names), eps=eps))


def geometric_score(*axes: Column, eps: float = 0.01) -> Column:
    """Geometric mean of axes, each held to [eps, 1]."""
    product = F.lit(1.0)
    for a in axes:
        product = product * F.least(F.greatest(a, F.lit(eps)), F.lit(1.0))
    return F.pow(product, F.lit(1.0 / len(axes)))


def concatenated_d(rows: DataFrame, signal: str, label: str, by: list[str]) -> DataFrame:
    """by, d: the difference of class means over the deviation of both classes taken together, held from 1e-6 up; 0 where a
    class is empty."""
    value, y = F.col(signal), F.col(label)
    both = F.when(y.isin(0.0, 1.0), value)
    stats = rows.groupBy(*by).agg(F.avg(F.when(y == 1.0, value)).alias("m1"), F.avg(F.when(y == 0.0, value)).alias("m0"), F.stddev_samp(both).alias("sd"))
    return stats.select(*by, F.coalesce((F.col("m1") - F.col("m0")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-6)), F.lit(0.0)).alias("d"))


def cohens_d(rows: DataFrame, signal: str, label: str, by: list[str]) -> DataFrame:
    """Difference of class means over the pooled deviation; null where a class has fewer than two rows."""
    one, zero = F.col(label) == 1.0, F.col(label) == 0.0
    value = F.col(signal)
    stats = rows.groupBy(*by).agg(
        *(f(F.when(c, value)).alias(f"{n}{k}") for k, c in (("1", one), ("0", zero)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), (F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0)))
    return stats.select(*by, "n1", "n0", d.alias("d"))


def spectrum_collapse(spectra: DataFrame, matrix: str, value: str, top: int = 8) -> DataFrame:
    """n, collapse: the mean over matrices of the share of the largest singular value among the `top` largest, 1 where all
    weight lies on it; null without a matrix that has a value above 0.

    spectra has a row a singular value; a matrix has few, its rank at most.
    """
    order = Window.partitionBy(matrix).orderBy(F.desc(value))
    kept = spectra.filter(F.col(value).isNotNull()).withColumn("place_", F.row_number().over(order)).filter(F.col("place_") <= top)
    ratios = kept.groupBy(matrix).agg((F.max(value) / F.nullif(F.sum(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0))).alias("r"))
    return ratios.agg(F.count("r").alias("n"), F.avg("r").alias("collapse"))

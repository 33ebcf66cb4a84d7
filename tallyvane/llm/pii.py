"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust a score.

Everything is a Column expression. Spark tells the matches of a pattern but not where they are; splitting the text at the
same pattern gives the stretches between them, and sums over both lengths give code point offsets.

The patterns below are those of the contract with look-behinds and possessive quantifiers added. A run of one character
class is then tried from its start only (or from the end of the match before, \\G), which finds the same leftmost matches
in linear time, however long the run. An account number's end is not settled by the pattern, which matches its first four
characters and looks ahead at up to 34: each end of a group there is tried, see account_number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm.common import table

#: Kinds in the order in which spans that start together are listed; the last two are this method's own.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Kinds whose pattern matches so many characters and has what it looks ahead at as its first group.
HEAD = {"iban": 4}
#: Lengths of account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
#: Score before context; base spans are reported whatever they score, added ones from THRESHOLD.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|bic|swift",
    "ssn": "ssn|social security|tax id",
}
CONTEXT_BOOST = 0.25
CONTEXT_CHARS = 40
THRESHOLD = 0.5
#: Prefix sums are made in blocks of this many, so that their cost stays far below the square of the matches.
BLOCK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10: its first four characters go last, letters count from A = 10."""
    packed = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def account_number(ahead: Column) -> Column:
    """The account number at the start of a run of groups, or null: of the ends of groups that pass, one of the country's
    length, else the last."""
    groups = F.split(ahead, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    good = F.filter(starts, lambda x: F.replace(x, F.lit(" "), F.lit("")).rlike("^[A-Z0-9]{15,34}$") & mod97(x))

    def ranked(x: Column) -> Column:
        n = F.length(F.replace(x, F.lit(" "), F.lit("")))
        return F.struct(F.lit(IBAN_LENGTHS).contains(F.concat(F.substring(x, 1, 2), n.cast("string"))).alias("listed"), n.alias("n"), x.alias("x"))

    return F.array_max(F.transform(good, ranked))["x"]


def _apart(raw: Column) -> Column:
    """Matches at their places, without those that start inside of one before."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        return F.struct(
            F.when(fresh, x["s"] + F.length(x["m"])).otherwise(a["at"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out")
        )

    return F.aggregate(raw, start, step, lambda a: a["out"])


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return match.isNotNull()  # by account_number
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _sums_before(values: Column) -> Column:
    """For an array of numbers, the sum of all before each: within blocks, then over blocks."""
    zero = F.lit(0)

    def running(xs: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
        return F.aggregate(xs, start, step, lambda s: s["out"])

    last_block = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(zero, last_block), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    starts = running(F.transform(blocks, lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, starts, lambda xs, s: F.transform(running(xs), lambda x: x + s)))


def _kind_spans(kind: str, rank: int, body: Column) -> Column:
    """The confirmed spans of one kind, from its matches, their places and the gaps."""

    def scored(x: Column) -> Column:
        start = x["s"] + F.element_at(F.col(f"_g_{kind}"), 1)
        left = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(body, left + 1, start - left))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), F.lit(CONTEXT_BOOST)).otherwise(F.lit(0.0))
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), F.least(score, F.lit(1.0)).alias("score")
        )

    raw = F.zip_with(F.col(f"_m_{kind}"), F.col(f"_s_{kind}"), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    if kind == "iban":
        raw = F.transform(raw, lambda x: F.struct(account_number(x["m"]).alias("m"), x["s"].alias("s")))
    good = F.filter(raw, lambda x: confirmed(kind, x["m"]))
    part = F.transform(_apart(good) if kind in HEAD else good, scored)
    if kind in ADDED:
        part = F.filter(part, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.size(f"_m_{kind}") > 0, part).otherwise(F.array())


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """(row, body, pii): each row of docs as a struct, so that no name in it meets one made here, its text and the spans."""
    kinds, body = (*BASE, *ADDED), F.col("body")
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = found.withColumns({f"_m_{k}": F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(int(k in HEAD))) for k in kinds})
    gaps = lambda k: F.transform(F.split(body, PATTERNS[k], -1), F.length)
    found = found.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, gaps(k)) for k in kinds})
    # start of match i = lengths of gaps 0..i and of matches 0..i-1
    taken = lambda k, m: F.lit(HEAD[k]) if k in HEAD else F.length(m)
    lengths = lambda k: F.zip_with(F.slice(F.col(f"_g_{k}"), 2, F.size(f"_m_{k}")), F.col(f"_m_{k}"), lambda g, m: g + taken(k, m))
    found = found.withColumns({f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, _sums_before(lengths(k))) for k in kinds})
    found = found.withColumn("_all", F.array_sort(F.concat(*(_kind_spans(k, rank, body) for rank, k in enumerate(kinds)))))
    listed = F.transform(F.col("_all"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return found.select("row", "body", listed.alias("pii"))


def find_spans(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with an array of struct<kind, start, end, score> in column `spans`, by start, then kind as listed.

    Offsets count code points, ends are exclusive. Each kind's matches are leftmost and do not overlap one another; those of
    different kinds may. A null or empty text has an empty array. Rows are independent of each other: repeated rows get
    the same answer, and no column but `text` is read. A column of docs named `spans` is replaced, every other one is kept
    as it is; an empty table gives no rows. Cost is linear in a text's length.
    """
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != spans]
    return _with_spans(docs, text).select(*kept, F.col("pii").alias(spans))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data in `text` replaced by its kind in square brackets.

    Overlapping spans are merged and take the name of the first. A null text stays null, an empty one empty; other columns,
    whatever their names, and the number of rows do not change; an empty table gives no rows.
    """
    body = F.col("body")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.concat(F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    whole = F.aggregate(F.col("pii"), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body))))
    of = F.col("row").getField
    changed = F.when(F.size("pii") > 0, whole).otherwise(of(text))
    return _with_spans(docs, text).select(*((changed if c == text else of(c)).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    is_base = lambda x: x["kind"].isin(*BASE)
    counts = [_count(k) for k in BASE]
    base = F.sha2(_joined(F.filter("pii", is_base)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.col("pii").getField("score").alias("scores"))

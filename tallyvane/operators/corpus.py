"""Sections and word windows of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyvane.functions.answers import stripped
from tallyvane.functions.text import words

SIZE, STEP, LEAST = 100, 90, 10
# Sections that carry no content.
NOISE = ("see also", "references", "external links", "notes", "bibliography", "further reading", "footnotes")


def chunks(docs: DataFrame, keys: list[str], text: str, title: str | None = None, size: int = SIZE, step: int = STEP, least: int = LEAST) -> DataFrame:
    """keys, chunk_no, chunk: windows of `size` words every `step`, after "title: " where there is one; the first window below
    `least` words ends a text. A null or short text has none."""
    cut = docs.select(*keys, *([F.col(title).alias("_t")] if title else []), words(F.col(text)).alias("_w")).filter(F.size("_w") >= least)
    last = F.floor((F.size("_w") - least) / step).cast("int")
    lead = F.when(F.coalesce("_t", F.lit("")) != "", F.concat("_t", F.lit(": "))).otherwise("") if title else F.lit("")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(lead, F.array_join(F.slice(F.col("_w"), i * step + 1, F.lit(size)), " ")))
    return cut.select(*keys, F.posexplode(windows).alias("chunk_no", "chunk"))


def sections(docs: DataFrame, key: str, text: str, title: str | None = None, least_words: int = 20) -> DataFrame:
    """key, section_no, title, body: paragraphs of texts of at least so many words. A first line of up to 7 words without a
    full stop, with lines after it, is a title and holds until the next; before the first it is the article's. A paragraph
    whose own title is a noisy one is left out; those after it are kept under that title."""
    whole = stripped(F.col(text))
    article = F.coalesce(stripped(F.col(title)), F.lit("")) if title else F.lit("")
    rows = docs.filter(F.size(words(F.col(text))) >= least_words).select(key, article.alias("_a"), F.posexplode(F.split(whole, "\n\n")).alias("section_no", "_p")).withColumn("_p", stripped(F.col("_p"))).filter("_p <> ''")
    lines = F.split("_p", "\n")
    first = stripped(F.element_at(lines, 1))
    titled = (F.size(lines) >= 2) & (F.size(words(first)) <= 7) & ~F.contains(first, F.lit("."))
    body = F.when(titled, stripped(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))).otherwise(F.col("_p"))
    upto = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.select(key, "section_no", "_a", F.when(titled, first).alias("_t"), body.alias("body")).withColumn("title", F.coalesce(F.last("_t", ignorenulls=True).over(upto), F.col("_a")))
    noisy = F.coalesce(F.lower("_t").isin(*NOISE), F.lit(False))
    return carried.filter(~noisy & (F.col("body") != "")).select(key, "section_no", "title", "body")


def passages(docs: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """key, section_no, chunk_no, chunk: the word windows of an article's sections, each after its section's title."""
    return chunks(sections(docs, key, text, title), [key, "section_no"], "body", "title")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, white space is single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))

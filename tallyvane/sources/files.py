"""Sources and sinks: benchmark loaders, per-cycle result files, signal lines, logs, snapshots and tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "id string, question string, prediction string, gold_answers array<string>, gold_label string, em double, f1 double, tier int, stored boolean, u_stored double, latency_ms double, decision string"
RESULT_SCHEMA = f"meta map<string,string>, samples array<struct<{', '.join(c.replace(' ', ':', 1) for c in SAMPLE_SCHEMA.split(', '))}>>"
#: Prompt that restricts a benchmark's answers.
PREFIX = {"fever": "Answer with one of: SUPPORTS, REFUTES, NOT ENOUGH INFO. ", "strategyqa": "Answer yes or no. "}


def _benchmark(rows: DataFrame, name: str, question: Column, answers: Column, label: Column, key: Column) -> DataFrame:
    asked = F.concat(F.lit(PREFIX.get(name, "")), question)
    return rows.select(asked.alias("question"), answers.alias("answers"), label.alias("gold_label"), key.cast("string").alias("id"), F.lit(name).alias("benchmark"))


def _choices(labels: Column, texts: Column) -> Column:
    """"Choices: (A) foo (B) bar" from parallel arrays."""
    return F.concat(F.lit("Choices: "), F.array_join(F.zip_with(labels, texts, lambda k, t: F.concat(F.lit("("), k, F.lit(") "), t)), " "))


def load_fever(rows: DataFrame, exclude_nei: bool = False) -> DataFrame:
    kept = rows.filter(F.upper("label") != "NOT ENOUGH INFO") if exclude_nei else rows
    label = F.lower("label")
    return _benchmark(kept, "fever", F.col("claim"), F.array(label), label, F.col("id"))


def load_strategyqa(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("answer"), "yes").otherwise("no")
    return _benchmark(rows, "strategyqa", F.col("question"), F.array(label), label, F.col("id"))


def load_triviaqa(rows: DataFrame) -> DataFrame:
    """Aliases as answers; without any, the normalised value."""
    aliases = F.col("answer.aliases")
    answers = F.when(F.coalesce(F.size(aliases), F.lit(0)) <= 0, F.array("answer.normalized_value")).otherwise(aliases)
    return _benchmark(rows, "triviaqa", F.col("question"), answers, F.lit(None).cast("string"), F.col("id"))


def load_natural_questions(rows: DataFrame) -> DataFrame:
    """All accepted answers; rows without any are left out."""
    kept = rows.filter(F.size("answer") > 0)
    return _benchmark(kept, "natural_questions", F.col("question"), F.col("answer"), F.lit(None).cast("string"), F.col("id"))


def load_truthfulqa(rows: DataFrame) -> DataFrame:
    """The correct answers; rows without any are left out."""
    kept = rows.filter(F.size("correct_answers") > 0)
    return _benchmark(kept, "truthfulqa", F.col("question"), F.col("correct_answers"), F.lit(None).cast("string"), F.col("id"))


def load_asqa(rows: DataFrame) -> DataFrame:
    """The long answers of the annotations, else the single answer; rows without a question or an answer are left out."""
    none = F.lit(None).cast("string")
    at = lambda c: F.col(c) if c in rows.columns else none
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    question = F.coalesce(filled(at("ambiguous_question")), filled(at("question")))
    long = F.filter(F.transform("annotations", lambda a: a["long_answer"]), lambda x: x.isNotNull() & (x != "")) if "annotations" in rows.columns else F.array().cast("array<string>")
    single = F.array_compact(F.array(filled(at("answer"))))
    answers = F.when(F.coalesce(F.size(long), F.lit(0)) > 0, long).otherwise(single)
    made = _benchmark(rows, "asqa", question, answers, none, at("sample_id"))
    return made.filter(F.col("question").isNotNull() & (F.size("answers") > 0))


def load_hotpotqa(rows: DataFrame) -> DataFrame:
    """One answer a question; rows without either are left out."""
    kept = rows.filter("coalesce(question, '') <> '' and coalesce(answer, '') <> ''")
    return _benchmark(kept, "hotpotqa", F.col("question"), F.array("answer"), F.lit(None).cast("string"), F.col("id"))


def load_choices(rows: DataFrame, name: str) -> DataFrame:
    question = F.concat(F.col("question"), F.lit(" "), _choices(F.col("choices.label"), F.col("choices.text")), F.lit(" Give the multiple choice letter."))
    return _benchmark(rows, name, question, F.array("answer"), F.col("answer"), F.col("id"))


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fever": load_fever,
    "strategyqa": load_strategyqa,
    "triviaqa": load_triviaqa,
    "natural_questions": load_natural_questions,
    "truthfulqa": load_truthfulqa,
    "asqa": load_asqa,
    "hotpotqa": load_hotpotqa,
    "arc_challenge": lambda rows: load_choices(rows, "arc_challenge"),
    "commonsense_qa": lambda rows: load_choices(rows, "commonsense_qa"),
}


def load_benchmark(name: str, rows: DataFrame) -> DataFrame:
    """rows in a benchmark's own shape as question, answers, gold_label, id, benchmark; an unknown name is refused."""
    if name not in LOADERS:
        raise ValueError(f"unknown benchmark {name}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name](rows)


def synthetic_samples(spark: SparkSession, benchmark: str, n: int, seed: int = 42) -> DataFrame:
    """n made samples whose labels go round, in the order of a hash of seed and number."""
    labels = {"fever": ("supports", "refutes", "not enough info"), "strategyqa": ("yes", "no"), "arc_challenge": tuple("ABCD"), "commonsense_qa": tuple("ABCDE")}.get(benchmark, ("answer",))
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("id") % len(labels) + 1).cast("int"))
    number = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8)
    return spark.range(n).select(F.concat(F.lit(f"{benchmark} question "), number, F.lit(" "), F.col("id").cast("string")).alias("question"), F.array(label).alias("answers"), label.alias("gold_label"), F.concat(F.lit(f"{benchmark}-"), F.col("id").cast("string")).alias("id"), F.lit(benchmark).alias("benchmark"))


def read_cycle_results(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of all "{benchmark}_cycle{N}.json" files of a folder, with benchmark and integer cycle; unreadable files and
    those of other names give nothing."""
    files = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    name = F.regexp_extract("_metadata.file_name", r"^(.+)_cycle([0-9]+)\.json$", 1)
    cycle = F.regexp_extract("_metadata.file_name", r"^(.+)_cycle([0-9]+)\.json$", 2)
    named = files.select(name.alias("benchmark"), F.nullif(cycle, F.lit("")).cast("int").alias("cycle"), F.explode("samples").alias("s"))
    return named.filter(F.col("cycle").isNotNull()).select("benchmark", "cycle", "s.*")


def read_signals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """Records of a text log: the groups of a pattern, each cast to the type that goes with its name."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*(F.regexp_extract("value", pattern, k).cast(kind).alias(name) for k, (name, kind) in enumerate(fields.items(), 1)))


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; NaN is written as such."""
    df.write.mode("overwrite").option("header", True).option("nanValue", "NaN").csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_signals(df: DataFrame, path: str, cycle: int, benchmark: str) -> None:
    """Signal records as lines of JSON, each under this cycle and benchmark, whatever it had there before."""
    write_jsonl(df.withColumns({"cycle": F.lit(cycle), "benchmark": F.lit(benchmark)}), path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Outcomes of a consolidation after those of the ones before."""
    write_jsonl(audit, path, append=True)


def write_atomic(df: DataFrame, path: str) -> None:
    """A table as JSON that is at `path` whole or not at all: written beside it, then renamed into its place. If that fails the
    table that was there is there again; if the process ends in between, it lies beside the place as `.before-`."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside, before, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.writing-{mark}", f"{path}.before-{mark}", path))
    files = there.getFileSystem(conf)
    try:
        df.write.json(beside.toString())
        swap(files, beside, there, before)
    finally:
        files.delete(beside, True)


def swap(files, beside, there, before) -> None:
    """Put what is beside in its place; what was there goes only once the new one is, and comes back if it cannot be."""
    held = files.exists(there)
    if held and not files.rename(there, before):
        raise OSError(f"could not move {there} aside")
    moved = False
    try:
        moved = files.rename(beside, there)
        if not moved:
            raise OSError(f"could not move {beside} to {there}")
    finally:
        if held and not moved:
            files.rename(before, there)
    if held:
        files.delete(before, True)


def save_snapshot(entries: DataFrame, folder: str, cycle: int) -> None:
    """A cycle's snapshot; writing the same cycle again replaces it alone."""
    entries.write.mode("overwrite").parquet(f"{folder}/cycle={cycle}")


def load_snapshot(spark: SparkSession, folder: str, cycle: int | None = None) -> DataFrame:
    """One cycle's snapshot, or all with their cycle as a column."""
    return spark.read.parquet(folder) if cycle is None else spark.read.parquet(f"{folder}/cycle={cycle}")

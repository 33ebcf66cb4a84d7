"""Streams: windows over events with late data, and memory maintenance with a micro-batch as its cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyvane.operators import corpus
from tallyvane.sources.staging import Scratch


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per time window and type; rows later than `late` are dropped by the
    watermark. Works alike on a stream and on a table."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def maintain(stream: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `cycle(batch, number)` for every micro-batch, all that is there now, then stop. The batch number is the cycle, and
    the checkpoint makes a repeated batch keep its number, so that a cycle that overwrites its own snapshot is exact."""
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_corpus(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100, max_passages: int | None = None) -> StreamingQuery:
    """The passages of articles (id, title, text) in the Parquet files of a folder, so many files at a time: `sink(passages,
    number)` is called for each batch, and a later call goes on with files that are new since. With `max_passages` the scan
    hands on no more than that, of the last batch those of smallest hash, and passes by what comes after."""
    left = [max_passages]

    def bounded(passages: DataFrame, number: int) -> None:
        if left[0] is None:
            return sink(passages, number)
        if left[0] > 0:
            kept = passages.orderBy(F.xxhash64(*passages.columns), *passages.columns).limit(left[0]).persist()
            try:
                sink(kept, number)
                left[0] -= kept.count()
            finally:
                kept.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return maintain(stream, lambda batch, number: bounded(corpus.passages(batch, "id", "text", "title"), number), checkpoint)


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windows_now(spark: SparkSession, folder: str, schema: str, scratch: Scratch, size: str = "1 day") -> DataFrame:
    """Windows over a stream of event files, all that are there now: each micro-batch writes the whole result so far, and the
    last one's is returned."""
    events, last = read_events(spark, folder, schema), {}
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant; windows are given back without zone

    def keep(result: DataFrame, number: int) -> None:
        last["table"] = scratch(result.withColumn("start", F.col("start").cast("timestamp_ntz")), "windows")

    query = event_windows(events, size).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.folder}/windows-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return last["table"]

"""Watching a folder of unit records: every change runs the whole reduce again, as its verdicts need all units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strideway.sources import facts


def arrivals(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the lines of record files that appear in a folder."""
    reader = spark.readStream.format("text")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.load(path)


def watch(spark: SparkSession, path: str, checkpoint: str, rescan: Callable[[DataFrame, int], None], every: str | None = None,
    files_a_batch: int | None = None) -> StreamingQuery:
    """Calls ``rescan(records, batch)`` with all records so far whenever new files have come; without ``every``, for what is there now."""

    def on_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            rescan(facts.shards(spark, path)[0], number)

    writer = arrivals(spark, path, files_a_batch).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rule_rates(events: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) by tumbling windows of a stream or table of timed rows; later rows than ``late`` are left out of a stream."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    return timed.withWatermark("__t", late).groupBy(F.window("__t", window),
        key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def merged_signals_stream(signals: DataFrame, flags: list[str]) -> DataFrame:
    """Running merge of type signals in update mode: flags are OR-ed, accessors added."""
    return signals.groupBy("type").agg(*(F.max(F.col(f).cast("int")).cast("boolean").alias(f) for f in flags),
        F.sum("accessors").alias("accessors"))

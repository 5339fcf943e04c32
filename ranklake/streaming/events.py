"""Structured Streaming over event tables: an extension, beyond what batch tables offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark; its time column may lack a zone, and is then taken as the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than the watermark are dropped in a stream."""
    e = _timed(events, time, late)
    return e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = _timed(events, time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, time: str, keys: Sequence[str], late: str = "2 hours") -> DataFrame:
    """Drops repeats of a key within the watermark; state does not grow beyond it."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return _timed(events, time, late).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote to a memory table (for tests and small tables)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet with exactly-once commits; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

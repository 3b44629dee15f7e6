"""Event metrics as streams, with the same results as the batch forms over the same events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, `files` at a time (STR01). Watermarks need instants: wall-clock times are taken in the session's time zone."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling hours under a watermark (STR02): an hour is final, and its state gone, once `delay` has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "requests", "errors", "value")


def sliding_rate(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events of each minute-long window that starts every ten seconds (STR03)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute", "10 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user under a watermark."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def running_counters(events: DataFrame) -> DataFrame:
    """Counters by event type that outlive the process (STR01, STR04): (event_type, n, total), after each batch in which it occurs."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "total": [total]})

    return events.select("event_type", "value").groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, total double", "n long, total double", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns its memory table; for tests and small results, such as one row an hour."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

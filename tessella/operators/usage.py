"""Usage metrics of events, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hourly(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(hour, requests, errors, users, value): tumbling hours by event time (AGG05, STR02)."""
    return events.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "requests", "errors", "value")


def by_operation(events: DataFrame, since=None, ts: str = "ts") -> DataFrame:
    """(event_type, n, timed, total, mean_timed, mean_all): both averages, since events without a duration count in only one (AGG05)."""
    recent = events if since is None else events.where(F.col(ts) >= since)
    total = F.coalesce(F.sum("value"), F.lit(0.0))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("timed"), total.alias("total"), F.avg("value").alias("mean_timed"), (total / F.count(F.lit(1))).alias("mean_all"))


def minute_rate(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(event_id, in_minute): events of the 60 seconds up to each, itself included (STR03, WIN06).

    Events are first counted by second, so the window is over seconds that occur; its partitions are days, each with the
    minute before it, so that no task holds all of time.
    """
    second = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")
    seconds = events.groupBy(second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("s") / 86400)
    dealt = seconds.withColumn("day", day).unionByName(seconds.where("s % 86400 >= 86341").withColumn("day", day + 1))
    rate = F.sum("n").over(W.partitionBy("day").orderBy("s").rangeBetween(-59, 0))
    return dealt.withColumn("in_minute", rate).where(F.col("day") == day).select("s", "n", "in_minute")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n) of sessions that end after `gap` without events (AGG06); Spark's session windows merge on the map side."""
    out = events.groupBy(F.col(user), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return out.select(user, F.col("w.start").alias("start"), "last", "n")


def top(events: DataFrame, key: str = "event_type", most: int = 5) -> DataFrame:
    """The most frequent keys; of equals the one seen first (TOP06)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first")).orderBy(F.desc("n"), "first").limit(most).drop("first")

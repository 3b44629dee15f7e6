"""Usage of events, batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import usage as U
from tessella.plans.registry import query, table
from tessella.storage import shared_dir
from tessella.streaming import metrics


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 6) AS value FROM events GROUP BY 1")
def events_hourly_metrics(spark, sf_dir):
    """AGG05, STR02."""
    return U.hourly(_events(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("SELECT event_type, count(*) AS n, count(value) AS timed, round(sum(value), 6) AS total, round(avg(value), 6) AS mean_timed, round(sum(value) / count(*), 6) AS mean_all FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY event_type")
def events_recent_operations(spark, sf_dir):
    """AGG05: the last 24 hours by operation."""
    e = _events(spark, sf_dir)
    since = e.agg(F.max("ts") - F.expr("INTERVAL 24 HOURS")).first()[0]
    return U.by_operation(e, F.lit(since)).select("event_type", "n", "timed", *(F.round(c, 6).alias(c) for c in ("total", "mean_timed", "mean_all")))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT md5(props)) AS distinct_queries, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6)::DOUBLE AS error_percent, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 6)::DOUBLE AS view_percent FROM events")
def events_summary(spark, sf_dir):
    """AGG06."""
    share = lambda k: F.round(100.0 * F.count_if(F.col("event_type") == k) / F.count(F.lit(1)), 6)
    return _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.md5("props")).alias("distinct_queries"), share("error").alias("error_percent"), share("view").alias("view_percent"))


@query("""WITH s AS (SELECT floor(epoch(ts))::BIGINT AS s, count(*) AS n FROM events GROUP BY 1) SELECT s, n, sum(n) OVER (ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)::BIGINT AS in_minute FROM s""")
def events_minute_rate(spark, sf_dir):
    """STR03, WIN06."""
    return U.minute_rate(_events(spark, sf_dir))


@query("""WITH s AS (SELECT floor(epoch(ts))::BIGINT AS s, count(*) AS n FROM events GROUP BY 1) SELECT max(m)::BIGINT AS peak FROM (SELECT sum(n) OVER (ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM s)""")
def events_peak_rate(spark, sf_dir):
    """AGG06, WIN06."""
    return U.minute_rate(_events(spark, sf_dir)).agg(F.max("in_minute").alias("peak"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    """AGG06."""
    return U.sessions(_events(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, min((ts, event_id)) LIMIT 5")
def events_top_types(spark, sf_dir):
    """TOP06."""
    return U.top(_events(spark, sf_dir))


@query("SELECT event_type, sum((props->>'$.k')::INT)::BIGINT AS k, count(*) FILTER (props->>'$.k' IS NULL) AS missing FROM events GROUP BY event_type")
def events_metadata(spark, sf_dir):
    """STR01: metadata of events, from JSON by schema."""
    k = F.from_json("props", "k int")["k"]
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("k"), F.count_if(k.isNull()).alias("missing"))


@query("SELECT event_id // 1000 AS batch, min(event_id) AS event_id FROM events GROUP BY 1")
def request_batches(spark, sf_dir):
    """STR06: ids in batches of a thousand, with each batch's first."""
    return _events(spark, sf_dir).groupBy(F.expr("event_id div 1000").alias("batch")).agg(F.min("event_id").alias("event_id"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 6) AS value FROM events GROUP BY 1")
def events_hourly_stream(spark, sf_dir):
    """STR01, STR02: the hourly metrics as a stream over the same file, run until nothing is left."""
    run = uuid.uuid4().hex
    stream = metrics.hourly(metrics.read_events(spark, sf_dir, pattern="events.parquet"), "60 days")
    return metrics.drain(stream, f"hourly_{run}", "complete", shared_dir(spark)).withColumns({"hour": F.col("hour").cast("timestamp_ntz"), "value": F.round("value", 6)})

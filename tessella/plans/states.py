"""Keyed state over the stream of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.storage import shared_dir
from tessella.streaming import metrics, state

_DAY = 86_400


@query("""WITH e AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), l AS (SELECT user_id, max(r) AS resets FROM e GROUP BY user_id)
SELECT l.user_id, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 6) AS total, l.resets::BIGINT AS resets FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.r = l.resets AND e.event_type <> 'error' GROUP BY ALL""")
def events_counters_stream(spark, sf_dir):
    """STR04: each user's events since the last error, as state of a stream."""
    events = metrics.read_events(spark, sf_dir, pattern="events.parquet").withColumn("reset", F.col("event_type") == "error")
    out = state.latest(state.run(state.counters(events, "user_id"), shared_dir(spark), shared_dir(spark)))
    return out.select(F.col("id").alias("user_id"), "n", F.round("total", 6).alias("total"), "resets")


@query(f"""SELECT user_id, r.h::BIGINT AS hits, r.m::BIGINT AS misses FROM (SELECT user_id, list_reduce(list_prepend({{'e': 0::BIGINT, 'h': 0, 'm': 0}}, list_transform(list(epoch_ms(ts) ORDER BY ts), lambda t: {{'e': t, 'h': 0, 'm': 0}})),
  lambda a, x: CASE WHEN x.e < a.e THEN {{'e': a.e, 'h': a.h + 1, 'm': a.m}} ELSE {{'e': x.e + {_DAY * 1000}, 'h': a.h, 'm': a.m + 1}} END) AS r FROM events GROUP BY user_id)""")
def events_cache_stream(spark, sf_dir):
    """STR05: hits and misses of a cache by user whose entries live a day."""
    events = metrics.read_events(spark, sf_dir, pattern="events.parquet")
    out = state.latest(state.run(state.cache_use(events, "user_id", _DAY), shared_dir(spark), shared_dir(spark)))
    return out.select(F.col("id").alias("user_id"), "hits", "misses")

"""Streams give what the batch forms give over the same events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tessella.operators import usage
from tessella.streaming import metrics


@pytest.fixture
def folder(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    out = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(out)
    return out


def instants(spark, folder):
    return spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_hourly(spark, folder, tmp_path):
    stream = metrics.hourly(metrics.read_events(spark, folder, 2), "60 days")
    got = metrics.drain(stream.withColumn("value", F.round("value", 6)), "hourly", "complete", str(tmp_path / "c"))
    want = usage.hourly(instants(spark, folder)).withColumn("value", F.round("value", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_watermark_finishes_hours(spark, folder, tmp_path):
    got = metrics.drain(metrics.hourly(metrics.read_events(spark, folder, 1), "1 hour"), "closed", "append", str(tmp_path / "c"))
    want = {r.hour: r.requests for r in usage.hourly(instants(spark, folder)).collect()}
    rows = got.collect()
    assert rows and all(want[r.hour] == r.requests for r in rows)


def test_sliding_rate(spark, folder, tmp_path):
    got = metrics.drain(metrics.sliding_rate(metrics.read_events(spark, folder), "60 days"), "rate", "complete", str(tmp_path / "c"))
    assert got.agg(F.sum("n")).first()[0] == 6 * instants(spark, folder).count()


def test_sessions(spark, folder, tmp_path):
    got = metrics.drain(metrics.user_sessions(metrics.read_events(spark, folder), delay="60 days"), "sessions", "complete", str(tmp_path / "c"))
    want = usage.sessions(instants(spark, folder))
    assert sorted((r.user_id, r.start, r.n) for r in got.collect()) == sorted((r.user_id, r.start, r.n) for r in want.collect())


def test_counters_outlive_batches(spark, folder, tmp_path):
    got = metrics.drain(metrics.running_counters(metrics.read_events(spark, folder)), "counters", "update", str(tmp_path / "c"))
    last = {r.event_type: r.n for r in got.groupBy("event_type").agg(F.max("n").alias("n")).collect()}
    assert last == {r.event_type: r.n for r in usage.by_operation(instants(spark, folder)).collect()}


def test_distinct_events(spark, folder, tmp_path):
    twice = metrics.read_events(spark, folder)
    got = metrics.drain(metrics.distinct_events(twice.unionByName(twice), "60 days"), "once", "append", str(tmp_path / "c"))
    assert got.count() == instants(spark, folder).count()

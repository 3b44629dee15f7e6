"""Keyed state: restarts, resets and timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.streaming import state

ROWS = [(k, i, 1_700_000_000 + 600 * i, float(i % 5) if i % 4 else None, i in (7, 23) and k == "a" or None) for i in range(40) for k in ("a", "b", None) if (i + len(k or "")) % 3]
KINDS = "key string, event_id long, at long, value double, reset boolean"


def _land(spark, folder, rows, name):
    frame = spark.createDataFrame(rows, KINDS).withColumn("ts", F.timestamp_seconds("at"))
    frame.coalesce(1).write.parquet(f"{folder}/{name}")
    return frame.schema


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_counters_outlive_the_process(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))

    def want(rows):
        got = {}
        for k, i, _, v, reset in sorted(rows, key=lambda r: r[1]):
            n, total, resets = got.get(k, (0, 0.0, 0))
            got[k] = (0, 0.0, resets + 1) if reset else (n + 1, total + (v or 0), resets)
        return got

    done = []
    for name, part in (("1", ROWS[:30]), ("2", ROWS[30:60]), ("3", ROWS[60:])):
        schema = _land(spark, folder, part, name)
        done += part
        updates = state.run(state.counters(_stream(spark, folder, schema), "key"), out, checkpoint)  # a new query each time, from the checkpoint
        assert {r.id: (r.n, r.total, r.resets) for r in state.latest(updates).collect()} == want(done)
        assert {r.id: (r.n, r.total, r.resets) for r in state.stored_counters(spark, checkpoint).collect()} == want(done)


def test_a_reset_alone_is_kept(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for name, rows in (("1", [("a", 1, 0, 5.0, None)]), ("2", [("a", 2, 1, 9.0, True)]), ("3", [("b", 3, 2, 1.0, False)])):
        schema = _land(spark, folder, rows, name)
        state.run(state.counters(_stream(spark, folder, schema), "key"), out, checkpoint)
    assert {r.id: (r.n, r.total, r.resets) for r in state.stored_counters(spark, checkpoint).collect()} == {"a": (0, 0.0, 1), "b": (1, 1.0, 0)}


def test_cache_entries_end(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    ttl, got = 3000, None
    for name, part in (("1", ROWS[:20]), ("2", ROWS[20:50]), ("3", ROWS[50:]), ("4", [("z", 99, 1_800_000_000, 0.0, None)])):
        schema = _land(spark, folder, part, name)
        got = state.latest(state.run(state.cache_use(_stream(spark, folder, schema), "key", ttl, "1 minute"), out, checkpoint))
    want = {}
    for k, _, at, *_ in sorted([*ROWS, ("z", 99, 1_800_000_000, 0.0, None)], key=lambda r: r[2]):
        until, hits, misses = want.get(k, (-1, 0, 0))
        want[k] = (until, hits + 1, misses) if at < until else (at + ttl, hits, misses + 1)
    assert {r.id: (r.hits, r.misses) for r in got.collect()} == {k: v[1:] for k, v in want.items()}
    # the last request has moved the watermark on, so the timers have removed all other entries
    entries = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entry").load()
    assert [r.id for r in entries.select("key.id").collect()] == ["z"]

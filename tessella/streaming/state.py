"""Keyed state with timers: counters that a reset event clears, and a result cache with a time to live, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COUNTERS = "n long, total double, resets long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """State of this kind lives in RocksDB; a setting of the session, which stays."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class _Counters(StatefulProcessor):
    """Frames of a key are summed up one by one; only the last reset and what comes after it counts, by time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counters = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, resets = self._counters.get() if self._counters.exists() else (0, 0.0, 0)
        new = _in_order(rows, ["ts", "event_id"])
        marks = new.index[new["reset"]]
        if len(marks):
            n, total, resets = 0, 0.0, resets + len(marks)
            new = new.iloc[marks[-1] + 1 :]
        state = (int(n + len(new)), float(total + new["value"].fillna(0).sum()), int(resets))
        self._counters.update(state)  # a reset leaves zeros, so it outlives the process like any count
        yield pd.DataFrame({"id": [key[0]], "n": [state[0]], "total": [state[1]], "resets": [state[2]]})

    def close(self) -> None:
        pass


def counters(events: DataFrame, key: str) -> DataFrame:
    """(id, n, total, resets) of a stream (key, event_id, ts, value, reset), after each batch in which a key occurs (STR04).

    A row whose reset is true sets its key's counters to zero. Within a batch rows go by ts and event_id; of batches, the order is
    theirs. Null values count as 0 in total; a null key is a key, and a null reset is none. A key's state is three numbers.
    """
    _ready(events.sparkSession)
    rows = events.select(F.col(key).alias("id"), "event_id", "ts", "value", F.coalesce("reset", F.lit(False)).alias("reset"))
    kind = dict(rows.dtypes)["id"]
    return rows.groupBy("id").transformWithStateInPandas(_Counters(), f"id {kind}, {COUNTERS}", "Update", "None")


def stored_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, n, total, resets) as the last batch of counters() left them in its checkpoint, without running the stream (STR04)."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counters").load()
    return state.select("key.id", "value.n", "value.total", "value.resets")


class _Cache(StatefulProcessor):
    """An entry is there from a miss until its time is up; a timer then removes it, whether or not it is asked for again."""

    def __init__(self, ttl_ms: int):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "until long")
        self._stats = handle.getValueState("stats", "hits long, misses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (until,) = self._entry.get() if self._entry.exists() else (None,)
        hits, misses = self._stats.get() if self._stats.exists() else (0, 0)
        before = until
        for ms in _in_order(rows, ["ms"])["ms"].tolist():
            if until is not None and ms < until:
                hits += 1
            else:
                misses, until = misses + 1, ms + self._ttl
        if until != before:
            if before is not None:
                self._handle.deleteTimer(before)
            self._entry.update((until,))
            self._handle.registerTimer(until)
        self._stats.update((hits, misses))
        yield pd.DataFrame({"id": [key[0]], "hits": [hits], "misses": [misses]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._entry.exists() and self._entry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self._entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_use(requests: DataFrame, key: str, ttl_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """(id, hits, misses) of a stream (key, ts) under a cache whose entries live `ttl_seconds` from the miss that made them (STR05).

    By event time: a request before the end of its key's entry is a hit, any other a miss that makes a new one. Timers remove entries
    once the watermark, `delay` behind the latest request, has passed their end, so what is kept is what is alive and two numbers for each key.
    Requests of a batch go by their time, to the millisecond.
    """
    _ready(requests.sparkSession)
    rows = requests.withWatermark("ts", delay).select(F.col(key).alias("id"), "ts", F.unix_millis("ts").alias("ms"))
    kind = dict(rows.dtypes)["id"]
    return rows.groupBy("id").transformWithStateInPandas(_Cache(ttl_seconds * 1000), f"id {kind}, hits long, misses long", "Update", "EventTime")


def run(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs an update stream over what there is; its rows as a table below `out`, with the batch that each came in. A batch that is run again replaces its own rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).schema(stream.schema.add("batch", "long")).parquet(out)


def latest(updates: DataFrame, key: str = "id") -> DataFrame:
    """The last row of each key in run()'s table."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(key, "r.*")

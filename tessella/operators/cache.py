"""A result cache with a time to live, as Parquet by key (STR05), and snapshots of counters (STR04, SNK06)."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession


def cache_key(prefix: str, **arguments) -> str:
    """prefix:md5 of the arguments as sorted JSON (SCA15)."""
    return f"{prefix}:{hashlib.md5(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()}"


class ResultCache:
    """get, set, clear_expired, stats over a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 3600.0, clock=time.time):
        self.spark, self.folder, self.ttl, self.clock = spark, folder.rstrip("/"), ttl, clock
        self.hits = self.misses = 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, name: str) -> list[tuple[float, str]]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted((float(x.rsplit("@", 1)[1]), x) for x in found if "@" in x and (not name or x.rsplit("@", 1)[0] == name))

    def get(self, key: str) -> DataFrame | None:
        live = [x for until, x in self._entries(key.replace(":", "_")) if until > self.clock()]
        if not live:
            self.misses += 1
            return None
        self.hits += 1
        return self.spark.read.parquet(f"{self.folder}/{live[-1]}")

    def set(self, key: str, df: DataFrame, ttl: float | None = None) -> None:
        until = self.clock() + (self.ttl if ttl is None else ttl)
        df.write.mode("overwrite").parquet(f"{self.folder}/{key.replace(':', '_')}@{until:.3f}")

    def clear_expired(self) -> int:
        old = [x for until, x in self._entries("") if until <= self.clock()]
        for x in old:
            self._fs.delete(self._path(f"{self.folder}/{x}"), True)
        return len(old)

    def stats(self) -> dict[str, int]:
        return {"entries": len(self._entries("")), "hits": self.hits, "misses": self.misses}

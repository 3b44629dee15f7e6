"""Paged sources: no page lost or read twice, whatever fails."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.sources import paged

ROWS = [(s, i, 1990 + i // 10, f"row {i}") for s, n in (("a", 95), ("b", 40), ("c", 7), (None, 3)) for i in range(n)]
KINDS = "source string, page long, id long, year int, title string"


def _frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "source string, id long, year int, title string").repartition(3)


@pytest.fixture
def landed(spark, tmp_path):
    path = str(tmp_path / "landed")
    paged.land(_frame(spark), path, ["id"], 10, {"b": "offset", "c": "token"})
    return path


def test_every_row_once(spark, landed):
    for per_task in ("1", "3", "100"):
        got = paged.pages(spark, landed, KINDS, pagesPerTask=per_task)
        assert Counter((r.source, r.id, r.year, r.title) for r in got.collect()) == Counter((s or "", i, y, t) for s, i, y, t in ROWS)
        assert all(r.page == r.id // 10 for r in got.collect())
    assert {(r.source, r.style, r.status, r.pages, r.returned) for r in paged.page_status(spark, landed).collect()} == {("a", "cursor", "ok", 10, 95), ("b", "offset", "ok", 4, 40), ("c", "token", "ok", 1, 7), ("", "cursor", "ok", 1, 3)}


def test_sources_and_years_choose_pages(spark, landed):
    part = paged.pages(spark, landed, KINDS, sources=["a"], years=(1994, 1995), pagesPerTask="1")
    assert sorted(r.id for r in part.collect()) == list(range(40, 60)) and part.rdd.getNumPartitions() == 2
    assert paged.pages(spark, landed, KINDS, sources=["b", "c"]).count() == 47 and paged.pages(spark, landed, KINDS, sources=[]).count() == 0


def test_pushed_filters(spark, landed):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        once = paged.pages(spark, landed, KINDS, pagesPerTask="1", pushFilters="true").where("source = 'a' AND year >= 1994 AND year < 1996")
        assert sorted(r.id for r in once.collect()) == list(range(40, 60)) and once.rdd.getNumPartitions() == 3  # 1996 begins a page
        # a frame that is read more than once
        got = paged.pages(spark, landed, KINDS)
        assert got.where("source = 'a' AND year >= 1995").union(got.where("source = 'b'")).count() == 85 and got.count() == len(ROWS)
    finally:
        spark.conf.unset(key)


def test_broken_chains(spark, landed):
    def rows(**change):
        return [p | change.get(f"{p['source']}{p['page']}", {}) for p in spark.read.parquet(f"{landed}/manifest").toPandas().to_dict("records") if change.get(f"{p['source']}{p['page']}", 1) is not None]

    def told(**change):
        return {c.source: (c.status, len(c.pages), c.message.split(" ", 2)[-1]) for c in paged.chains(rows(**change))}

    assert told()["a"] == ("ok", 10, "")
    assert told(a3=None)["a"] == ("unavailable", 3, "is missing") and told(a3=None)["b"][0] == "ok"
    assert told(b2=None)["b"] == ("unavailable", 2, "is missing")
    assert told(a9=None)["a"] == ("unavailable", 9, "is missing")
    assert told(a4={"http": 503})["a"] == ("unavailable", 4, "was answered with 503")
    first = next(r for r in rows() if r["source"] == "a" and r["page"] == 0)["key"]
    assert told(a5={"next": first})["a"] == ("unavailable", 6, "comes again")
    assert {c.source: c.status for c in paged.chains([r | {"n": 0, "total": 0} for r in rows() if r["source"] == "c"])} == {"c": "empty"}
    assert len(paged.chains(rows() + rows())[0].pages) in (1, 10)  # landed twice, read once


def test_nothing_landed(spark, tmp_path):
    path = str(tmp_path / "none")
    assert paged.pages(spark, path, KINDS).count() == 0 and paged.page_status(spark, path).count() == 0
    paged.land(_frame(spark, []), path, ["id"])
    assert paged.pages(spark, path, KINDS).count() == 0


def test_stream_goes_on_from_its_cursors(spark, landed, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        q = paged.page_stream(spark, landed, KINDS).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
        return Counter((r.source, r.title) for r in spark.read.parquet(out).collect())

    assert run() == Counter((s or "", t) for s, _, _, t in ROWS)
    more = [("a", 200 + i, 2020, f"new {i}") for i in range(25)] + [("d", i, 2020, f"d {i}") for i in range(12)]
    paged.land(_frame(spark, more), landed, ["id"], 10)
    assert run() == Counter((s or "", t) for s, _, _, t in ROWS + more) and run() == Counter((s or "", t) for s, _, _, t in ROWS + more)
    assert {r.source: (r.status, r.pages) for r in paged.page_status(spark, landed).collect()}["a"] == ("ok", 13)


RETRY = """
import os, sys
from pyspark.sql import SparkSession
from tessella.sources import paged
once = sys.argv[2]

class Failing(paged.PageReader):
    def read(self, partition):
        for i, batch in enumerate(super().read(partition)):
            if i == 1 and not os.path.exists(f"{once}/{partition.source}"):
                open(f"{once}/{partition.source}", "w").close()
                raise OSError("the machine is gone")
            yield batch

class Source(paged.PagedSource):
    def reader(self, schema):
        return Failing(self.options, schema)

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.dataSource.register(Source)
got = spark.read.format("tessella_pages").schema("source string, id long").option("path", sys.argv[1]).load().collect()
print("GOT", len(got), len(set(got)), len(os.listdir(once)))
"""


def test_a_task_that_is_tried_again_reads_the_same(landed, tmp_path):
    once = tmp_path / "once"
    once.mkdir()
    (tmp_path / "retry_source.py").write_text(RETRY)
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    out = subprocess.run([sys.executable, str(tmp_path / "retry_source.py"), landed, str(once)], env=env, capture_output=True, text=True, timeout=180)
    assert f"GOT {len(ROWS)} {len(ROWS)} 2" in out.stdout, out.stderr[-3000:]

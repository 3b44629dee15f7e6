"""Files by names: against all pairs, and without a broadcast of what is made of names."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessella.operators import registry as R


def test_find_files_by_all_pairs(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab_") for _ in range(n))
    names = list({word(rng.randrange(1, 12)) + rng.choice([".pdf", ".txt", ""]) for _ in range(150)} | {"", ".pdf", "Same.PDF"})
    files = list({rng.choice(["", "x/", "y\\"]) + word(rng.randrange(1, 12)) + rng.choice([".pdf", ".PDF", ""]) for _ in range(150)} | {"z/same.pdf", "q/", ".pdf"})
    base = lambda x: re.search(r"[^/\\]*$", x)[0].lower()
    stem = lambda x: re.sub(r"\.[a-z0-9]+$", "", base(x))
    want = {}
    for n in names:
        ranked = [(0 if base(n) == base(f) else 1 if stem(n) == stem(f) else 2, f) for f in files if base(n) == base(f) or stem(n) == stem(f) or (stem(n) and stem(f) and (stem(n) in stem(f) or stem(f) in stem(n)))]
        if ranked:
            want[n] = min(ranked)[1]
    got = {r.name: r.file for r in R.find_files(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == want and len(got) > 100


def test_runs_are_not_broadcast(spark, tmp_path):
    """A table of few bytes has many names, and a name many runs, which Spark's size check doesn't see."""
    spark.range(2000).write.parquet(f"{tmp_path}/n")
    names = spark.read.parquet(f"{tmp_path}/n").select(F.concat(F.lit("part_"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(".pdf")).alias("name"))
    plan = R.find_files(names, names.select(F.concat(F.lit("a/my "), "name").alias("file")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

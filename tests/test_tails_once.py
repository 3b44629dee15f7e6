"""The tails of line items are made once for each combination of statistic and degrees of freedom."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessella.plans import moderators


def test_line_tails_of_many_lines(spark, tmp_path):
    """600,000 lines of 16,800 combinations, and rows of nulls; one by one they took minutes."""
    n = F.col("id")
    lines = spark.range(600_000).select(n.alias("l_orderkey"), (n % 7 + 1).cast("int").alias("l_linenumber"), F.when(n % 1000 > 0, n % 997).alias("l_suppkey"), F.when(n % 1001 > 0, n % 991).alias("l_partkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    began = time.perf_counter()
    got = moderators.line_tails(spark, str(tmp_path))
    counts = got.agg(F.count(F.lit(1)).alias("n"), F.count("chi2_p").alias("chi"), F.count("normal_p").alias("z"), F.count("t_p").alias("t"), F.count_distinct("k").alias("k")).first()
    assert time.perf_counter() - began < 40
    nulls = {i for i in range(0, 600_000, 1000)}, {i for i in range(0, 600_000, 1001)}
    both = 600_000 - len(nulls[0] | nulls[1])
    assert counts.asDict() == {"n": 600_000, "chi": both, "z": 600_000 - len(nulls[0]), "t": both, "k": 600_000}

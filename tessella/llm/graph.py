"""Connected components by alternating large-star and small-star rounds; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every id is either the end of one link (u, v) to a smaller id or the target of others' links, so that v labels u. True without links."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("others"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("others")))
    odd = ends.groupBy("id").agg(F.sum("own").alias("own"), F.max("others").alias("others")).where("own > 1 OR own + others > 1")
    return odd.limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for every id with a link, but for the smallest of each component: label is the smallest id reachable.

    Rounds only group by an id with partial aggregation and join back, so no group of links is ever held by one task, and
    nothing but one count a round comes to the driver. They end as soon as all links are stars, without another round that
    changes nothing. Links to oneself and repeated links don't matter; without links the result is empty.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = stored(small.where("u <> v").distinct())
        discard(now)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))


def merged(known: DataFrame, further: DataFrame) -> DataFrame:
    """(id, label) of `known` components after `further` ones, which components() found from links between labels of `known`: only such links need to be looked at when more come."""
    last = further.select(F.col("id").alias("label"), F.col("label").alias("last"))
    return known.join(last, "label", "left").select("id", F.coalesce("last", "label").alias("label")).unionByName(further)

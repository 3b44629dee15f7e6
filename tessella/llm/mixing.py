"""Mixing sources to target weights: Pfair windows for every source's blocks, interleaved earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import documents

#: Without targets, sources with a lane of their own; the smallest beyond these share one.
LANES = 10_000
#: Documents in a block, at least, and blocks of a whole corpus, at most (besides the last ones of sources).
BLOCK, BLOCKS = 16, 10_000_000
#: Documents of a source that one task ranks at a time, on average, and ranges whose counts are added up together.
RANKED, SUMMED = 2000, 4096
#: Slots of the schedule in a batch of rows.
SLOTS = 50_000
_NULL, _REST = "\x00null", "\x00rest"


class Pfair:
    """The schedule of sources whose exact weights add up to one, in slots of one block each.

    Block k of a source of weight w is released at floor(k / w) and due by ceil((k + 1) / w). Among the released blocks the
    one that is due first goes first. As the weights add up to one, none is late, so after t slots each source has
    floor(w t) or ceil(w t) blocks: less than one from w t, for any t. All numbers are whole: nothing is rounded.
    """

    def __init__(self, weights: dict[str, float | Fraction]):
        exact = {s: w if isinstance(w, Fraction) else Fraction(repr(w)) for s, w in weights.items()}
        total = sum(exact.values())
        self.sources = sorted(exact)
        shares = [exact[s] / total for s in self.sources]
        self.whole = math.lcm(*(x.denominator for x in shares))
        self.parts = [int(x * self.whole) for x in shares]

    def due(self, source: str, blocks: int) -> int:
        """The slot by which so many blocks of a source are done."""
        return -(-blocks * self.whole // self.parts[self.sources.index(source)])

    def slots(self, end: int) -> Iterator[tuple[int, int]]:
        """(number of the source, its block) for each slot before `end`."""
        whole, parts = self.whole, self.parts
        at = [0] * len(parts)
        coming = [(0, s) for s in range(len(parts))]
        ready: list[tuple[int, int]] = []
        for t in range(end):
            while coming and coming[0][0] <= t:
                s = heapq.heappop(coming)[1]
                heapq.heappush(ready, (-(-(at[s] + 1) * whole // parts[s]), s))
            s = heapq.heappop(ready)[1]
            yield s, at[s]
            at[s] += 1
            heapq.heappush(coming, (at[s] * whole // parts[s], s))


def capped(counts: dict[str, int], most: float) -> dict[str, Fraction]:
    """Each source's share of all blocks, but at most `most`; the rest keep their proportions among each other. The lane of the smallest sources is no source, so it has no limit."""
    weights = {s: Fraction(n, sum(counts.values())) for s, n in counts.items()}
    limit, over = max(Fraction(repr(most)), Fraction(1, len(counts))), set()
    while True:
        free = sum(w for s, w in weights.items() if s not in over)
        scale = (1 - limit * len(over)) / free if free else Fraction(0)
        new = {s for s, w in weights.items() if s not in over and s != _REST and w * scale > limit}
        if not new:
            return {s: limit if s in over else w * scale for s, w in weights.items()}
        over |= new


def scheduled(spark: SparkSession, plan: Pfair, end: int) -> DataFrame:
    """(lane, block, slot) for the slots before `end`: one task goes from slot to slot and passes them on in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            slots = plan.slots(end)
            for at in range(0, end, SLOTS):
                rows = list(islice(slots, SLOTS))
                yield pa.RecordBatch.from_arrays([pa.array([plan.sources[s] for s, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64()), pa.array(np.arange(at, at + len(rows)))], names=["lane", "block", "slot"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "lane string, block long, slot long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, float] | None = None, stop: str = "last", block: int | None = None, most: float | None = None) -> DataFrame:
    """The rows of the mix with all their columns, and mix_slot (of a block), mix_block (of its source) and mix_position.

    targets: weights by source, taken as the decimal numbers they are written as; a source that isn't named is left out.
    Without targets every source has its own share of the blocks, and no row is lost, unless a caller limits the part of any
    source in the mix to `most`. A source's rows are taken in the order of a hash of their id, in blocks of `block`, the last
    of which may be short; by default a block has BLOCK rows, or as many as it takes to cut all rows into BLOCKS. stop: the mix ends when the first source's last block is due ("first"), so that every stretch
    of it has the target weights; or when the last of those is due that aren't over-supplied, that is, whose target is no
    less than their share ("last"), so that only over-supplied sources lose rows.

    After any number of slots each source's number of blocks differs from its exact weight's by less than one (Pfair).

    The driver holds one row for each source that targets name, or else of at most LANES sources; the smallest beyond these
    share a lane, in the order of the hash, which has their whole share and is never limited. The schedule, a row for each
    block, is made by one task that holds a block of each lane, since each slot depends on all before; it is joined to ranges
    of the hash, some RANKED rows each: counts by range are added up in two steps and each range is ranked by itself, so a
    source with a third of all rows is spread over all tasks.

    Null sources are a source (named None in targets). Rows with a null id are ranked beside each other, and so are rows
    that repeat an id; all are rows of the mix. No rows give no rows. Columns of any name are kept, except that mix_slot,
    mix_block and mix_position are replaced.
    """
    spark = docs.sparkSession
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("mix_slot", "mix_block", "mix_position")]
    lane = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    rows = docs.select(lane.alias("lane"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    counts = rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if targets is not None:
        targets = {_NULL if s is None else s: w for s, w in targets.items() if w > 0}
        sizes = {r["lane"]: r["n"] for r in counts.where(F.col("lane").isin(list(targets))).collect()}
        rows = rows.where(F.col("lane").isin(list(sizes)))
    else:
        sizes = {r["lane"]: r["n"] for r in counts.orderBy(F.desc("n"), "lane").limit(LANES).collect()}
        if rest := total - sum(sizes.values()):
            rows = rows.withColumn("lane", F.when(F.col("lane").isin(list(sizes)), F.col("lane")).otherwise(F.lit(_REST)))
            sizes[_REST] = rest
    if not sizes:
        return rows.where("false").selectExpr(*kept, "cast(null as long) mix_slot", "cast(null as long) mix_block", "cast(null as long) mix_position")
    block = block or max(BLOCK, -(-sum(sizes.values()) // BLOCKS))
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    share = {s: Fraction(n, sum(blocks.values())) for s, n in blocks.items()}
    weights = {s: Fraction(repr(targets[s])) for s in sizes} if targets is not None else share if most is None else capped(blocks, most)
    plan, heavy = Pfair(weights), sum(weights.values())
    due = {s: plan.due(s, n) for s, n in blocks.items()}
    end = min(due.values()) if stop == "first" else max(due[s] for s in sizes if weights[s] / heavy >= share[s])

    ranges = max(1, total // RANKED)
    rows = rows.withColumn("part", F.floor(F.col("hash") / F.lit(2.0**63) * ranges).cast("long"))
    each = rows.groupBy("lane", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.floor(F.col("part") / SUMMED))
    running = lambda *by, order: F.sum("n").over(W.partitionBy(*by).orderBy(order)) - F.col("n")
    tops = each.groupBy("lane", "many").agg(F.sum("n").alias("n")).select("lane", "many", running("lane", order="many").alias("top"))
    each = each.withColumn("below", running("lane", "many", order="part")).join(tops, ["lane", "many"]).select("lane", "part", "n", (F.col("top") + F.col("below")).alias("before"))
    places = each.select("lane", "part", "before", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block))).alias("block"))
    places = places.join(scheduled(spark, plan, end), ["lane", "block"]).groupBy("lane", "part", "before").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    nth = F.row_number().over(W.partitionBy("lane", "part").orderBy("hash", f"row.`{id_col}`")) - 1
    out = rows.withColumn("nth", nth).join(places, ["lane", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = out.withColumn("mix_block", F.floor(F.col("rank") / block)).withColumn("mix_slot", F.get("slots", (F.col("mix_block") - F.floor(F.col("before") / block)).cast("int")))
    return out.where("mix_slot IS NOT NULL").select(*kept, "mix_slot", "mix_block", (F.col("mix_slot") * block + F.col("rank") % block).alias("mix_position"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its own share, so that all documents stay."""
    return mix(documents(spark, sf_dir).select("doc_id", "source"))

"""Exact dedup: a minimal perfect hash over the distinct digests of history, probed by the digests that come later."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_PATTERN, documents, stored, whole_text

#: Distinct digests in one perfect hash: 50 bytes each, so a task holds some 10 MB.
KEYS_PER_PART = 200_000
#: Bits for each key of a level; more bits make fewer levels.
GAMMA = 2


class PerfectHash:
    """Level by level, keys that meet no other in a bit array take that bit; a key's slot is the rank of its bit.

    Slots are 0 to n-1 for the n distinct 32-byte digests it was built from. A digest that wasn't among them gets any slot
    or -1, so whoever asks must compare the digest kept there.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        halves = digests.view("<u8").reshape(-1, 4)
        x = halves[:, 0] + halves[:, 1] * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = digests, [], []
        while len(left):
            size = GAMMA * len(left)
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        out, at = np.full(len(digests), -1, np.int64), 0
        left = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            place = at + self._place(digests[left], level, size)
            hit = self.bits[place]
            out[left[hit]] = self.ranks[place[hit]]
            left, at = left[~hit], at + size
        return out

    def dumps(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(self.bits).tobytes()

    @classmethod
    def loads(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        sizes = [int(x) for x in sizes]
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool))


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the perfect hash of a part, and by slot the full digests, the winners' ids and the numbers of rows."""
    digests = _bytes(rows["digest"])
    table = PerfectHash.build(digests)
    order = np.argsort(table.slots(digests))
    sizes, bits = table.dumps()
    return pd.DataFrame([{"part": rows["part"].iloc[0], "sizes": sizes, "bits": bits, "digests": digests[order].tobytes(), "winners": rows["winner"].to_numpy(np.int64)[order].tobytes(), "counts": rows["n"].to_numpy(np.int64)[order].tobytes()}])


def _probe(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Every distinct digest of a part with its winner and number of rows: those of history, then those that it has not."""
    found = pd.DataFrame({"digest": [], "winner": [], "n": []})
    n = batch["n"].to_numpy(np.int64)
    member = np.zeros(len(batch), bool)
    if len(index):
        row = index.iloc[0]
        table = PerfectHash.loads(row["sizes"], bytes(row["bits"]))
        kept = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        counts = np.frombuffer(row["counts"], np.int64).copy()
        if len(batch):
            digests = _bytes(batch["digest"])
            slots = table.slots(digests)
            member = (slots >= 0) & (kept[slots] == digests).all(axis=1)
            np.add.at(counts, slots[member], n[member])
        found = pd.DataFrame({"digest": [x.tobytes() for x in kept], "winner": pd.array(np.frombuffer(row["winners"], np.int64), "Int64"), "n": counts})
    rest = batch[~member]
    return pd.concat([x for x in (found, pd.DataFrame({"digest": rest["digest"], "winner": rest["winner"].astype("Int64"), "n": rest["n"]})) if len(x)] or [found])


def digest(text: str = "text") -> Column:
    """SHA-256 of the whole text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), SPACE_PATTERN, " "), 256))


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """history (digest, winner, n), distinct by digest, as perfect hashes of `parts` parts in the shared folder."""
    dealt = history.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    return stored(dealt.groupBy("part").applyInPandas(_build, "part long, sizes array<long>, bits binary, digests binary, winners binary, counts binary"))


def probe_index(index: DataFrame, batch: DataFrame, parts: int) -> DataFrame:
    """(digest, winner, n) of all digests of the index and of `batch`, whose rows are added to the index's counts."""
    dealt = batch.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    return dealt.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(_probe, "digest binary, winner long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    History (by default the rows below the median id; any condition on the id under which lower ids come first serves) is
    reduced to its distinct digests, which are dealt by digest into parts of KEYS_PER_PART and put into perfect hashes; each
    slot holds the full digest and the winner, the smallest id. The later rows' distinct digests look their slot up and
    compare all 32 bytes: members are repeats of the winner, and the others form groups of their own.

    Equal texts are reduced to (digest, smallest id, count) on the map side before any shuffle; only rows of about 60 bytes
    are joined back, by the digest, where adaptive execution splits a digest that holds a third of all rows. No text is
    shuffled. A null text counts as empty. A null id comes after all others; a group of only null ids has a null keep_id
    and keeps one. Of rows that repeat id and text one is kept. An empty table gives an empty result. Other columns are
    ignored.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest")))
    size, cut = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5, 1000)).first()
    parts = max(1, -(-size // KEYS_PER_PART))
    past = F.coalesce(F.col("doc_id") < F.lit(cut) if history is None else history, F.lit(False))
    seen = rows.where(past).groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    new = rows.where(~past).groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    groups = probe_index(build_index(seen, parts), new, parts)
    first = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    out = rows.withColumn("nth", first).join(groups, "digest")
    return out.select("doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}

"""Best-fit packing under conflicts: residual-ordered bins with bitmaps of their sources and duplicate clusters."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_PATTERN, documents, partitions, raw, small_batches, stored, whole_text
from tessella.llm.token_ids import loaded

#: Tokens of a bin.
CAPACITY = 2048
#: Pieces that are packed with each other, on average; a shard leaves a few bins that another might have filled.
SHARD = 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order. No bin gets two pieces of a source or of a duplicate cluster.

    Open bins are kept in the order of their residuals. From the first residual that is large enough the search goes on to
    each next bin until the bitmaps of one allow the piece: that is the tightest compatible bin. A null source or cluster
    conflicts with none. Equal residuals go by the bin's number.
    """
    bits: list[dict] = [{}, {}]
    order: list[tuple[int, int]] = []
    masks: list[int] = []
    out = []
    for n, source, cluster in zip(lengths, sources, clusters, strict=True):
        own = 0
        for k, key in enumerate((source, cluster)):
            if key is not None:
                own |= 1 << (2 * bits[k].setdefault(key, len(bits[k])) + k)
        at = bisect_left(order, (n, -1))
        while at < len(order) and masks[order[at][1]] & own:
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(masks)
            masks.append(0)
        out.append((b, capacity - left))
        masks[b] |= own
        if left > n:
            insort(order, (left - n, b))
    return out


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank`: how many rows are before it, and `before`: how many bins those fill, over all rows, by `order` and then by id.

    Rows are dealt into ranges of their order and stored, so that the sums by range, one row each, belong to the numbers within;
    no task sees more than its range.
    """
    spark, order = rows.sparkSession, (*order, "doc_id", "tie")
    dealt = stored(rows.repartitionByRange(partitions(spark), *order).select("*", F.spark_partition_id().alias("range")))
    sums = {r["range"]: r for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rank"), F.sum("whole").alias("before")).collect()}  # one row for each partition
    inside = W.partitionBy("range").orderBy(*order, "source", "n_tokens", "copy").rowsBetween(W.unboundedPreceding, -1)
    for name, own in (("rank", F.lit(1)), ("before", F.col("whole"))):
        starts, at = {}, 0
        for k in sorted(sums):
            starts[k], at = at, at + sums[k][name]
        start = F.create_map(*(F.lit(x).cast(kind) for pair in starts.items() for x, kind in zip(pair, ("int", "long"), strict=True)))
        dealt = dealt.withColumn(name, start[F.col("range")] + F.coalesce(F.sum(own).over(inside), F.lit(0)) if starts else F.lit(0).cast("long"))
    return dealt


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, order: str | None = None) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, n_tokens) for documents (doc_id, n_tokens, source, cluster).

    A document of more than `capacity` tokens fills bins of its own and leaves its remainder, the last piece, to be packed;
    so no token is lost. Bins of whole pieces are numbered, -1, -2 and so on, by prefix sums over ranges of ids; so no two
    rows share one, even if they repeat an id and everything else. Remainders are dealt by hash of the id and a number of the row
    into shards of about `shard` pieces, whatever their source or cluster, and each shard is packed by itself, longest first: its
    bins hold no more than its rows, however many copies or rows of one source or id there are. Lengths below 1 or null count as 1.
    Null ids are rows like others, null sources and clusters conflict with none; clusters are of any type (maps excepted), compared
    as they are. Other columns are ignored; an empty table has no pieces. Rows that differ are packed the same way in every run.

    order: a column by which the documents are to be read (ties by id), such as the order of a mix. Shards are stretches of it then,
    so pieces share a bin only with others of their stretch; bins of whole pieces are numbered along it; and each bin gets a
    `bin_place` of its own, the number of its first piece in that order: bins in ascending bin_place follow it.
    """
    whole = F.floor((F.col("n_tokens") - 1) / capacity)
    pieces = pieces.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(1)), F.lit(1)).alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster"), *([F.col(f"`{order}`").alias("place")] if order else []))
    cluster = F.when(F.col("cluster").isNotNull(), F.sha2(F.to_json(F.struct("cluster")) if dict(pieces.dtypes)["cluster"] not in ("binary", "string") else F.col("cluster"), 256))
    pieces = pieces.withColumn("cluster", cluster).withColumn("tie", F.xxhash64("source", "cluster", "n_tokens"))
    #: Tells apart rows that repeat everything: there is no other order among them.
    pieces = stored(pieces.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - whole * capacity).withColumn("copy", F.monotonically_increasing_id()))
    n = pieces.count()
    shards = max(1, -(-n // shard))
    if order:
        #: Pieces are numbered along the order, a document's one after another.
        placed = _numbered(pieces, "place").withColumn("shard", F.expr(f"rank * {shards} div {max(n, 1)}")).withColumn("bin_place", F.col("rank") + F.col("before") + F.col("whole"))
        return _remainders(placed, capacity).unionByName(_whole(placed.where("whole > 0"), capacity))
    odd = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    #: Rows of one id go by their own numbers: a null or repeated id may have any number of rows.
    salted = odd.limit(1).count() > 0
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)))
    if salted:
        dealt = pieces.join(odd.select(F.col("doc_id").alias("same"), F.lit(True).alias("odd")), F.col("doc_id").eqNullSafe(F.col("same")), "left")
        dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", F.when(F.col("odd"), F.col("copy"))), F.lit(shards)))

    return _remainders(dealt, capacity).unionByName(_whole(_numbered(pieces.where("whole > 0")), capacity).drop("bin_place"))


def _remainders(dealt: DataFrame, capacity: int) -> DataFrame:
    """The pieces that share bins, each shard packed by itself; if they have a bin_place, with the least one of their bin."""
    place = [c for c in dealt.columns if c == "bin_place"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rest", "doc_id", "tie", "copy"], ascending=[False, True, True, True], kind="stable", na_position="last")
        got = best_fit(rows["rest"].tolist(), *([None if x is None or x != x else x for x in rows[c]] for c in ("source", "cluster")), capacity)
        out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "piece": rows["whole"], "bin_id": rows["shard"] * 2**32 + [b for b, _ in got], "bin_offset": [x for _, x in got], "n_tokens": rows["rest"]})
        for c in place:
            out[c] = rows[c].groupby(out["bin_id"]).transform("min")
        return out

    return dealt.select("doc_id", "source", "cluster", "tie", "whole", "rest", "copy", "shard", *place).groupBy("shard").applyInPandas(run, "doc_id long, piece long, bin_id long, bin_offset long, n_tokens long" + ", bin_place long" * len(place))


def _whole(numbered: DataFrame, capacity: int) -> DataFrame:
    """The pieces that fill bins of their own, with their numbers among all pieces (of the rows that were numbered)."""
    full = numbered.select("doc_id", "rank", "before", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("piece"))
    return full.select("doc_id", F.col("piece").cast("long"), (-1 - F.col("before") - F.col("piece")).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("rank") + F.col("before") + F.col("piece")).alias("bin_place"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None, tokenizer: str | None = None, order: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, source, cluster) of documents: ids of a tokenizer file and an end token each; without one words and an end token, unless `tokens` says otherwise; a cluster is all documents whose texts are equal but for white space. Null text is empty; null and repeated ids are rows like others, other columns are ignored, an empty table gives no rows. order: a column that is kept, for pack()."""
    kept = [f"`{order}`"] if order else []
    cluster = F.unhex(F.md5(F.regexp_replace(whole_text(text_col), SPACE_PATTERN, " "))).alias("cluster")
    if tokenizer is not None:
        small_batches(docs.sparkSession, 500)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = loaded(tokenizer)
            for batch in batches:
                n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in bpe.encode(*raw(batch.column(1))))]) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *batch.columns[2:]], names=["doc_id", "n_tokens", "source", "cluster", *([order] if order else [])])

        schema = "doc_id long, n_tokens long, source string, cluster binary" + "".join(f", {c} {docs.select(c).dtypes[0][1]}" for c in kept)
        return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string"), cluster, *kept).mapInArrow(count, schema)
    words = F.regexp_count(whole_text(text_col), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    return docs.select(F.col(id_col).alias("doc_id"), (words if tokens is None else tokens).alias("n_tokens"), F.col(source_col).alias("source"), cluster, *kept)


def packed_sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, ids, n_tokens, starts, and bin_place if the pieces have it): the sequence of each bin of pack()'s pieces, over documents of unique ids.

    ids are `capacity` little-endian numbers of 2 bytes (4 where the vocabulary needs them), filled up with pad_id; n_tokens of
    them are the documents' own, each document's followed by end_id; starts are the offsets of its pieces. Texts become
    ids once, pieces are cut out of them, and a bin's pieces, no more than it holds, meet in one row. A null text is its end alone; no
    pieces give no rows.
    """
    small_batches(docs.sparkSession, 500)
    kind = loaded(tokenizer).kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(tokenizer), np.array([end_id], kind).tobytes()
        for batch in batches:
            out: list[bytes] = []
            for flat, n in bpe.encode(*raw(batch.column(1))):
                out += [x.tobytes() + end for x in np.split(flat, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    size = kind.itemsize
    ids = docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(encode, "doc_id long, ids binary")
    place = [c for c in pieces.columns if c == "bin_place"]
    cut = pieces.join(ids, "doc_id").select("bin_id", "bin_offset", "n_tokens", *place, F.expr(f"substring(ids, cast(piece * {capacity * size} + 1 AS int), cast(n_tokens * {size} AS int))").alias("part"))
    bins = cut.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "part"))).alias("p"), F.sum("n_tokens").alias("n_tokens"), *(F.min(c).alias(c) for c in place))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    pad = F.lit(np.array([pad_id], kind).tobytes())
    return bins.select("bin_id", F.rpad(joined, F.lit(capacity * size), pad).alias("ids"), "n_tokens", F.transform("p", lambda x: x["bin_offset"]).alias("starts"), *place)


def tokenized(docs: DataFrame, order: str | None = None) -> DataFrame:
    """measured() by the byte-level BPE of the token ids."""
    import public_tokenizers

    return measured(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), order=order)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenized(documents(spark, sf_dir)))

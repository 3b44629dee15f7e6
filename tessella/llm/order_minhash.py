"""Order MinHash: fingerprints of texts that follow their edit distance, since the chosen k-mers keep their order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, mixed, partitions, row_keys, small_batches, whole_text

#: Code points of a k-mer, coordinates of a fingerprint, k-mers in a coordinate's tuple.
K, COORDINATES, CHOSEN = 8, 64, 2
#: Code points that the kernel takes in at once; a longer text stands alone. Positions whose permuted ranks are made at once.
SLICE, CHUNK = 1 << 20, 4096
#: Ranges of ids for each shuffle partition, so that hashing them onto partitions deals them evenly.
RANGES = 4

_STEP, _OCCURRENCE, _TUPLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def multipliers(n: int) -> np.ndarray:
    """An odd number for each coordinate; multiplying 32-bit ranks by it permutes them."""
    return np.random.default_rng(20240117).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, one after another, and each text's number of them."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def numbered_kmers(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each k-mer and of how often it has occurred in its text before, in the order of the texts; and the edges of texts in it.

    A text of fewer than k code points is one k-mer, an empty one has none.
    """
    points, n = code_points(texts)
    ends = np.cumsum(n)
    hashes = np.zeros(max(len(points) - k + 1, 0), np.uint64)
    for j in range(k):
        hashes = (hashes + points[j : j + len(hashes)]) * _STEP
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    at = np.arange(edges[-1]) - edges[:-1][text] + (ends - n)[text]
    short = n[text] < k
    out = np.empty(len(at), np.uint64)
    out[~short] = mixed(hashes[at[~short]])
    for i in np.flatnonzero(short):  # fewer than k code points: all of them
        h = np.zeros(1, np.uint64)
        for c in points[at[i] : at[i] + n[text[i]]]:
            h = (h + np.uint64(c)) * _STEP
        out[i] = mixed(mixed(h) + n[text[i]].astype(np.uint64))[0]
    order = _grouped(out, text)
    same = np.zeros(len(out), bool)
    same[1:] = (out[order[1:]] == out[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    if same.any():
        where = np.arange(len(out))
        first = np.maximum.accumulate(np.where(same, 0, where))
        again = np.flatnonzero(same)
        number = (again - first[again]).astype(np.uint64)
        out[order[again]] = mixed(out[order[again]] + number * _OCCURRENCE)
    return out, edges


def _grouped(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """An order of positions in which equal hashes of a text stand together, ascending by position."""
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    key = mixed(hashes + text.astype(np.uint64) * _TUPLE) >> bits << bits
    order = (np.sort(key | np.arange(len(hashes), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    a, b = order[1:], order[:-1]
    if ((key[a] == key[b]) & ((hashes[a] != hashes[b]) | (text[a] != text[b]))).any():  # two of them share the key's bits
        order = np.lexsort((np.arange(len(hashes)), hashes, text))
    return order


def _least(ranks: np.ndarray, permute: np.ndarray, chosen: int) -> np.ndarray:
    """Positions of the `chosen` least permuted ranks (all, if there are fewer), ascending by position, for each coordinate."""
    rows, values, places = np.arange(len(permute)), [], []
    for a in range(0, len(ranks), CHUNK):
        v = permute[:, None] * ranks[None, a : a + CHUNK]
        for r in range(min(chosen, v.shape[1])):
            i = v.argmin(1)
            values.append(v[rows, i])
            places.append(i + a)
            v[rows, i] = np.uint32(0xFFFFFFFF)
    place = np.stack(places, 1)
    if place.shape[1] > chosen:
        best = np.argsort(np.stack(values, 1), axis=1, kind="stable")[:, :chosen]
        place = np.take_along_axis(place, best, 1)
    return np.sort(place, axis=1)


def signatures(texts: list[str], k: int = K, coordinates: int = COORDINATES, chosen: int = CHOSEN) -> np.ndarray:
    """(texts, coordinates) numbers of 32 bits. For each coordinate the occurrence-numbered k-mers with the least permuted ranks are taken, put back into the order of the text, and hashed as a tuple; an empty text has zeros."""
    hashes, edges = numbered_kmers(texts, k)
    ranks = (hashes >> np.uint64(32)).astype(np.uint32)
    permute = multipliers(coordinates)
    out = np.zeros((len(texts), coordinates), np.uint32)
    for t in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[t], edges[t + 1]
        picked = hashes[a:b][_least(ranks[a:b], permute, chosen)]
        joined = np.zeros(coordinates, np.uint64)
        for r in range(picked.shape[1]):
            joined = mixed(joined * _TUPLE + picked[:, r])
        out[t] = (joined >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal coordinates."""
    return (a == b).mean(axis=-1)


def hexed(signature: np.ndarray) -> list[str]:
    return [x.astype(">u4").tobytes().hex() for x in signature]


def edited(text: str, other: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of other."""
    q = len(text) // 4
    return text[: len(text) - q] + other[:q]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, coordinates: int = COORDINATES, chosen: int = CHOSEN) -> DataFrame:
    """(doc_id, n_chars, fingerprint): the order MinHash of each whole text, in place: nothing is shuffled.

    A null text is empty; empty texts have a fingerprint of zeros. Null and repeated ids are rows like others; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(hexed(signatures(texts, k, coordinates, chosen)), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _bucket(bounds: list[int], key: str):
    """How many of the ascending bounds are at most the key: first among every n-th one, then among those between two of these."""
    n = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + n] for i in range(0, len(bounds), n)]

    def below(array):
        return F.size(F.filter(array, lambda b: b <= F.col(key)))

    def literal(xs):
        return F.array(*(F.lit(x).cast("long") for x in xs))

    coarse = below(literal([g[0] for g in groups]))
    fine = below(F.element_at(F.array(*(literal(g) for g in groups)), coarse))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * n + fine).cast("int")


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, text, bucket, visitor) sorted within partitions so that each row but a visitor is followed by its successor.

    Ids are cut into ranges by quantiles; each range goes to one task, sorted, with a copy of the next range's first row, the
    visitor, behind it (the last range has the first row of all). So one shuffle of the texts and no window over all rows.
    """
    spark = docs.sparkSession
    rows = row_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), "key")
    ranges = RANGES * partitions(spark)
    bounds = rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    rows = rows.withColumn("bucket", _bucket(sorted({int(b) for b in bounds}), "key") if bounds else F.lit(0))
    #: One row for each range.
    firsts = sorted((r["bucket"], r["key"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return rows.withColumn("visitor", F.lit(0))
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    visitors = rows.where(F.col("key").isin(list(before))).dropDuplicates(["key"])
    table = F.create_map(*(F.lit(x).cast(kind) for pair in before.items() for x, kind in zip(pair, ("long", "int"), strict=True)))
    visitors = visitors.withColumn("bucket", table[F.col("key")])
    both = rows.withColumn("visitor", F.lit(0)).unionByName(visitors.withColumn("visitor", F.lit(1)))
    return both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "visitor", "key")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, coordinates: int = COORDINATES, chosen: int = CHOSEN) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each whole text.

    The edited text ends in the beginning of the next document. The order is ascending by id; rows whose id is null or repeated
    come after all others, by a hash of id and text. A null text is empty; two empty texts are alike (1.0). A single document is
    its own successor, an empty table gives none. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        own, changed = [t for _, t, _ in rows], [edited(t, x) for _, t, x in rows]
        #: A successor is mostly the row that follows.
        apart = [i for i, (_, _, x) in enumerate(rows) if i + 1 == len(rows) or x is not own[i + 1]]
        all_of = signatures(own + changed + [rows[i][2] for i in apart], k, coordinates, chosen)
        mine, other = all_of[: len(rows)], all_of[len(rows) : 2 * len(rows)]
        following = np.concatenate([mine[1:], mine[:1]])
        following[apart] = all_of[2 * len(rows) :]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
             pa.array(hexed(mine), pa.string()), pa.array(hexed(other), pa.string()), pa.array(likeness(mine, other)), pa.array(likeness(mine, following))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, size = None, [], 0
        for batch in batches:
            for doc_id, text, visitor in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held is not None:
                    ready.append((*held, text))
                    size += 2 * len(held[1])
                held = None if visitor else (doc_id, text)
                if size >= SLICE:
                    yield made(ready)
                    ready, size = [], 0
        if ready:
            yield made(ready)

    return with_successor(docs, id_col, text_col).select("doc_id", "text", "visitor").mapInArrow(run, _COLUMNS)


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(documents(spark, sf_dir))

"""What the corpus operators share: tables in the shared folder, and byte-level text kernels over Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import discard, shared_dir, stored  # noqa: F401

#: The bytes of white space [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: A-Z to a-z, for str.translate; other letters stay.
LOWER = {c: c + 32 for c in range(65, 91)}
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Bytes of text that the kernels take in at once; a longer document stands alone.
SLICE = 2 << 20
#: Bytes that gather() takes at once, each by an index of 8 bytes.
GATHERED = 1 << 18
#: Bytes of an Arrow batch of whole documents.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a key (long, not null) that tells apart rows of the same id, and orders like the id.

    It is the id itself where that is of one row only. Rows whose id is null or repeated get 2^62 or more, by a hash of id and
    text, so that they come after all others; only rows that repeat both share a key. Ids are taken to be below 2^62. Where
    no id is null or repeated, which one aggregation by id tells, nothing is joined.
    """
    odd = docs.groupBy(F.col(id_col).cast("long").alias("_odd_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _odd_id IS NULL")
    if odd.limit(1).count() == 0:
        return docs.withColumn(name, F.col(id_col).cast("long"))
    out = docs.join(odd.where("_odd_id IS NOT NULL").select("_odd_id"), F.col(id_col).cast("long") == F.col("_odd_id"), "left")
    hashed = F.shiftrightunsigned(F.xxhash64(id_col, whole_text(text_col)), 2) + F.lit(1 << 62)
    return out.withColumn(name, F.when(F.col("_odd_id").isNull() & F.col(id_col).isNotNull(), F.col(id_col).cast("long")).otherwise(hashed)).drop("_odd_id")


def file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that orders the rows as they were written: by the numbers that Spark puts into the names of a table's files, then by the row within its file.

    Files of other names come after those, by path. Parquet files tell the rows' numbers; any other frame, such as one that
    was joined or made in memory, is in its own order. A frame that was only cut or sorted since it was read has its files' order.
    """
    try:
        path, row = (docs.metadataColumn("_metadata")[x] for x in ("file_path", "row_index"))
        number = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("long")
        part = number(r"/part-([0-9]{1,18})-[^/]*$")
        return docs.withColumn(name, F.struct(part.isNull().alias("other"), part.alias("part"), number(r"/part-[^/]*-c([0-9]{1,18})\.[^/]*$").alias("file"), path.alias("path"), row.alias("row")))
    except AnalysisException:
        return docs.withColumn(name, F.struct(F.monotonically_increasing_id().alias("row")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole documents must fit a Python worker, so a batch ends at BATCH_BYTES or `rows`, whichever comes first; a longer document stands alone.

    These are settings of the session, which Spark reads when a query starts, and they stay; lower ones of the user's stay, too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets, from 0; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about `limit` bytes; empty rows included."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def gather(d: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the pieces of d, one after another."""
    ends = np.cumsum(lengths)
    out = np.empty(ends[-1] if len(ends) else 0, d.dtype)
    a = at = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, at + GATHERED, "right")))
        out[at : ends[b - 1]] = d[np.arange(at, ends[b - 1]) + np.repeat((starts - ends + lengths)[a:b], lengths[a:b])]
        a, at = b, int(ends[b - 1])
    return out


def byte_class(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    table[list(inside if inside is not None else outside)] = inside is not None
    return table


NOT_SPACE = byte_class(outside=SPACES)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in the class, within one row), and each row's number of words."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    mask = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before &= ~cut[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after &= ~cut[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    edges = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(edges)


_SEEDED = np.random.default_rng(20240229)
_BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct k-word shingles as sorted 64-bit hashes; a row of fewer words is one shingle, one of none is empty."""
    n = len(hashes)
    step = np.uint64(0xD6E8FEB86659FD93)
    joined = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        joined = (joined + hashes[j : j + len(joined)]) * step
    joined = mixed(joined)
    at = 0
    for c in counts.tolist():
        if c >= k:
            yield np.unique(joined[at : at + c - k + 1])
        elif c:
            one = np.array([c], np.uint64)
            for j in range(at, at + c):
                one = mixed(one * step + hashes[j : j + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)
        at += c

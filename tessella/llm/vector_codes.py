"""Vector codes: codebooks for the parts of vectors, fitted by filtering Lloyd over kd-trees that stay where they were built."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, small_batches, stored

#: Parts of a vector, entries of a codebook, rounds of Lloyd's algorithm, integer steps of a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block of trees, points of a leaf at most.
BLOCK, LEAF = 1 << 15, 32


def safe(width: int) -> int:
    """Components below this leave squared distances of parts, also of doubled ones, within 64 bits; larger ones are counted in Python's integers."""
    return int(2**29 / max(width, 1) ** 0.5)


def integers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """(parts, n, width) floors of scale * x; a last part that isn't full ends in zeros, which are at no distance from each other."""
    x = np.floor(vectors.astype(np.float64) * scale)
    width = -(-x.shape[1] // parts)
    x = x.astype(np.int64) if not x.size or np.abs(x).max() < safe(width) else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    x = np.concatenate([x, np.zeros((len(x), parts * width - x.shape[1]), x.dtype)], axis=1)
    return x.reshape(len(x), parts, width).transpose(1, 0, 2)


class KdTree:
    """A balanced kd-tree over points, level by level: each node is a range of the points in the tree's order, with its bounding box, sum and count."""

    def __init__(self, points: np.ndarray):
        order, edges, levels = np.arange(len(points)), np.array([0, len(points)]), []
        while True:
            p = points[order]
            low, high = np.minimum.reduceat(p, edges[:-1]), np.maximum.reduceat(p, edges[:-1])
            levels.append((edges, low, high, np.add.reduceat(p, edges[:-1])))
            sizes = np.diff(edges)
            if sizes.max() <= LEAF:
                break
            node = np.repeat(np.arange(len(sizes)), sizes)
            widest = (high - low).astype(np.float64).argmax(1)
            order = order[np.lexsort((p[np.arange(len(p)), widest[node]].astype(np.float64), node))]
            edges = np.append(np.stack([edges[:-1], edges[:-1] + sizes // 2], 1).ravel(), len(points))
        self.points, self.order, self.levels = points[order], order, levels

    def assigned(self, book: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(sums, counts) of the points nearest to each entry, ties to the lower one; and each point's entry if asked for.

        An entry leaves a node's list if the entry nearest to the middle of its box is nearer to every corner, and so to every
        point; a node with one entry left is assigned whole. What is left at the leaves is compared one by one.
        """
        sums, counts = np.zeros(book.shape, self.points.dtype), np.zeros(len(book), np.int64)
        out = np.zeros(len(self.points), np.int64) if codes else None
        nodes, listed = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for depth, (edges, low, high, total) in enumerate(self.levels):
            if not len(nodes):
                break
            listed = eliminated(low[nodes], high[nodes], listed, book)
            one = listed.sum(1) == 1
            whole, entry = nodes[one], listed[one].argmax(1)
            np.add.at(counts, entry, edges[whole + 1] - edges[whole])
            np.add.at(sums, entry, total[whole])
            if codes:
                out[_ranges(edges[whole], edges[whole + 1])] = np.repeat(entry, edges[whole + 1] - edges[whole])
            nodes, listed = nodes[~one], listed[~one]
            if depth + 1 < len(self.levels):
                nodes, listed = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(listed, 2, axis=0)
        at = _ranges(edges[nodes], edges[nodes + 1])
        if len(at):
            far = squared(self.points[at], book)
            far[~np.repeat(listed, edges[nodes + 1] - edges[nodes], axis=0)] = far.max() + 1
            entry = far.argmin(1)
            np.add.at(counts, entry, 1)
            np.add.at(sums, entry, self.points[at])
            if codes:
                out[at] = entry
        return sums, counts, out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(points, entries) squared distances."""
    out = np.zeros((len(points), len(book)), np.result_type(points, book))
    for j in range(book.shape[1]):
        d = points[:, None, j] - book[None, :, j]
        out += d * d
    return out


def eliminated(low: np.ndarray, high: np.ndarray, listed: np.ndarray, book: np.ndarray) -> np.ndarray:
    """listed without the entries that are no point's nearest, for boxes (nodes, width) and lists (nodes, entries)."""
    middle = squared(low + high, 2 * book)
    best = np.where(listed, middle, middle.max() + 1).argmin(1)
    z = book[best]
    own, other = np.zeros(listed.shape, middle.dtype), np.zeros(listed.shape, middle.dtype)
    for j in range(book.shape[1]):
        towards = book[None, :, j] > z[:, None, j]
        corner = np.where(towards, high[:, None, j], low[:, None, j])  # where the entry is best off against z
        a, b = corner - book[None, :, j], corner - z[:, None, j]
        own += a * a
        other += b * b
    entry = np.arange(len(book))
    return listed & ((own < other) | ((own == other) & (entry[None, :] <= best[:, None])))


def _kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return out.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _first(kept: DataFrame, n: int) -> list:
    return kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(n).select("vector").collect()


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the vectors, and the codebook of each part, an array of (entries, width) integers.

    Each task builds kd-trees over the parts of its vectors, in blocks of BLOCK, and they are stored in the shared folder, so a
    round reads them wherever it runs; only the entries' sums and counts leave the tasks. Rows whose vector is null, empty
    or holds null, NaN or infinite components are dropped, as are those of another length than that of the smallest vec_id.
    Null ids come last; repeated ids are rows like others, in the order of their vectors. With fewer vectors than entries
    the codebooks are shorter; an empty table has none. A length that isn't a multiple of `parts` is filled up with zeros.
    Errors above the largest long are given as that. Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kept = _kept(rows, id_col, vector_col, label_col)
    kind = dict(kept.dtypes)["label"]
    schema = f"vec_id long, label {kind}, code string, error long"
    first = _first(kept, 1)
    if not first:
        return spark.createDataFrame([], schema), []
    kept = kept.where(F.size("vector") == len(first[0]["vector"]))
    books = list(integers(np.array([r["vector"] for r in _first(kept, entries)], np.float64), parts, scale))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vectors = (table.column(c).combine_chunks() for c in range(3))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            trees = [KdTree(p) for p in integers(flat, parts, scale)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees, 5)], pa.large_binary()).cast(pa.binary())], names=["ids", "labels", "trees"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(a, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    blocks = stored(kept.mapInArrow(build, f"ids array<long>, labels array<{kind}>, trees binary"))

    def summed(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [[0] * b.size for b in books]
            many = [[0] * len(b) for b in books]
            for batch in batches:
                for x in batch.column(0):
                    for p, tree in enumerate(pickle.loads(x.as_py())):
                        sums, counts, _ = tree.assigned(books[p])
                        total[p] = [a + b for a, b in zip(total[p], sums.ravel().tolist(), strict=True)]
                        many[p] = [a + b for a, b in zip(many[p], counts.tolist(), strict=True)]
            width = books[0].shape[1]
            out = [(p, i // width, i % width, str(s), many[p][i // width]) for p in range(len(books)) for i, s in enumerate(total[p]) if many[p][i // width]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["part", "entry", "position", "total", "n"])

        return run

    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(summed(books), "part int, entry int, position int, total string, n long")
        sums = sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        new = [b.astype(object) for b in books]
        #: parts * entries * width rows.
        for r in sums.collect():
            new[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
        books = [b.astype(np.int64) if max(map(abs, b.ravel().tolist())) < safe(b.shape[1]) else b for b in new]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in range(2))
                out, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(pickle.loads(batch.column(2)[i].as_py())):
                    got = tree.assigned(books[p], codes=True)[2]
                    away = tree.points - books[p][got]
                    out[tree.order, p] = got
                    whole = np.zeros(len(ids), away.dtype)
                    whole[tree.order] = (away * away).sum(1)
                    error = error + whole
                text = out.tobytes().hex()
                w = 2 * len(books)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[j : j + w] for j in range(0, len(text), w)], pa.string()), pa.array([min(e, 2**63 - 1) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(encode, schema), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """coded with the vector (array<double>) that each code stands for: the middles of its entries' steps."""
    entries = F.array(*(F.array(*(F.array(*(F.lit((x + 0.5) / scale) for x in e.tolist())) for e in b)) for b in books))
    parts = F.transform(F.sequence(F.lit(1), F.lit(len(books))), lambda p: F.element_at(F.element_at(entries, p), F.conv(F.substring(F.col("code"), 2 * p - 1, F.lit(2)), 16, 10).cast("int") + 1))
    return coded.withColumn("vector", F.flatten(parts))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes(documents(spark, sf_dir, "embeddings"))
    out = stored(out)
    sums = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "same_label")
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("same_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Each round as two common tables, over all vectors, parts and entries."""
    steps = [
        "kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, list_transform(list_slice(e, part * len(e) // {PARTS} + 1, (part + 1) * len(e) // {PARTS}), lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS c FROM kept, range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, c FROM (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, any_value(p.c) AS c, min(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + entry) AS m FROM p JOIN b{i} b USING (part) GROUP BY vec_id, label, part)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT part, m % {ENTRIES} AS entry, position, sum(x) AS s, count(*) AS n FROM (SELECT part, m, unnest(c) AS x, generate_subscripts(c, 1) AS position FROM a{i}) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(t.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY position)::BIGINT[] AS c FROM s{i} GROUP BY part, entry) t USING (part, entry))")
    steps.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) FROM (SELECT part, entry, array_to_string(c, ',') AS x FROM b{ROUNDS})) AS codebooks_sha256 FROM r"


SQL = {"op12_vector_codes": _sql()}

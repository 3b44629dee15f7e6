"""MinHash near-dedup: an inverted join over signature coordinates, whose matches are confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, LOWER_BYTES, NOT_SPACE, discard, documents, gather, mixed, raw, shingles, slices, small_batches, stored, word_hashes, words
from tessella.llm.graph import components, merged

#: Coordinates of a signature, hash functions whose least values make up one coordinate, and how many coordinates must be
#: equal for a pair to be looked at. At similarity 0.8 a coordinate is equal with probability 0.512; fewer than 8 of 48
#: are for one pair in 7 million. Unrelated texts share single least values, but hardly three at once.
COORDINATES, JOINED, MATCHES = 48, 3, 8
#: From so many equal coordinates on a document is taken to resemble a pivot; this only decides on the way it is handled.
NEAR = 3
HASHES = COORDINATES * JOINED
_rng = np.random.default_rng(8128)
_ODD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _signatures(k: int):
    odd, flip = _ODD[:, None], _FLIP[:, None]
    place = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(HASHES, 2**64 - 1, np.uint64)
        for at in range(0, len(s), 1024):
            np.minimum(least, ((s[None, at : at + 1024] ^ flip) * odd).min(axis=1), out=least)
        least = mixed(least)
        token = place
        for j in range(JOINED):
            token = mixed(token + least[j::JOINED])
        return token.view(np.int64), token.astype(np.uint16).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            keys, sizes, tokens, coordinates, has = [], [], [], [], []
            for _, _, d, o in slices(data, offsets):
                d = LOWER_BYTES[d]
                starts, ends, counts = words(d, o, NOT_SPACE)
                keys += _sequences(d, starts, ends, counts)
                for s in shingles(word_hashes(d, starts, ends), counts, k):
                    sizes.append(len(s))
                    has.append(len(s) > 0)
                    if len(s):
                        token, short = signature(s)
                        tokens.append(token)
                        coordinates.append(short)
            lists = []
            for parts, size in ((tokens, COORDINATES), (coordinates, COORDINATES // 4)):
                ends = np.concatenate([[0], np.cumsum(np.array(has, np.int32)) * size]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *lists], names=["doc_id", "n_shingles", "words_key", "tokens", "coordinates"])

    return run


def _sequences(d: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """SHA-256 of each row's words, one space after each; none for a row without words."""
    lengths = ends - starts + 1
    plain = gather(np.append(d, np.uint8(32)), starts, lengths)
    edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    plain[edges[0] + np.cumsum(lengths) - 1] = 32
    return [hashlib.sha256(plain[a:b]).digest() if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _full_set(text: str, k: int) -> set:
    w = _WORD.findall(text.translate(LOWER))
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _confirm(k: int, percent: int):
    """For rows (a, b, their texts, ...): those whose similarity is high enough, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            good = []
            for i in range(len(batch)):
                if a[i].as_py() != last:
                    last, kept = a[i].as_py(), _full_set(ta[i].as_py(), k)
                other = _full_set(tb[i].as_py(), k)
                both = len(kept & other)
                good.append(100 * both >= percent * (len(kept) + len(other) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (a, b, *batch.columns[4:])], names=["a", "b", *batch.schema.names[4:]])

    return run


def _equal_coordinates(a: str, b: str) -> Column:
    """How many coordinates are equal: four to a number, 16 bits each; the bits that differ are folded into the lowest of each, and those are counted."""
    different = None
    for i in range(COORDINATES // 4):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
        different = n if different is None else different + n
    return COORDINATES - different


def _counted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) with the numbers of shingles na, nb and of equal coordinates: those that brought the pair together and those of the lists that were skipped, which are probed here. A coordinate's value is compared by 16 bits, so a pair may have one too many, never one too few."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("coordinates").alias("xa"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("coordinates").alias("xb"))
    return pairs.join(left, "a").join(right, "b").withColumn("equal", _equal_coordinates("xa", "xb")).drop("xa", "xb")


def _confirmed(near: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of class representatives, with columns of longs besides, those with a high enough similarity."""
    more = [c for c in near.columns if c not in ("a", "b")]
    both = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return stored(both.select("a", "b", "ta", "tb", *more).mapInArrow(_confirm(k, percent), ", ".join(f"{c} long" for c in ("a", "b", *more))))


def _residuals(k: int):
    """For rows (pivot, doc_id, its text, the pivot's): how many shingles both have, and which the pivot hasn't."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        data, offsets = raw(column)
        for _, _, d, o in slices(data, offsets):
            d = LOWER_BYTES[d]
            starts, ends, counts = words(d, o, NOT_SPACE)
            out += shingles(word_hashes(d, starts, ends), counts, k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            met, rest = [], []
            for i, (p, own) in enumerate(zip(batch.column(0).to_pylist(), sets(batch.column(2)), strict=True)):
                if p != last:
                    last, pivot = p, sets(batch.column(3).slice(i, 1))[0]
                at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                common = pivot[at] == own
                met.append(int(common.sum()))
                rest.append(own[~common].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rest) if rest else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met, pa.int64()), lists], names=["p", "x", "met", "rest"])

    return run


def _hashed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = raw(batch.column(1))
            for first, last, d, o in slices(data, offsets):
                d = LOWER_BYTES[d]
                starts, ends, counts = words(d, o, NOT_SPACE)
                sets = list(shingles(word_hashes(d, starts, ends), counts, k))
                owner = np.repeat(ids[first:last], [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["doc_id", "h"])

    return run


def _hopeless(open_ids: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the documents that are left, those of whose shingles so many are in none of the others that no similarity can be high enough.

    A shingle of one document has that as its smallest and only owner, so counts by shingle and then by owner are enough.
    """
    rows = texts.join(open_ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_hashed(k), "doc_id long, h long")
    alone = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    return alone.join(reps.select("doc_id", "n_shingles"), "doc_id").where(100 * (F.col("n_shingles") - F.col("alone")) < percent * F.col("n_shingles")).select("doc_id")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct word shingles (a document of
    fewer words is one shingle, one without words has no links). component_id is the smallest id reachable.

    1. Documents of the same words in the same order are one class (SHA-256 of the words), represented by its smallest id;
       only representatives go on. Equal sets of other sequences meet like all others.
    2. Each representative is posted under each (coordinate, value) of its signature. In the order of global frequency,
       rarest first, two documents with MATCHES equal coordinates must meet under one of the first
       COORDINATES - MATCHES + 1, the prefix; values that nobody else has use these places up, so a document with too many
       of them drops out. Only these lists are merged into pairs. The remaining, longer lists are skipped: for a pair that
       the prefixes bring together they are probed, so that all its collisions are counted, and only pairs of MATCHES
       collisions are retained.
    3. In each list all are first paired with the pivot, the one whose coordinates most others share: the centre of a group
       of copies. Pairs of enough collisions are confirmed on full sets and joined into components.
    4. Documents x, y of one list that are still in different components are paired where they can be similar enough. What
       they have in common is in the pivot or not. If x and y resemble the pivot, at most the smaller of what either shares
       with it is in it, so the rest must be made up by shingles that the pivot hasn't: x and y are joined on these, the
       few words in which a copy differs, again by prefixes, rarest first. Only where both are all but inside a larger
       pivot they may need none, and are compared by these numbers alone. Documents unlike the pivot are paired with
       all others of their list, but first those drop out of whose shingles more than 100 - percent in 100 are in no
       other such document.

    So no link between components is lost, while a group of copies costs one pair per copy and list, not all pairs.

    The signature's parameters are for a percent of 80 or more; lower ones are refused.

    Null text is empty. A null id isn't compared: its component_id is null and it is kept. Rows that repeat an id must repeat
    its text; they share a component and are all kept or dropped together. Other columns are ignored.
    """
    if percent < 80:
        raise ValueError("the signatures are made for 80 percent or more")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = stored(docs.mapInArrow(_signatures(shingle_words), "doc_id long, n_shingles long, words_key binary, tokens array<long>, coordinates array<long>"))
    tables: list[DataFrame] = []

    def table(df: DataFrame) -> DataFrame:
        tables.append(stored(df))
        return tables[-1]

    usable = signed.where("words_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("words_key").agg(F.min("doc_id").alias("rep"))
    reps = table(usable.join(classes, (usable.words_key == classes.words_key) & (usable.doc_id == classes.rep)).dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "tokens", "coordinates"))

    posts = reps.select("doc_id", F.explode("tokens").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = table(posts.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("order"), F.sum("n").alias("centre")).where(F.size("order") >= MATCHES))
    lists = table(ordered.select("doc_id", "centre", F.explode(F.slice("order", F.lit(1), F.size("order") - (MATCHES - 1))).alias("t")).select(F.col("t.token").alias("token"), "doc_id", "centre"))
    texts = table(docs.join(ordered.select("doc_id"), "doc_id", "left_semi"))

    pivots = lists.groupBy("token").agg(F.max_by("doc_id", F.struct("centre", -F.col("doc_id"))).alias("p"))
    lists = table(lists.join(pivots, "token").select("token", "p", F.col("doc_id").alias("x")))
    star = lists.where("x <> p").select(F.col("x").alias("a"), F.col("p").alias("b")).distinct()
    star = table(_counted(star, reps))
    likely = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("equal") >= MATCHES)
    # of two documents always the same one, of the greater centre, is the pivot, so no pair comes both ways
    near = table(star.where(likely).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = _confirmed(near, texts, shingle_words, percent)
    labels = components(links)

    def labelled(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("id").alias(key), F.col("label").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    resembling = F.col("equal") >= NEAR
    around = labelled(labelled(star.where(resembling).select(F.col("a").alias("x"), F.col("b").alias("p"), F.col("na").alias("n"), F.col("nb").alias("np")), "x", "lx"), "p", "lp")
    open_pivots = around.where("lx <> lp").select("p").distinct()
    around = table(around.join(open_pivots, "p", "left_semi"))
    with_texts = around.select("p", "x").join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("doc_id").alias("p"), F.col("text").alias("tp")), "p")
    rest = with_texts.select("p", "x", "tx", "tp").mapInArrow(_residuals(shingle_words), "p long, x long, met long, rest array<long>")
    around = table(around.join(rest, ["p", "x"]))
    differing = F.col("lx") != F.col("ly")
    # shingles outside the pivot, rarest around it first, up to where fewer are left than x must have in common with any other
    outside = around.select("p", "x", "lx", F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("met")).alias("k"), (F.col("lx") != F.col("lp")).alias("apart"), F.explode("rest").alias("h"))
    often = outside.groupBy("p", "h").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("any")).where("n > 1 AND any").drop("any")
    ranked = outside.join(often, ["p", "h"]).groupBy("p", "x", "lx", "k", "apart").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("order"))
    prefix = table(ranked.where(F.size("order") >= F.col("k")).select("p", "x", "lx", "apart", F.explode(F.slice("order", F.lit(1), (F.size("order") - F.col("k") + 1).cast("int"))).alias("t")).select("p", F.col("t.h").alias("h"), "x", "lx", "apart"))
    sharing = prefix.where("apart").select("p", "h", "x", "lx").join(prefix.select("p", "h", F.col("x").alias("y"), F.col("lx").alias("ly"), F.col("apart").alias("both")), ["p", "h"]).where(differing & (~F.col("both") | (F.col("x") < F.col("y")))).select("x", "y", "lx", "ly")
    # without any in common outside the pivot
    x, y = around.where("lx <> lp").select("p", "x", "n", "np", "lx", "met"), around.select("p", F.col("x").alias("y"), F.col("n").alias("m"), F.col("lx").alias("ly"), F.col("met").alias("met_y"))
    enough = F.least("met", "met_y") * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    small = x.where(100 * F.col("met") >= percent * F.col("n")).join(y.where(100 * F.col("met_y") >= percent * F.col("m")), "p").where(differing & (F.col("m") < F.col("np")) & enough).select("x", "y", "lx", "ly")

    far = star.where(~resembling).select(F.col("a").alias("x"), F.col("b").alias("p"))
    apart = lists.join(far, ["x", "p"], "left_semi").select("token").distinct()
    apart = table(labelled(lists.join(apart, "token"), "x", "lx"))
    hopeless = _hopeless(apart.select(F.col("x").alias("doc_id")).distinct(), reps, texts, shingle_words, percent)
    apart = table(apart.join(hopeless.withColumnRenamed("doc_id", "x"), "x", "left_anti"))
    lone = apart.join(far, ["x", "p"], "left_semi").select("token", "x", "lx", "p")
    direct = lone.join(apart.select("token", F.col("x").alias("y"), F.col("lx").alias("ly")), "token").where(differing & (F.col("y") != F.col("p"))).select("x", "y", "lx", "ly")

    pairs = sharing.unionByName(small).unionByName(direct).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("lx", "ly").alias("la"), F.greatest("lx", "ly").alias("lb")).distinct()
    near = table(_counted(pairs, reps).where(likely).select("a", "b", "la", "lb"))
    more = _confirmed(near, texts, shingle_words, percent)
    reached = merged(labels, components(more, "la", "lb"))
    for df in (*tables, links, more):
        discard(df)

    out = signed.select("doc_id", "n_shingles", "words_key").join(classes, "words_key", "left")
    out = out.join(reached, out.rep == reached.id, "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(documents(spark, sf_dir), shingle_words=2)


SQL = {
    "op10_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""
}

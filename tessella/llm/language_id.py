"""Language ID: text likelihoods fused with the declared language, the address suffix and smoothed priors of the host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LOWER_BYTES, NOT_SPACE, documents, raw, slices, small_batches, stored

#: Labelled rows of each language that the model is fitted on, about: those whose hash of the id is small enough.
SAMPLE_ROWS = 4000
#: A language needs so many labelled rows in all.
LEAST_ROWS = 5
#: Hashed byte trigrams of a model.
BUCKETS = 1 << 15
#: Each byte stands in three trigrams, which so are counted as a third each.
TEMPER = 1 / 3
#: How often a declared language is the true one.
DECLARED = 0.9
#: Documents' worth of the parent that a host's or suffix's prior is smoothed with.
SMOOTHING = 20.0
#: Rejected below this probability.
LEAST_PROBABILITY = 0.5


@dataclass(frozen=True)
class LanguageModel:
    """languages, and the log probability of each trigram bucket in each: at most BUCKETS numbers a language."""

    languages: list[str]
    table: np.ndarray


def _buckets(d: np.ndarray) -> np.ndarray:
    """The trigram bucket at each byte but the last two; BUCKETS where it isn't of letters and white space alone, so that numbers and signs say nothing of a language."""
    if len(d) < 3:
        return np.zeros(0, np.int64)
    x = LOWER_BYTES[d].astype(np.uint32)
    h = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
    spoken = _letters(d) | ~NOT_SPACE[d]
    return np.where(spoken[:-2] & spoken[1:-1] & spoken[2:], (h * np.uint32(2654435761)) >> np.uint32(32 - 15), BUCKETS).astype(np.int64)


def _letters(d: np.ndarray) -> np.ndarray:
    x = LOWER_BYTES[d]
    return ((x >= 97) & (x <= 122)) | (x >= 128)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits on about `rows` labelled rows of each language, chosen by hash of the id, and on all rows of a language with fewer.

    Labels are counted over all rows first. The driver holds these counts and, of each language with LEAST_ROWS rows, its
    trigram counts and its row of the model, some 256 KB.
    """
    labelled = docs.select(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    numbers = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS).collect()
    if not numbers:
        return LanguageModel([], np.zeros((0, BUCKETS)))
    tops = docs.sparkSession.createDataFrame([(r["label"], min(2**63 - 1, 2**63 * rows // r["n"])) for r in numbers], "label string, top long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for i, label in enumerate(batch.column(1).to_pylist()):
                totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                seen[label] = seen.get(label, 0) + 1
                for at in range(offsets[i], offsets[i + 1], 1 << 22):
                    totals[label] += np.bincount(_buckets(data[at : min(at + (1 << 22) + 2, offsets[i + 1])]), minlength=BUCKETS + 1)[:BUCKETS]
        for label, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1)), pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[seen[label]], total[at]]))], names=["label", "bucket", "n"])

    counted = labelled.join(F.broadcast(tops), "label").where("h <= top").select("text", "label").mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted[counted.bucket == -1].label)
    table = np.full((len(languages), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(languages)}
    used = counted[(counted.bucket >= 0) & counted.label.isin(languages)]
    table[used.label.map(at).to_numpy(int), used.bucket.to_numpy(int)] += used.n.to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def score(model: LanguageModel):
    """For mapInArrow over (id, text, ...): adds each language's tempered log likelihood, its probability by the text alone, the mean log likelihood of a trigram in the best, and the number of letters."""
    k, table = len(model.languages), np.pad(model.table, ((0, 0), (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            n = len(offsets) - 1
            sums, letters, grams = np.zeros((k, n)), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b, d, o in slices(data, offsets):
                x = np.zeros(len(d) + 1, np.int64)
                np.cumsum(_letters(d), out=x[1:])
                letters[a:b] = np.diff(x[o])
                buckets = _buckets(d)
                ends = np.maximum(o[1:] - 2, o[:-1])
                np.cumsum(buckets < BUCKETS, out=x[1 : len(buckets) + 1])
                grams[a:b] = x[ends] - x[o[:-1]]
                total = np.zeros(len(d) + 1)
                for j in range(k):
                    np.cumsum(table[j][buckets], out=total[1 : len(buckets) + 1])
                    sums[j, a:b] = total[ends] - total[o[:-1]]
            fits = sums * TEMPER
            p = np.exp(fits - fits.max(axis=0)) if k else np.zeros((0, n))
            p /= p.sum(axis=0) if k else 1
            best = sums.max(axis=0) / np.maximum(grams, 1) if k else np.zeros(n)
            ends = pa.array(np.arange(0, (n + 1) * k, k) if k else np.zeros(n + 1), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v.T).ravel())) for v in (fits, p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *lists, pa.array(best), pa.array(letters)], names=["doc_id", "declared", "host", "suffix", "fits", "p", "best", "letters"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """One row per document: doc_id, lang, probability, text_lang, kept.

    The posterior of language l is proportional to its text likelihood, times the chance of the declared language given l,
    times the host's prior. A host's prior is its documents' mean probabilities by text, smoothed with that of its address
    suffix, and that with all documents'; the document itself is left out of each. Sums by host and suffix are partial
    aggregates; they are joined back by host, where Spark broadcasts them only under its own size threshold and else splits
    a hot host's rows. Unknown declarations, hosts and suffixes (null) are no evidence or a host of their own.

    kept is false for a document without letters, one whose trigrams are less likely in every language than by chance, and
    one whose best language has less than `least`; but a document with letters whose declared language the model lacks is
    kept, since the model can't tell. If its trigrams are less likely than by chance, too, lang is the declared one, with
    no probability. Null text is empty. Without any language in the model lang is null, and
    only a document without letters is rejected. Rows that repeat an id are judged one by one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col), *(none if x is None else x.cast("string") for x in (declared, host, suffix)))
    scored = stored(plain.toDF("doc_id", "text", "declared", "host", "suffix").mapInArrow(score(model), "doc_id long, declared string, host string, suffix string, fits array<double>, p array<double>, best double, letters long"))
    letters, k = F.col("letters") > 0, len(model.languages)
    if not k:
        return scored.select("doc_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), letters.alias("kept"))

    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    everywhere = scored.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    share = [(everywhere[i] or 0.0) / max(everywhere["n"], 1) for i in range(k)]
    hosts = scored.groupBy("suffix", "host").agg(*sums, F.count(F.lit(1)).alias("n"))
    hosts = hosts.select(F.col("suffix").alias("suffix_"), F.col("host").alias("host_"), F.array(*(f"s{i}" for i in range(k))).alias("of_host"), F.col("n").alias("n_host"))
    suffixes = scored.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("n"))
    suffixes = suffixes.select(F.col("suffix").alias("suffix__"), F.array(*(f"s{i}" for i in range(k))).alias("of_suffix"), F.col("n").alias("n_suffix"))
    both = scored.join(hosts, F.col("suffix").eqNullSafe(F.col("suffix_")) & F.col("host").eqNullSafe(F.col("host_")), "left").join(suffixes, F.col("suffix").eqNullSafe(F.col("suffix__")), "left")

    weights = []
    for i, language in enumerate(model.languages):
        own = F.col("p")[i]
        parent = (F.col("of_suffix")[i] - own + SMOOTHING * share[i]) / (F.col("n_suffix") - 1 + SMOOTHING)
        prior = (F.col("of_host")[i] - own + SMOOTHING * parent) / (F.col("n_host") - 1 + SMOOTHING)
        said = F.when(~F.coalesce(F.col("declared").isin(model.languages), F.lit(False)), F.lit(1.0)).when(F.col("declared") == language, F.lit(DECLARED)).otherwise(F.lit((1 - DECLARED) / max(k - 1, 1)))
        weights.append(F.col("fits")[i] + F.log(F.greatest(prior, F.lit(1e-12))) + F.log(said))
    names = F.array(*map(F.lit, model.languages))
    out = both.withColumn("w", F.array(*weights)).withColumn("top", F.array_max("w"))
    out = out.withColumn("probability", 1 / F.aggregate("w", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    spoken = letters & (F.col("best") >= float(-np.log(BUCKETS)))
    lacking = letters & F.coalesce(~F.col("declared").isin(model.languages), F.lit(False))
    foreign = lacking & ~spoken
    return out.select(
        "doc_id",
        F.when(foreign, F.col("declared")).when(letters, F.element_at(names, F.array_position("w", F.col("top")).cast("int"))).alias("lang"),
        F.when(letters & ~foreign, F.round("probability", 6)).alias("probability"),
        F.when(letters, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))).alias("text_lang"),
        (lacking | (spoken & (F.col("probability") >= least))).alias("kept"),
    )


def page_evidence(pages: DataFrame) -> tuple[Column, Column, Column]:
    """Declared language, host and address suffix of pages (url, html)."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(declared != "", declared), F.when(host != "", host), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs), declared=F.col("lang"), host=F.col("source"))


def llm_language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of `documents` on `pages`: text without markup, and all three kinds of outside evidence."""
    pages = documents(spark, sf_dir, "pages")
    bare = pages.withColumn("bare", F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "))
    declared, host, suffix = page_evidence(pages)
    return identify(bare, fit(documents(spark, sf_dir)), "page_id", "bare", declared, host, suffix).withColumnRenamed("doc_id", "page_id")

"""Token counts: rollups by source, language and tokenizer version that signed deltas maintain, batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NOT_SPACE, documents, raw, shared_dir, slices, small_batches, words
from tessella.llm.token_ids import loaded

_ENTRY = "doc_id long, source string, lang string, tokenizer string, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str | None = None, version: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): words of every document, and ids where a tokenizer file is given.

    Null text has 0. Each row is counted by itself, whether its id is null or repeated; no rows give no rows. Null sources and
    languages stay null. Other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            counts = [("words/1", np.concatenate([np.zeros(0, np.int64), *(words(d, o, NOT_SPACE)[2] for _, _, d, o in slices(data, offsets))]))]
            if tokenizer:
                bpe = loaded(tokenizer)
                counts.append((version, np.concatenate([np.zeros(0, np.int64), *(n for _, n in bpe.encode(data, offsets))])))
            for name, n in counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([name] * len(n), pa.string()), pa.array(n)], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, _ENTRY)


class TokenLedger:
    """Rollups in a shared folder. A batch is one folder of deltas, `batch=<id>`, and counts from when that name exists.

    A delta has the key (source, lang, tokenizer) and the signed numbers of documents and tokens. They are additive: the
    totals are the sum over all committed batches, in any order. An attempt writes its deltas under a name of its own and then
    renames them, unless the batch's name exists: the store decides which of several attempts at once is the one that
    counts, and the others are removed. A batch whose name exists is not applied again. Where a store can't refuse such a
    rename in one step (a local disk checks first), two attempts at the very same instant are not told apart.

    Null sources and languages are keys of their own. Entries that repeat are counted as often as they stand. Without entries
    a batch is committed all the same. Names of batches must be fit for files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"batch={batch}"))

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Applies entries (as of token_counts) once: inserts count up, deletes down, revised = (old, new) down and up. False if it had been applied before."""
        if self.committed(batch):
            return False
        parts = [(inserts, 1), (deletes, -1), *(zip(revised, (-1, 1), strict=True) if revised else ())]
        signed = None
        for part, sign in parts:
            if part is not None:
                one = part.select("source", "lang", "tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))
                signed = one if signed is None else signed.unionByName(one)
        if signed is None:
            signed = self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        deltas = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        staged = f"_staged-{batch}-{uuid.uuid4().hex}"
        deltas.write.parquet(f"{self.folder}/{staged}")
        return self._publish(staged, batch)

    def _publish(self, staged: str, batch: str) -> bool:
        """Renames what an attempt has written to the batch's name; false, and nothing left of it, if there is one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._path(staged), self._path(f"batch={batch}"), never)
        except Py4JJavaError as error:
            self._fs.delete(self._path(staged), True)
            if "FileAlreadyExistsException" in str(error.java_exception.toString()):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches; keys without documents or tokens left are gone."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        paths = [f"{self.folder}/{n}" for n in names if n.startswith("batch=")]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        totals = deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return totals.where("n_docs <> 0 OR n_tokens <> 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch of inserts, committed twice (the second is refused): rollups by words and by byte-level BPE."""
    import public_tokenizers

    ledger = TokenLedger(spark, shared_dir(spark))
    entries = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k/1")
    ledger.commit("all", entries)
    ledger.commit("all", entries)
    return ledger.totals()


def llm_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, revisions and deletes by words: documents in English are first counted without their last line and then revised; those with a toxic label go again."""
    docs = documents(spark, sf_dir)
    ledger = TokenLedger(spark, shared_dir(spark))
    english = docs.where("lang = 'en'")
    early = english.withColumn("text", F.regexp_replace("text", r"\n[^\n]*$", ""))
    ledger.commit("1", token_counts(docs.where("NOT (lang <=> 'en')")).unionByName(token_counts(early)))
    ledger.commit("2", revised=(token_counts(early), token_counts(english)))
    toxic = documents(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    ledger.commit("3", deletes=token_counts(docs.join(toxic, "doc_id", "left_semi")))
    ledger.commit("3", deletes=token_counts(docs))
    return ledger.totals()


SQL = {
    "llm_word_rollup": r"""
SELECT source, lang, 'words/1' AS tokenizer, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source, lang
"""
}

"""From raw documents to packed sequences: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.

Null texts count as empty; language ID rejects a text without letters. Rows whose id is null or repeated are rows of their
own until their texts are equal or near copies; they come after all others, so of such a group the row with an id of its own
stays. Rows that repeat id and text are one. Null sources are a source. Other columns are carried along, whatever their
names, up to packing; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, file_order, partitions, row_keys, shared_dir
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.language_id import fit, identify
from tessella.llm.minhash import minhash_dedup
from tessella.llm.mixing import mix
from tessella.llm.packing import pack, tokenized

#: A column that no table of documents has: what a row is known by within a stage.
KEY = "_pipeline_row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that language ID rejects."""
    keyed = row_keys(docs, KEY)
    told = identify(keyed, fit(docs), id_col=KEY, declared=F.col("lang"), host=F.col("source"))
    return keyed.join(told.where("NOT kept").select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row of the smallest doc_id; of rows that repeat an id or have none, one."""
    keyed = row_keys(docs, KEY)
    kept = exact_dedup(keyed, id_col=KEY).where("kept").select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    keyed = row_keys(docs, KEY)
    out = minhash_dedup(keyed, id_col=KEY).where("NOT kept").select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(out, KEY, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, each with its own share, in its order from file to file, which packing follows; all rows stay."""
    out = mix(docs)
    return out.repartitionByRange(partitions(spark), "mix_position").sortWithinPartitions("mix_position").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie: doc_id, piece, bin_id, bin_offset, n_tokens, bin_place.

    Bins are filled from stretches of the mix, that is, of the order of the rows in the files of docs (of a frame without files, of
    its rows). Bins in ascending bin_place follow the mix.
    """
    placed = file_order(docs.select("doc_id", "text", "source"), "place")
    return pack(tokenized(placed, order="place"), order="place")


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Likelihoods, signatures and schedules aren't for SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

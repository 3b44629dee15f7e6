"""Scans of documents that have been landed as pages of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import query, table
from tessella.sources import paged
from tessella.storage import shared_dir

_SIZE = 50
_STYLES = {"web": "cursor", "forum": "token", "books": "offset"}


def _landed(spark, sf_dir) -> str:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text", (1990 + F.col("n_chars") % 30).cast("int").alias("year"))
    path = shared_dir(spark)
    paged.land(docs, path, ["doc_id"], _SIZE, _STYLES)
    return path


@query(f"SELECT coalesce(source, '') AS source, (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1) // {_SIZE} AS page, doc_id, lang, (1990 + n_chars % 30)::INT AS year, md5(text) AS text_md5 FROM documents")
def paged_documents(spark, sf_dir):
    """SRC13, SRC14, SRC16: every document from the page it was landed in, each once."""
    out = paged.pages(spark, _landed(spark, sf_dir), "source string, page long, doc_id long, lang string, year int, text string", pagesPerTask="16")
    return out.select("source", "page", "doc_id", "lang", "year", F.md5("text").alias("text_md5"))


@query(f"SELECT source, count(*) AS n, min(doc_id) AS first_id FROM (SELECT coalesce(source, '') AS source, doc_id FROM documents WHERE 1990 + n_chars % 30 >= 2010) GROUP BY source")
def paged_recent_counts(spark, sf_dir):
    """SRC14: years rule out pages before they are read, and rows after."""
    out = paged.pages(spark, _landed(spark, sf_dir), "source string, doc_id long, year int", years=(2010, None))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""SELECT source, CASE source {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STYLES.items())} ELSE 'cursor' END AS style, 'ok' AS status, '' AS message, (n + {_SIZE - 1}) // {_SIZE} AS pages, n AS returned FROM (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL)""")
def paged_status(spark, sf_dir):
    """SRC13, UDF04: what each source has given."""
    return paged.page_status(spark, _landed(spark, sf_dir))

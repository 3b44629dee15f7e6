"""Operators of small texts and ledgers over whole tables: texts are built from columns, and the SQL reads the texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessella.functions import text as T
from tessella.operators import citations_graph as G
from tessella.operators import ledgers as L
from tessella.operators import literature as P
from tessella.plans.registry import query, table
from tessella.sources import texts as X

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)


@query(r"""WITH b AS (SELECT doc_id, trim(unnest(string_split_regex(chr(10) || coalesce(text, ''), '\n[ \t]*\n')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(body, '^#{1,6} ') OR regexp_matches(body, '^[^\n]+\n(=+|-+)$') THEN 'heading' WHEN body[1] = '|' THEN 'table' WHEN body[1] = '>' THEN 'quote' WHEN regexp_matches(body, '^([-*+]|\d+[.)]) ') THEN 'list' ELSE 'prose' END AS kind, count(*) AS n FROM b WHERE body <> '' GROUP BY ALL""")
def document_paragraphs(spark, sf_dir):
    """SRC01: how many paragraphs of each kind a document has."""
    return X.paragraphs(table(spark, sf_dir, "documents")).groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


_FRONT = "'---' || chr(10) || 'name: ' || p_name || chr(10) || 'size:' || p_size || chr(10) || 'no pair' || chr(10) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '---' END || chr(10) || 'type: ' || p_type"


@query(f"""WITH t AS (SELECT p_partkey, regexp_extract({_FRONT}, '(?s)^---\\n(.*?)\\n---', 1) AS b FROM part)
SELECT p_partkey, nullif(trim(regexp_extract(b, '(?m)^name:(.*)$', 1)), '') AS name, nullif(trim(regexp_extract(b, '(?m)^size:(.*)$', 1)), '') AS size, nullif(trim(regexp_extract(b, '(?m)^type:(.*)$', 1)), '') AS type FROM t""")
def part_front_matter(spark, sf_dir):
    """FLT15: keys of front matter; without its end there is none, and what follows it isn't part of it."""
    text = F.expr(_FRONT.replace("chr(10)", "'\\n'"))
    m = T.front_matter(text)
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("name", "size", "type")))


_NUMBERED = "CASE WHEN l_partkey % 11 = 0 THEN 'A line of prose' WHEN l_partkey % 13 = 0 THEN ' [' || (l_linenumber + 1) || '] Out of order' ELSE '[' || l_linenumber || '] A reference' END"


@query(rf"""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS pos, try_cast(regexp_extract({_NUMBERED}, '^\s*\[?(\d{{1,4}})[\].]', 1) AS INT) AS n FROM lineitem),
i AS (SELECT doc, pos, n, pos - n AS d, pos - row_number() OVER (PARTITION BY doc, pos - n ORDER BY pos) AS island FROM r WHERE n IS NOT NULL)
SELECT doc, min(pos) AS first_pos, count(*) AS n FROM i GROUP BY doc, d, island HAVING count(*) >= 3 AND min(n) = 1""")
def order_reference_runs(spark, sf_dir):
    """WIN01: runs of numbered lines of three or more, from 1 on."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.expr(_NUMBERED).alias("line"))
    return L.reference_runs(lines, 3)


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^\x09-\x0D\x20]+'), ' ')) AS text_md5 FROM documents WHERE regexp_matches(text, '[^\x09-\x0D\x20]')")
def document_inverted_texts(spark, sf_dir):
    """SCA11: whole texts put back together from their inverted indexes."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^\x09-\x0D\x20]+)"))).alias("i", "word"))
    entries = words.groupBy("doc_id", "word").agg(F.collect_list("i").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return entries.select("doc_id", F.md5(P.abstract_of(F.col("index"))).alias("text_md5"))


@F.pandas_udf(ArrayType(StringType()))
def _ladder(q: pd.Series) -> pd.Series:
    return q.map(lambda x: None if x is None else P.ladder(x))


_QUERY = "p_name || ' of ' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN ' boxes studies' ELSE ' class and policy' END"
_FORM = """CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%ses' OR t LIKE '%xes' THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, length(t) - 1)
  WHEN t LIKE '%y' AND substr(t, length(t) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substr(t, 1, length(t) - 1) || 'ies' ELSE t || 's' END"""


@query(f"""WITH q AS (SELECT p_partkey, {_QUERY} AS q FROM part), w AS (SELECT *, regexp_extract_all(lower(q), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS w FROM q),
d AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({_STOP})) AS kept FROM w), k AS (SELECT * REPLACE (CASE WHEN len(kept) > 0 THEN kept ELSE list_filter(w, lambda x, i: list_position(w, x) = i) END AS kept) FROM d),
r AS (SELECT p_partkey, [chr(34) || trim(q) || chr(34), array_to_string(kept, ' AND '), array_to_string(list_transform(kept, lambda t: '(' || t || ' OR ' || {_FORM} || ')'), ' AND '), q] AS r FROM k)
SELECT p_partkey, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ' | ') AS rungs FROM r""")
def part_query_ladders(spark, sf_dir):
    """SCA12, SCA13: each part's description as a search, from strict to loose."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(_ladder(F.expr(_QUERY)), " | ").alias("rungs"))


_DRAFT = "'Line ' || l_linenumber || CASE l_orderkey % 5 WHEN 0 THEN ' rose by 12%' WHEN 1 THEN ' with p < 0.05' ELSE ' is told' END || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE ' [src:S' || (l_suppkey + CASE WHEN l_partkey % 50 = 0 THEN 1000000 ELSE 0 END) || ']' END"
_SOURCES = "'S' || s_suppkey AS source_id, CASE WHEN s_suppkey % 7 = 0 THEN 'unverified' ELSE 'verified' END AS status, CASE WHEN s_suppkey % 9 = 0 THEN 'excluded' ELSE 'included' END AS inclusion, CASE WHEN s_suppkey % 11 = 0 THEN 'retracted' ELSE 'none' END AS retraction"


@query(rf"""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS pos, {_DRAFT} AS text FROM lineitem), s AS (SELECT {_SOURCES} FROM supplier), m AS (SELECT pos, unnest(regexp_extract_all(text, '\[src:([A-Za-z0-9]+)\]', 1)) AS token FROM l),
j AS (SELECT pos, token, CASE WHEN source_id IS NULL THEN 'unknown' WHEN retraction = 'retracted' THEN 'retracted' WHEN inclusion = 'excluded' THEN 'excluded' WHEN status <> 'verified' THEN 'unverified' END AS issue FROM m LEFT JOIN s ON token = source_id)
SELECT pos, token, issue FROM j WHERE issue IS NOT NULL UNION ALL SELECT pos, '', 'number without a marker' FROM l WHERE regexp_matches(text, '\d+(\.\d+)?\s?%|\bp\s?[<=]') AND NOT contains(text, '[src:')""")
def order_draft_audit(spark, sf_dir):
    """RUL04: a draft of all lines, whose markers name suppliers as sources."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.expr(_DRAFT).alias("text"))
    return L.draft_audit(lines, table(spark, sf_dir, "supplier").selectExpr(*_SOURCES.split(", ")))


@query("""WITH t AS (SELECT p_partkey AS query_id, unnest(string_split(p_type, ' ')) AS term FROM part), y AS (SELECT DISTINCT 'c' || (length(w) % 4) AS concept, lower(w) AS synonym FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part)),
c AS (SELECT query_id, concept FROM t JOIN y ON lower(term) = synonym) SELECT query_id, lower(term) AS term FROM t UNION SELECT query_id, synonym FROM c JOIN y USING (concept)""")
def part_term_expansion(spark, sf_dir):
    """GRA03: the words of each part's type with all synonyms of their concepts."""
    part = table(spark, sf_dir, "part")
    terms = part.select(F.col("p_partkey").alias("query_id"), F.explode(F.split("p_type", " ")).alias("term"))
    synonyms = terms.select(F.concat(F.lit("c"), (F.length("term") % 4).cast("string")).alias("concept"), F.lower("term").alias("synonym")).distinct()
    return G.expand_terms(terms, synonyms)

"""Records of papers, made of the tables of parts and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import literature as L
from tessella.plans.registry import example, query, table

_PAPERS = """p AS (SELECT p_partkey AS paper_id, p_partkey AS pos, p_name AS title, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1970 + p_size END AS year, p_size % 3 = 0 AS is_open, p_brand AS journal, p_type AS type,
  [split_part(p_name, ' ', 1), p_brand] AS authors, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 50 END AS citations, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ' ' || p_name END AS abstract,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'https://doi.org/10.1234/' || (p_partkey % 700) END AS doi, CASE WHEN p_partkey % 2 = 0 THEN 'x.pdf' END AS pdf FROM part)"""


def papers(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("paper_id"), k.alias("pos"), F.col("p_name").alias("title"), F.when(size % 7 != 0, 1970 + size).alias("year"), (size % 3 == 0).alias("is_open"), F.col("p_brand").alias("journal"), F.col("p_type").alias("type"),
        F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("authors"), F.when(k % 11 != 0, k % 50).alias("citations"), F.when(k % 5 == 0, "").otherwise(F.concat_ws(" ", "p_type", "p_name")).alias("abstract"),
        F.when(k % 4 != 0, F.concat(F.lit("https://doi.org/10.1234/"), (k % 700).cast("string"))).alias("doi"), F.when(k % 2 == 0, "x.pdf").alias("pdf"),
    )


@query(f"WITH {_PAPERS} SELECT paper_id, year, year IS NULL AS year_unknown FROM p WHERE (year IS NULL OR year BETWEEN 1980 AND 2010) AND is_open AND (citations IS NULL OR citations >= 10) AND lower(journal) LIKE '%brand#1%' AND abstract <> ''")
def paper_filter(spark, sf_dir):
    """FLT01."""
    keep = L.passes(year_min=1980, year_max=2010, open_access=True, cited_min=10, journal="Brand#1", has_abstract=True)
    return papers(spark, sf_dir).where(keep).select("paper_id", "year", F.isnull("year").alias("year_unknown"))


@query(f"WITH {_PAPERS} SELECT paper_id, matched_title, matched_type FROM (SELECT paper_id, regexp_matches(title, '(?i)red|ring') AS matched_title, regexp_matches(type, '(?i)red|ring') AS matched_type FROM p) WHERE matched_title OR matched_type")
def paper_regex_filter(spark, sf_dir):
    """FLT02."""
    return L.regex_filter(papers(spark, sf_dir), "red|ring", ["title", "type"]).select("paper_id", "matched_title", "matched_type")


@query(f"WITH {_PAPERS} SELECT count(*) AS n, sum((coalesce(year, 0) <> 0)::INT + 1 + (abstract <> '')::INT + (doi IS NOT NULL)::INT + 1) / (5 * count(*)) AS mean_completeness FROM p")
def paper_completeness(spark, sf_dir):
    """FLT03."""
    return papers(spark, sf_dir).where(L.usable()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(L.completeness()), 12).alias("mean_completeness"))


@query(rf"""WITH {_PAPERS}, t AS (SELECT paper_id, title, abstract, regexp_matches(title, '(?i)(?:^|[^\w])blue\w*')::INT + regexp_matches(title, '(?i)(?:^|[^\w])bolt\w*')::INT AS ti,
  regexp_matches(abstract, '(?i)(?:^|[^\w])blue\w*')::INT + regexp_matches(abstract, '(?i)(?:^|[^\w])bolt\w*')::INT AS ab, regexp_matches(journal, '(?i)(?:^|[^\w])blue\w*')::INT + regexp_matches(journal, '(?i)(?:^|[^\w])bolt\w*')::INT AS jo,
  regexp_matches(concat_ws(' ', title, abstract), '(?i)(?:^|[^\w])blue\w*')::INT + regexp_matches(concat_ws(' ', title, abstract), '(?i)(?:^|[^\w])bolt\w*')::INT AS bo, regexp_matches(title, '(?i)(?:^|[^\w])blue bolt(?:[^\w]|$)') AS ph FROM p)
SELECT paper_id, round(2 * ti / 2 + ab / 2 + 0.5 * jo / 2 + CASE WHEN ph THEN 3 ELSE 0 END + CASE WHEN ti = 2 THEN 2 WHEN bo = 2 THEN 0.5 ELSE 0 END, 3)::DOUBLE AS relevance,
  CASE WHEN ph OR ti = 2 THEN 'high' WHEN ti / 2 >= 0.6 OR bo = 2 THEN 'medium' ELSE 'low' END AS band FROM t""")
def paper_rank_bands(spark, sf_dir):
    """FLT06."""
    score, band = L.relevance("blue bolt")
    return papers(spark, sf_dir).select("paper_id", score.alias("relevance"), band.alias("band"))


@query(rf"""WITH {_PAPERS}, s AS (SELECT paper_id, citations, pos, regexp_matches(title, '(?i)(?:^|[^\w])widget\w*')::INT * 4.0 + regexp_matches(abstract, '(?i)(?:^|[^\w])widget\w*')::INT + regexp_matches(title, '(?i)(?:^|[^\w])widget(?:[^\w]|$)')::INT * 3 AS r,
  (coalesce(year, 0) <> 0)::INT + 1 + (abstract <> '')::INT + (doi IS NOT NULL)::INT + 1 AS c, regexp_matches(concat_ws(' ', title, abstract), '(?i)(?:^|[^\w])widget\w*') AS b, regexp_matches(title, '(?i)(?:^|[^\w])widget\w*') AS t FROM p)
SELECT paper_id FROM s ORDER BY r + CASE WHEN b AND NOT t THEN 0.5 ELSE 0 END DESC, c DESC, citations DESC NULLS LAST, pos LIMIT 25""")
def paper_top(spark, sf_dir):
    """TOP03, TOP04, FLT07: rank, then cut."""
    return L.ranked(papers(spark, sf_dir), "widget", 25).select("paper_id")


@query(f"""WITH {_PAPERS}, k AS (SELECT paper_id, pos, CASE WHEN doi IS NOT NULL THEN 'doi:' || replace(doi, 'https://doi.org/', '') ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || lower(authors[1]) || lower(authors[2]) END AS k FROM p)
SELECT min(paper_id) AS paper_id FROM k GROUP BY k""")
def paper_dedup_first(spark, sf_dir):
    """SET02."""
    return L.dedup_first(papers(spark, sf_dir)).select("paper_id")


@query(f"""WITH {_PAPERS}, a AS (SELECT paper_id, 1 AS part FROM p WHERE is_open UNION ALL SELECT paper_id, 2 FROM p WHERE citations >= 25)
SELECT paper_id, min(part) AS first_source, count(*) AS n_sources FROM a GROUP BY paper_id""")
def federated_union(spark, sf_dir):
    """SET01, SRC13: results of two sources, each tagged, and where each was first seen."""
    p = papers(spark, sf_dir)
    both = p.where("is_open").select("paper_id", F.lit(1).alias("part")).unionByName(p.where("citations >= 25").select("paper_id", F.lit(2).alias("part")))
    return both.groupBy("paper_id").agg(F.min("part").alias("first_source"), F.count(F.lit(1)).alias("n_sources"))


@query(f"""WITH {_PAPERS}, g AS (SELECT doi, pos, paper_id // 100 AS page FROM p WHERE doi IS NOT NULL), f AS (SELECT doi, min(page) AS page FROM g GROUP BY doi), n AS (SELECT page, count(*) AS fresh FROM f GROUP BY page),
a AS (SELECT DISTINCT page FROM g), j AS (SELECT a.page, coalesce(fresh, 0) AS fresh FROM a LEFT JOIN n USING (page)) SELECT page, fresh, sum(fresh) OVER (ORDER BY page)::BIGINT AS distinct_so_far FROM j WHERE page < coalesce((SELECT min(page) FROM j WHERE fresh = 0), 1000000000)""")
def progressive_pages(spark, sf_dir):
    """SET03: distinct records page by page until a page adds none."""
    g = papers(spark, sf_dir).where("doi IS NOT NULL").select("doi", F.expr("paper_id div 100").alias("page"))
    fresh = g.groupBy("doi").agg(F.min("page").alias("page")).groupBy("page").agg(F.count(F.lit(1)).alias("fresh"))
    pages = g.select("page").distinct().join(fresh, "page", "left").select("page", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    upto = W.orderBy("page")  # one row a page of results
    return pages.withColumn("ended", F.max(F.col("fresh") == 0).over(upto)).withColumn("distinct_so_far", F.sum("fresh").over(upto)).where("NOT ended").drop("ended")


@query(f"""WITH {_PAPERS} SELECT journal, arg_max(paper_id, (coalesce(citations, -1), -pos)) AS top_cited, arg_min(paper_id, (coalesce(citations, 1000000), pos)) AS bottom_cited FROM p GROUP BY journal""")
def candidate_choice(spark, sf_dir):
    """TOP05."""
    p = papers(spark, sf_dir).withColumn("group", F.col("journal"))
    top, low = (L.pick(p, b).select("journal", F.col("paper_id").alias(b)) for b in ("top_cited", "bottom_cited"))
    return top.join(low, "journal")


_NAMES = "VALUES ('Smith, John', 'J. Smith'), ('van der Berg, Anna', 'Anna van der Berg'), ('García, José', 'Jose Garcia'), ('Smith, John', 'Jane Smith'), ('Miller', 'Ann Miller'), ('Lee, K', 'Kim Lee Jr')"


@example("SELECT * FROM (VALUES ('Smith, John', 'J. Smith', true), ('van der Berg, Anna', 'Anna van der Berg', true), ('García, José', 'Jose Garcia', true), ('Smith, John', 'Jane Smith', false), ('Miller', 'Ann Miller', false), ('Lee, K', 'Kim Lee Jr', true)) AS t(a, b, same)")
def author_matches(spark, sf_dir):
    """FLT04: names against what a reader says."""
    return spark.sql(f"SELECT * FROM {_NAMES} AS t(a, b)").withColumn("same", L.same_person(F.col("a"), F.col("b")))


@query(f"""WITH {_PAPERS}, s AS (SELECT journal, count(*) AS pool, count(*) FILTER (lower(authors[1]) = 'zeta') AS found, count(*) FILTER (type IS NULL) AS down FROM p GROUP BY journal)
SELECT journal, CASE WHEN found > 0 THEN 'found' WHEN down > 0 THEN 'outage' WHEN pool = 0 THEN 'empty pool' ELSE 'filtered out' END AS reason FROM s""")
def author_diagnostic(spark, sf_dir):
    """FLT05."""
    s = papers(spark, sf_dir).groupBy("journal").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.lower(F.col("authors")[0]) == "zeta").alias("found"), F.count_if(F.isnull("type")).alias("down"))
    return s.select("journal", L.zero_reason(F.col("found"), F.col("pool"), F.col("down")).alias("reason"))


@example("SELECT 'a b c a' AS abstract")
def inverted_abstract(spark, sf_dir):
    """SCA11."""
    return spark.sql("SELECT map('b', array(1), 'a', array(0, 3), 'c', array(2)) AS m").select(L.abstract_of(F.col("m")).alias("abstract"))

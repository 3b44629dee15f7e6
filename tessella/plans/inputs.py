"""Readers and writers over rows that both engines build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.sources import records as R
from tessella.sources import sinks as K
from tessella.sources import texts as X
from tessella.operators.registry import strength
from tessella.plans.registry import example, query, table


@example("SELECT * FROM (VALUES (1, 'heading', 'Title'), (1, 'prose', 'One line and the next.'), (1, 'code', '```\nx = 1\n\ny = 2\n```'), (1, 'list', '- item'), (1, 'quote', '> said'), (1, 'table', '| a |')) AS t(id, kind, body)")
def paragraph_kinds(spark, sf_dir):
    """SRC01."""
    text = "# Title\n\nOne line\nand the next.\n\n```\nx = 1\n\ny = 2\n```\n\n- item\n\n> said\n\n| a |"
    return X.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("id", "kind", F.trim("body").alias("body"))


@example("SELECT '# Aim\n\nWe follow [lee2018] closely.' AS body")
def latex_prose(spark, sf_dir):
    """SRC03."""
    tex = "\\documentclass{a}\\begin{document}\\section{Aim} We \\emph{follow}~\\cite{lee2018} closely. % note\n\\begin{table}x\\end{table}\\end{document}"
    return spark.createDataFrame([(tex,)], "tex string").select(X.latex_text(F.col("tex")).alias("body"))


@example("SELECT * FROM (VALUES (1, 0, 0, '', 'intro', 1), (1, 1, 1, 'A', 'one two', 2), (1, 2, 2, 'B', '', 0)) AS t(id, pos, level, heading, body, n_words)")
def markdown_sections(spark, sf_dir):
    """SRC06."""
    return X.sections(spark.createDataFrame([(1, "intro\n# A\none two\n## B\n")], "doc_id int, text string"))


@example("SELECT * FROM (VALUES ('a', 3, 2, 3), ('c', 0, 1, 1)) AS t(path, line, cells, expected)")
def ragged_csv(spark, sf_dir):
    """SRC09."""
    return R.ragged_rows(spark.createDataFrame([("a", 'x,y,z\n1,"2,5",3\n4,5\n'), ("b", "p,q\n1,2\n"), ("c", "")], "path string, text string"))


@example("SELECT * FROM (VALUES ('article', 'lee2018', 'Tea and {S}leep', '2018'), ('book', 'kim', 'Coffee', '2020')) AS t(type, key, title, year)")
def bibtex_entries(spark, sf_dir):
    """SRC10."""
    text = '@comment{x}\n@Article{lee2018,\n  title = {Tea and {S}leep},\n  year = 2018,\n}\n@book{kim, title="Coffee", year="2020"}'
    b = R.bibtex(spark.createDataFrame([(text,)], "text string"))
    return b.select("type", "key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"))


@example("SELECT * FROM (VALUES (1, 1, '10.1000/abc', 2020, NULL), (1, 2, NULL, 2019, '12345')) AS t(doc, number, doi, year, pmid)")
def numbered_references(spark, sf_dir):
    """SRC11."""
    lines = spark.createDataFrame([(1, "1. Lee. Tea. 2020. doi:10.1000/abc."), (1, "[2] Kim. Coffee. 2019. PMID: 12345"), (1, "prose")], "doc int, line string")
    return R.reference_list(lines).select("doc", "number", "doi", "year", "pmid")


@example("SELECT * FROM (VALUES ('S1', 'recorded_estimate'), ('S2', 'prose_summary'), ('S3', 'metadata_only'), ('S4', 'none')) AS t(source_id, strength)")
def ledger_strength(spark, sf_dir):
    """SRC12."""
    names = ["effect_estimate", "n_participants", "follow_up", "main_finding", "key_outcomes", "population", "intervention", "comparator"]
    rows = [("S1", "HR 0.8", *[""] * 7), ("S2", "not_reported", "", "n/a", "better", *[""] * 4), ("S3", *[""] * 5, "adults", "", ""), ("S4", *[None] * 8)]
    return spark.createDataFrame(rows, "source_id string, " + ", ".join(f"{n} string" for n in names)).select("source_id", strength().alias("strength"))


@example("SELECT '7' AS pmid, 'A big title' AS title, 'AIM: a b' AS abstract, 2019 AS year, 'Lee;Group X' AS authors, '10.1000/own' AS doi")
def article_xml(spark, sf_dir):
    """SRC15, SRC16."""
    xml = '<PubmedArticle><PMID V="1">7</PMID><ArticleTitle>A <i>big</i> title</ArticleTitle><PubDate><MedlineDate>2019 Jan</MedlineDate></PubDate><Abstract><AbstractText Label="AIM">a b</AbstractText></Abstract><Author><LastName>Lee</LastName></Author><Author><CollectiveName>Group X</CollectiveName></Author><ReferenceList><ArticleId IdType="doi">10.1000/ref</ArticleId></ReferenceList><ArticleId IdType="doi">10.1000/OWN</ArticleId></PubmedArticle>'
    return R.articles(spark.createDataFrame([(xml,)], "xml string")).withColumn("authors", F.array_join("authors", ";"))


@example("SELECT 'Aim\n\nWe saw tea.' AS body")
def article_body(spark, sf_dir):
    """SRC17."""
    xml = "<article><body><sec><title>Aim</title><p>We saw <b>tea</b>.</p></sec></body><ref-list><ref>x</ref></ref-list></article>"
    return spark.createDataFrame([(xml,)], "xml string").select(F.regexp_replace(R.body_text(F.col("xml")), r" \.", ".").alias("body"))


@query("SELECT p_partkey::VARCHAR AS paper_id, p_name AS title, 1970 + p_size AS year, NULL::VARCHAR AS abstract, p_brand AS journal FROM part")
def standardized_records(spark, sf_dir):
    """SRC14."""
    raw = table(spark, sf_dir, "part").withColumn("y", 1970 + F.col("p_size"))
    return R.standardized(raw, {"paper_id": "p_partkey", "title": "p_name", "year": "y", "journal": "p_brand"}).select("paper_id", "title", "year", "abstract", "journal")


@example("SELECT * FROM (VALUES (1, 'https://example.org/a b'), (2, 'https://example.org/x')) AS t(id, url)")
def unwrapped_links(spark, sf_dir):
    """SRC19."""
    t = spark.createDataFrame([(1, "https://find.example/l?url=https%3A%2F%2Fexample.org%2Fa%20b&x=1"), (2, "https://example.org/x")], "id int, url string")
    return t.select("id", R.unwrap(F.col("url")).alias("url"))


@example("SELECT * FROM (VALUES ('10.1000/A', '10.1000/a', '1', 'PMC9'), ('pmc9', '10.1000/a', '1', 'PMC9'), ('77', NULL, NULL, NULL)) AS t(given, doi, pmid, pmcid)")
def id_crosswalk(spark, sf_dir):
    """SRC20."""
    return R.crosswalk(spark.createDataFrame([("10.1000/A",), ("pmc9",), ("77",)], "given string"), spark.createDataFrame([("10.1000/a", "1", "PMC9")], "doi string, pmid string, pmcid string"))


@example("SELECT 'S1' AS source_id, 'pdf' AS tier")
def evidence_acquisition(spark, sf_dir):
    """SRC18: the first tier whose text is of the cited work."""
    rows = [("S1", "api", "Tea", "Coffee in adults"), ("S1", "pdf", "Tea", "Tea and sleep"), ("S1", "cli", "Tea", "Tea again"), ("S2", "api", "Sugar", None)]
    return R.acquired(spark.createDataFrame(rows, "source_id string, tier string, title string, text string")).select("source_id", "tier")


@query("SELECT o_orderkey AS source_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS now_readable FROM orders WHERE o_orderstatus = 'P'")
def worklist_recheck(spark, sf_dir):
    """SNK03."""
    work = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source_id"))
    return K.recheck(work, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id")))


@query("SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation")
def markdown_rows(spark, sf_dir):
    """SNK07."""
    return table(spark, sf_dir, "nation").select(K.markdown_row(["n_name", "n_regionkey"]).alias("line"))

"""Scalar functions over rows that both engines build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import quantities as Q
from tessella.functions import text as T
from tessella.operators import checks as C
from tessella.operators.similarity import lcs_length
from tessella.plans.registry import example, query, table


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@example("SELECT * FROM (VALUES (1, '1,3,4,5'), (2, '12,13,14'), (3, '12,13,14'), (4, '')) AS t(id, numbers)")
def numeric_markers(spark, sf_dir):
    """SCA04: ranges by hyphen and by dash are expanded alike."""
    t = _rows(spark, [(1, "as shown [1,3-5]"), (2, "so [12-14]."), (3, "so [12–14]."), (4, "none [a]")], "id int, text string")
    return t.select("id", F.array_join(Q.numeric_markers(F.col("text")), ",").alias("numbers"))


@example("SELECT * FROM (VALUES (1, 'smith 2020;lee 2018b'), (2, '')) AS t(id, markers)")
def author_year_markers(spark, sf_dir):
    """SCA04."""
    t = _rows(spark, [(1, "It rose (Smith et al., 2020; Lee and Kim 2018b)."), (2, "It rose in 2020.")], "id int, text string")
    return t.select("id", F.array_join(Q.author_year_markers(F.col("text")), ";").alias("markers"))


@example("SELECT * FROM (VALUES (1, 'p_value:p < 0.05|measure:HR 0.80|confidence_interval:95% CI 0.70 to 0.91'), (2, 'percent:12.5%|fraction:5/40|year:2019'), (3, 'duration:3 weeks|number:7')) AS t(id, q)")
def quantities(spark, sf_dir):
    """SCA05."""
    t = _rows(spark, [(1, "HR 0.80 (95% CI 0.70 to 0.91), p < 0.05"), (2, "12.5% (5/40) in 2019"), (3, "7 of them after 3 weeks")], "id int, text string")
    return t.select("id", F.array_join(F.transform(Q.quantities(F.col("text")), lambda s: F.concat_ws(":", s["kind"], s["raw"])), "|").alias("q"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey = 0 THEN 'zero denominator' WHEN l_linenumber > l_suppkey THEN 'numerator above denominator' WHEN l_quantity * 3 > 100 THEN 'above 100 percent' WHEN abs(100 * l_linenumber / l_suppkey - l_quantity * 3) > 0.6 THEN 'percent differs' END AS issue FROM lineitem")
def fraction_checks(spark, sf_dir):
    """SCA07."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), C.fraction_ok(F.col("l_linenumber"), F.nullif("l_suppkey", F.lit(-1)), F.col("l_quantity") * 3).alias("issue"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount * 100 > l_tax * 200 THEN 'bounds inverted' WHEN l_quantity / 5 < l_discount * 100 OR l_quantity / 5 > l_tax * 200 THEN 'estimate outside' END AS issue FROM lineitem")
def interval_checks(spark, sf_dir):
    """SCA07."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), C.interval_ok(F.col("l_quantity") / 5, F.col("l_discount") * 100, F.col("l_tax") * 200).alias("issue"))


@example("SELECT * FROM (VALUES ('0.81', true), ('0.8', true), ('0.83', false), ('12', true)) AS t(token, traced)")
def number_traceability(spark, sf_dir):
    """SCA08."""
    t = _rows(spark, [("0.81",), ("0.8",), ("0.83",), ("12",)], "token string")
    return t.select("token", Q.traceable(F.col("token"), F.array(F.lit(0.8123), F.lit(11.7))).alias("traced"))


@example("SELECT * FROM (VALUES ('10.1000/abc', 'doi'), ('https://doi.org/10.1000/AbC', 'doi'), ('arXiv:2101.00001v2', 'arxiv'), ('PMC123', 'pmcid'), ('PMID: 12345', 'pmid'), ('A title', 'title')) AS t(value, kind)")
def identifier_kinds(spark, sf_dir):
    """SCA09."""
    t = _rows(spark, [(x,) for x in ("10.1000/abc", "https://doi.org/10.1000/AbC", "arXiv:2101.00001v2", "PMC123", "PMID: 12345", "A title")], "value string")
    return t.select("value", T.identifier_kind(F.col("value")).alias("kind"))


@query("SELECT p_partkey AS id, '10.1000/' || lower(p_brand) AS doi, trim(regexp_replace(lower(p_name || ': ' || p_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS title FROM part")
def doi_and_title_keys(spark, sf_dir):
    """SCA10."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.doi_key(F.concat(F.lit("https://doi.org/10.1000/"), "p_brand", F.lit("."))).alias("doi"), T.title_key(F.concat("p_name", F.lit(": "), "p_type", F.lit("!"))).alias("title"))


@example("SELECT * FROM (VALUES (1, '13,9', '12'), (2, '', '')) AS t(id, added, dropped)")
def revision_numbers(spark, sf_dir):
    """FLT11, SET04."""
    t = _rows(spark, [(1, "We saw 12 of 40.", "We saw 13 of 40 and 9."), (2, "None.", "Still none.")], "id int, before string, after string")
    more, less = C.added(F.col("before"), F.col("after"))
    return t.select("id", F.array_join(more, ",").alias("added"), F.array_join(less, ",").alias("dropped"))


@example("SELECT * FROM (VALUES (1, 'blank'), (2, 'no letters'), (3, NULL), (4, 'other script')) AS t(id, gap)")
def prose_gaps(spark, sf_dir):
    """FLT11."""
    t = _rows(spark, [(1, "## **"), (2, "12 34"), (3, "Plain prose."), (4, "a 漢字漢字")], "id int, text string")
    return t.select("id", C.prose_gap(F.col("text")).alias("gap"))


@query("SELECT conv_id, turn, NOT regexp_matches(trim(text), '[.!?:;][\"'')\\]]*$') AS open FROM conversations")
def unfinished_lines(spark, sf_dir):
    """WIN05."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.unfinished(F.col("text")).alias("open"))


@query("SELECT p_partkey AS id, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type), 1), 9) AS ratio FROM part")
def edit_similarity(spark, sf_dir):
    """SIM07."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(Q.similarity_ratio(F.lower("p_name"), F.lower("p_type")), 9).alias("ratio"))


@example("SELECT * FROM (VALUES (1, 2), (2, 0), (3, 3), (4, 0)) AS t(id, n)")
def frame_lcs(spark, sf_dir):
    """SIM06."""
    t = _rows(spark, [(1, ["a", "b", "c"], ["b", "x", "c"]), (2, ["a"], ["b"]), (3, ["the", "of", "in"], ["the", "of", "a", "in"]), (4, [], ["a"])], "id int, a array<string>, b array<string>")
    return t.select("id", lcs_length(F.col("a"), F.col("b")).alias("n"))


@example("""SELECT * FROM (VALUES (1, 0, 27, 'Dr. Lee saw 2.5% (p < 0.05)'), (2, 0, 9, 'One line.'), (2, 10, 20, 'Two lines?'), (2, 22, 27, 'Three')) AS t(id, start, "end", sentence)""")
def sentence_spans(spark, sf_dir):
    """SCA03."""
    t = _rows(spark, [(1, "Dr. Lee saw 2.5% (p < 0.05)"), (2, "One line. Two lines?\n\nThree")], "doc_id int, text string")
    return T.sentence_spans(t)


@query("SELECT doc_id AS id, 0 AS wrong FROM documents")
def sentence_spans_fit(spark, sf_dir):
    """SCA03: in no document is a sentence other than the text at its offsets."""
    d = table(spark, sf_dir, "documents")
    spans = T.sentence_spans(d).groupBy("id").agg(F.collect_list(F.struct("start", "sentence")).alias("s"))
    bad = F.size(F.filter("s", lambda x: F.substring(F.col("text"), x["start"] + 1, F.length(x["sentence"])) != x["sentence"]))
    return d.join(spans, d.doc_id == spans.id, "left").select(F.col("doc_id").alias("id"), F.coalesce(bad, F.lit(0)).alias("wrong"))


@example("SELECT * FROM (VALUES (1, 'We did it to learn, because it rained.'), (2, 'in order to')) AS t(id, text)")
def plainer_wording(spark, sf_dir):
    """FLT13."""
    t = _rows(spark, [(1, "We did it in order to learn, due to the fact that it rained.", False), (2, "in order to", True)], "id int, text string, flagged boolean")
    return t.select("id", T.plainer(F.col("text"), F.col("flagged")).alias("text"))


@example("SELECT 'a tool' AS name, 'x: y' AS what")
def front_matter(spark, sf_dir):
    """FLT15."""
    t = _rows(spark, [("---\nname: a tool\nwhat: x: y\n---\nbody",)], "text string").select(T.front_matter(F.col("text")).alias("m"))
    return t.select(F.col("m")["name"].alias("name"), F.col("m")["what"].alias("what"))


@example("SELECT * FROM (VALUES ('sleep study of teas', 'sleep;teas', '\"sleep study of teas\" | sleep AND teas | (sleep OR sleeps) AND (teas OR tea) | sleep study of teas')) AS t(query, terms, ladder)")
def query_ladder(spark, sf_dir):
    """SCA12, SCA13."""
    from tessella.operators.literature import ladder

    q = "sleep study of teas"
    return _rows(spark, [(q, ";".join(T.query_terms(q)), " | ".join(ladder(q)))], "query string, terms string, ladder string")

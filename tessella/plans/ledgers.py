"""Ledgers, counts and reports, over rows that both engines build and over the tables of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import ledgers as L
from tessella.plans.registry import example, query, table


def _rows(spark, values, names):
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


@example("SELECT id, rule, expected::BIGINT AS expected, found::BIGINT AS found FROM (VALUES (2, 'screened', 90, 95), (2, 'included', 30, 31), (3, 'reasons', 10, 9)) AS t(id, rule, expected, found)")
def count_reconciliation(spark, sf_dir):
    """AGG09."""
    flow = _rows(spark, "(1, 100, 10, 90, 40, 50, 5, 45, 15, 15, 30), (2, 100, 10, 95, 45, 50, 5, 45, 15, 15, 31), (3, 60, 0, 60, 20, 40, 0, 40, 10, 9, 30), (4, NULL, 3, 5, 1, 4, 0, 4, 1, 1, 3)", "id, identified, removed, screened, excluded, sought, not_retrieved, assessed, reports_excluded, reasons_total, included")
    return L.reconcile(flow)


@query("""SELECT o_custkey AS id, 'included' AS rule, count(*) - count(*) FILTER (o_orderstatus = 'F') AS expected, count(*) FILTER (o_orderstatus = 'O') AS found FROM orders GROUP BY o_custkey HAVING count(*) - count(*) FILTER (o_orderstatus = 'F') <> count(*) FILTER (o_orderstatus = 'O')""")
def order_flow_reconciliation(spark, sf_dir):
    """AGG09 at scale: orders that are neither finished nor open break their customer's count."""
    s = F.col("o_orderstatus")
    flow = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("assessed"), F.count_if(s == "F").alias("reports_excluded"), F.count_if(s == "O").alias("included"))
    return L.reconcile(flow.select("*", *(F.lit(None).cast("long").alias(x) for x in ("identified", "removed", "screened", "excluded", "sought", "not_retrieved", "reasons_total")))).select("id", "rule", "expected", "found")


_LEDGER = """('S001', 1, 'Effects of tea on human sleep', '2020', '10.1000/a', '11', 'verified', '2024-01-01', 'included', '', 'clear'), ('X2', 2, '', '20x0', 'no doi', '', 'maybe', '', 'excluded', '', 'clear'),
 ('S003', 3, 'Effects of tea on human sleep!', '2020', 'doi:10.1000/A', '', 'verified', '', 'included', 'language', 'retracted'), ('S004', 4, 'Tobacco', '2019', '', '', 'unverified', '', 'pending', '', 'clear')"""
_NAMES = "source_id, pos, title, year, doi, pmid, verification_status, verified_date, inclusion_status, exclusion_reason, retraction_status"


@example("""SELECT * FROM (VALUES ('X2', 'bad_source_id', 'error'), ('X2', 'missing_title', 'error'), ('X2', 'bad_year', 'error'), ('X2', 'bad_doi', 'error'), ('X2', 'unknown_status', 'error'), ('X2', 'excluded_without_reason', 'error'),
('S003', 'verified_without_date', 'error'), ('S003', 'included_with_reason', 'warning'), ('S003', 'included_retracted', 'error'), ('S004', 'no_identifier', 'warning')) AS t(source_id, issue, severity)""")
def ledger_row_issues(spark, sf_dir):
    """RUL02, SCA16."""
    return L.row_issues(_rows(spark, _LEDGER, _NAMES))


@example("SELECT * FROM (VALUES ('S003', 'doi', 'S001'), ('S003', 'title', 'S001')) AS t(source_id, kind, first)")
def ledger_duplicates(spark, sf_dir):
    """AGG07, SCA10."""
    return L.duplicates(_rows(spark, _LEDGER, _NAMES))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def ledger_tallies(spark, sf_dir):
    """AGG07, AGG10."""
    return L.tallies(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT c_mktsegment AS theme, count(*) AS n_sources, sum(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 END)::BIGINT AS participants, arg_max(certainty, o) AS best, count(DISTINCT c_nationkey % 3) AS directions
FROM (SELECT *, ['very low', 'low', 'moderate', 'high'][c_nationkey % 4 + 1] AS certainty, c_nationkey % 4 AS o FROM customer) GROUP BY 1""")
def grouped_evidence(spark, sf_dir):
    """AGG08."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    certainty = F.when(n % 4 == 3, "high").when(n % 4 == 2, "moderate").when(n % 4 == 1, "low").otherwise("very low")
    participants = F.when(k % 3 == 0, "unclear").otherwise((k % 100).cast("string"))
    return L.evidence_table(c.select(F.col("c_mktsegment").alias("theme"), participants.alias("participants"), certainty.alias("certainty"), (n % 3).alias("direction")), "theme")


@example("SELECT * FROM (VALUES (2, 11, 12), (3, 30, 12)) AS t(id, said, held)")
def claimed_counts(spark, sf_dir):
    """AGG11."""
    text = _rows(spark, "(1, 'We found twelve studies of tea.'), (2, 'Eleven studies were kept.'), (3, 'In all 30 studies'), (4, 'Many studies')", "id, text")
    held = _rows(spark, "(1, 12), (2, 12), (3, 12), (4, 12)", "id, held")
    return L.claimed_counts(text, held, "studies")


@query("SELECT l_orderkey AS claim_id, f AS first, l_quantity AS other FROM (SELECT DISTINCT l_orderkey, l_quantity, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS f FROM lineitem) WHERE l_quantity <> f")
def claim_drift(spark, sf_dir):
    """AGG12: line items stand for the values recorded for an order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_quantity").alias("value"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("pos"))
    return L.drift(li)


@query("SELECT l_suppkey AS author, year(l_shipdate)::INT AS year, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'INCONSISTENT' ELSE 'REPEATED' END AS status FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_citations(spark, sf_dir):
    """AGG12."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("form"))
    return L.repeated_citations(li)


@query("WITH f AS (SELECT l_orderkey AS doc, l_suppkey AS source_id, min(l_linenumber * 1000000 + l_partkey) AS p FROM lineitem GROUP BY ALL) SELECT doc, source_id, row_number() OVER (PARTITION BY doc ORDER BY p, source_id)::INT AS number FROM f")
def number_by_appearance(spark, sf_dir):
    """WIN04."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("source_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    return L.number_by_appearance(li.withColumn("pos", F.struct("pos", "source_id")))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS number, min(l_partkey) AS p FROM lineitem GROUP BY ALL), o AS (SELECT doc, number, coalesce(lag(number) OVER (PARTITION BY doc ORDER BY p, number), 0) AS b FROM f) SELECT doc, number FROM o WHERE number <> b + 1""")
def appearance_breaks(spark, sf_dir):
    """WIN04."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number"), F.struct("l_partkey", "l_linenumber").alias("pos"))
    return L.appearance_breaks(li)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem), r AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM a), s AS (SELECT doc, min(n) AS lo, max(n) AS hi FROM r GROUP BY doc, g)
SELECT doc, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM s GROUP BY doc""")
def compressed_numbers(spark, sf_dir):
    """WIN04."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    return li.select("doc", L.compressed(F.col("n")).alias("ranges"))


@example("SELECT 1 AS doc, 4 AS first_pos, 6::BIGINT AS n")
def reference_list_runs(spark, sf_dir):
    """WIN01."""
    lines = _rows(spark, "(1, 1, '1. A heading'), (1, 2, 'prose'), (1, 3, 'References'), (1, 4, '1. Smith'), (1, 5, '2. Lee'), (1, 6, '[3] Kim'), (1, 7, '4. Diaz'), (1, 8, '5. Chen'), (1, 9, '6. Roy'), (2, 1, '1. One'), (2, 2, '2. Two')", "doc, pos, line")
    return L.reference_runs(lines)


@query("SELECT o_custkey AS review, bool_or(o_clerk = 'a') AS needed FROM (SELECT o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'a' ELSE 'h' END AS o_clerk FROM orders) GROUP BY 1")
def screening_disclosure(spark, sf_dir):
    """FLT14."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review"), F.when(F.col("o_orderpriority").startswith("1"), "LLM screener").otherwise("J. Smith").alias("verifier"))
    return L.screening_disclosure(log)


@example("SELECT * FROM (VALUES (1, 'CRP', 2::BIGINT)) AS t(id, term, n)")
def undefined_abbreviations(spark, sf_dir):
    """FLT17."""
    return L.undefined_abbreviations(_rows(spark, "(1, 'CRP rose. The body mass index (BMI) and BMI fell, as CRP did; WHO says.')", "id, text"))


@example("SELECT * FROM (VALUES (1, 'Table 2', 'no caption'), (1, 'Figure 1', 'not referred to')) AS t(id, display, side)")
def display_references(spark, sf_dir):
    """FLT17."""
    return L.display_references(spark.createDataFrame([(1, "See Table 1 and Table 2.\nTable 1. Results\nFigure 1: Flow")], "id int, text string"))


@example("SELECT 2 AS clause_id, 0.25::DOUBLE AS best")
def clause_losses(spark, sf_dir):
    """JOIN10."""
    before = _rows(spark, "(1, 'never invent a source'), (2, 'always report open gaps')", "clause_id, text")
    return L.clause_losses(before, _rows(spark, "(8, 'Never invent any source or value'), (9, 'report')", "clause_id, text"))


@query("SELECT doc_id, substr(sha1(text), 1, 12) AS clause FROM documents")
def clause_keys(spark, sf_dir):
    """SCA17."""
    return table(spark, sf_dir, "documents").select("doc_id", L.clause_key(F.col("text")).alias("clause"))


@query("""SELECT s_suppkey AS work_id, b || CASE WHEN k = 1 THEN '' ELSE chr((95 + k)::INT) END AS cite_key FROM (SELECT s_suppkey, 'author' || (1990 + s_nationkey) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)""")
def cite_keys(spark, sf_dir):
    """SCA14."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("work_id"), F.lit("Author, A").alias("author"), (1990 + F.col("s_nationkey")).alias("year"))
    return L.cite_keys(s)


@query("""SELECT p_partkey AS id, p_brand || ' (' || (1970 + p_size) || '). ' || p_name || '. ' || p_type || ', 1, 2-3.' AS apa, p_brand || '. ' || p_name || '. ' || p_type || '. ' || (1970 + p_size) || ';1:2-3.' AS vancouver FROM part""")
def formatted_references(spark, sf_dir):
    """SNK05."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("author"), (1970 + F.col("p_size")).alias("year"), F.col("p_name").alias("title"), F.col("p_type").alias("journal"), F.lit("1").alias("volume"), F.lit("2-3").alias("pages"), F.lit("").alias("doi"))
    return p.select("id", L.formatted("apa").alias("apa"), L.formatted("vancouver").alias("vancouver"))


@example("SELECT * FROM (VALUES (1, 'too few'), (2, 'low'), (3, 'ok'), (4, 'ok, high base rate'), (5, 'not estimable')) AS t(id, gate)")
def kappa_gate(spark, sf_dir):
    """AGG17."""
    t = _rows(spark, "(1, 20, 0.9D, 0.5D), (2, 80, 0.4D, 0.5D), (3, 80, 0.7D, 0.5D), (4, 80, 0.7D, 0.9D), (5, 80, CAST(NULL AS DOUBLE), 1.0D)", "id, n, kappa, pe")
    return t.select("id", L.kappa_gate(F.col("n"), F.col("kappa"), F.col("pe")).alias("gate"))


@query("SELECT p_partkey AS record_id, 'red' AS flag FROM part WHERE regexp_matches(p_name || ' ' || p_type, 'red') UNION ALL SELECT p_partkey, 'economy' FROM part WHERE regexp_matches(p_name || ' ' || p_type, 'ECONOMY')")
def eligibility_flags(spark, sf_dir):
    """RUL03."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"))
    return L.eligibility(p, {"red": "red", "economy": "ECONOMY"})


_LEAKED = "coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN ' see [src:S1] and {{name}}' WHEN 1 THEN ' TODO: tea, todo' WHEN 2 THEN ' TBD by FIXME }' ELSE '' END"


@query(f"WITH d AS (SELECT doc_id AS id, {_LEAKED} AS text FROM documents) SELECT id, unnest(list_filter({L.LEAKS}, lambda m: position(m IN text) > 0)) AS marker FROM d")
def document_template_leaks(spark, sf_dir):
    """RUL03: what is left of templates."""
    k = F.col("doc_id") % 7
    more = F.when(k == 0, " see [src:S1] and {{name}}").when(k == 1, " TODO: tea, todo").when(k == 2, " TBD by FIXME }").otherwise("")
    return L.template_leaks(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text")))


@query(f"""WITH m AS (SELECT o_orderkey AS review, CASE o_custkey % 4 WHEN 0 THEN 'We used RoB 2 and AMSTAR 2.' WHEN 1 THEN 'Judged by ROBINS-I' WHEN 2 THEN 'No tool.' END AS text FROM orders),
t AS (SELECT review, list_sort(list_filter({L.TOOLS}, lambda x: contains(lower(text), x))) AS tools FROM m WHERE text IS NOT NULL), n AS (SELECT * FROM t WHERE len(tools) > 0),
r AS (SELECT l_orderkey AS review, l_linenumber AS source_id, CASE l_suppkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Not scored, in concept low' WHEN 2 THEN 'Some Concerns' WHEN 3 THEN 'good' END AS overall FROM lineitem WHERE l_linenumber > 1),
b AS (SELECT review, source_id::VARCHAR AS source_id, list_filter({L.STAND_INS}, lambda x: contains(blob, x)) AS p, list_filter({L.JUDGEMENTS}, lambda x: contains(blob, x)) AS j FROM (SELECT review, source_id, lower(concat_ws(' ', source_id, overall)) AS blob FROM r))
SELECT review, source_id, CASE WHEN len(p) > 0 THEN 'placeholder' ELSE 'no judgement' END AS issue, coalesce(p[1], '') AS detail FROM b WHERE (len(p) > 0 OR len(j) = 0) AND review IN (SELECT review FROM n)
UNION ALL SELECT review, NULL, 'no appraisal', array_to_string(tools, ', ') FROM n WHERE review NOT IN (SELECT review FROM r)""")
def order_appraisals(spark, sf_dir):
    """RUL03: reviews are orders, appraisals their later lines."""
    k, j = F.col("o_custkey") % 4, F.col("l_suppkey") % 5
    methods = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review"), F.when(k == 0, "We used RoB 2 and AMSTAR 2.").when(k == 1, "Judged by ROBINS-I").when(k == 2, "No tool.").alias("text"))
    overall = F.when(j == 0, "Low").when(j == 1, "Not scored, in concept low").when(j == 2, "Some Concerns").when(j == 3, "good")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("source_id"), overall.alias("overall"))
    return L.appraisal_issues(methods, rows)


@example("SELECT * FROM (VALUES (1, 'S9', 'unknown'), (1, 'S2', 'retracted'), (2, 'S3', 'excluded'), (2, 'S4', 'unverified'), (3, '', 'number without a marker')) AS t(pos, token, issue)")
def draft_audit(spark, sf_dir):
    """RUL04."""
    lines = _rows(spark, "(1, 'Tea helps [src:S1][src:S9] and [src:S2].'), (2, 'So it is [src:S3], [src:S4].'), (3, 'It fell by 12%.'), (4, 'No more.')", "pos, text")
    sources = _rows(spark, "('S1', 'verified', 'included', 'clear'), ('S2', 'verified', 'included', 'retracted'), ('S3', 'verified', 'excluded', 'clear'), ('S4', 'unverified', 'included', 'clear')", "source_id, status, inclusion, retraction")
    return L.draft_audit(lines, sources)


@query("""WITH r AS (SELECT doc_id, quality = 1 AS good, 1.0 / (1 + n_chars) AS short, n_chars / 100000.0 AS long FROM labels JOIN documents USING (doc_id)), m AS (SELECT 'short' AS measure, good, short AS v FROM r UNION ALL SELECT 'long', good, long FROM r)
SELECT measure, count(*) AS n, round(avg(v) FILTER (good), 9)::DOUBLE AS mean_good, round(avg(v) FILTER (NOT good), 9)::DOUBLE AS mean_bad FROM m GROUP BY measure""")
def measure_evaluation(spark, sf_dir):
    """UDF02: measures are named columns, evaluated over labelled items in one pass."""
    measures = {"short": 1.0 / (1 + F.col("n_chars")), "long": F.col("n_chars") / 100000.0}
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("good", F.col("quality") == 1)
    rows = r.select("good", F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()))).alias("m")).select("good", "m.*")
    return rows.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("good"), F.col("v"))), 9).alias("mean_good"), F.round(F.avg(F.when(~F.col("good"), F.col("v"))), 9).alias("mean_bad"))

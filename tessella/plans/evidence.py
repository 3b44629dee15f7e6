"""Citations, evidence and verdicts over small ledgers that both engines build from the same rows, and over the tables of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import registry as R
from tessella.plans.registry import example, query, table

#: Rows that Spark and DuckDB both read.
_SOURCES = """(VALUES ('S001', 1, '1', 'smith2020', 'https://doi.org/10.1000/abc.', '111', 2020, 'clear', true, true, true), ('S002', 2, '2', 'lee2018', '10.1000/xyz', '222', 2018, 'retracted', true, true, true),
 ('S003', 3, '3', 'diaz2019', CAST(NULL AS STRING), '333', 2019, 'retracted', false, true, false), ('S004', 4, '4', 'chen2018', '10.1000/def', CAST(NULL AS STRING), 2018, 'clear', true, false, true), ('S005', 5, '4', 'kim2021', '10.1000/abc', '555', 2021, 'clear', false, true, true))
 AS s(source_id, pos, number, citekey, doi, pmid, year, retraction, linked, held, red)"""
_MARKERS = """(VALUES (1, '1'), (2, 'LEE2018'), (3, 's003'), (4, 'doi:10.1000/abc'), (5, '4'), (6, '9'), (7, 'author_year:Diaz 2019'), (8, 'author_year:Lee 2018'), (1, '222'), (9, 'kim2021'), (10, '1'), (11, '4'), (12, '1')) AS m(sentence_id, token)"""
_QUANTITIES = """(VALUES (1, 1, 'i80'), (1, 1, 'i95'), (4, 1, 'i12'), (9, 1, 'i7'), (10, 1, 'i80'), (12, 1, 'i44')) AS q(sentence_id, quantity_id, value_key)"""
_EVIDENCE = """(VALUES ('S001', 'i80'), ('S001', 'i95'), ('S001', 'i12'), ('S005', 'i7'), ('S002', 'i80')) AS e(source_id, value_key)"""
_MEASURED = """(VALUES (1, 'HR', 0.80), (4, 'HR', 0.85), (9, 'OR', 1.2), (10, 'HR', 0.8000000001)) AS m(sentence_id, measure, value)"""
_VALUES = """(VALUES ('S001', 'HR', 0.80, 1), ('S001', 'HR', 0.85, 2), ('S005', 'OR', 1.5, 1)) AS v(source_id, measure, value, evidence_pos)"""


def _duck(x: str) -> str:
    return x.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")


def _rows(spark, values):
    return spark.sql(f"SELECT * FROM {values}")


_RESOLVED_SQL = f"""WITH s AS (SELECT * FROM {_duck(_SOURCES)}), m AS (SELECT * FROM {_MARKERS}),
k AS (SELECT kind, key, arg_min(source_id, pos) AS source_id FROM (SELECT 0 AS kind, number AS key, source_id, pos FROM s UNION ALL SELECT 1, lower(citekey), source_id, pos FROM s UNION ALL SELECT 2, upper(source_id), source_id, pos FROM s
  UNION ALL SELECT 3, regexp_replace(regexp_replace(lower(doi), '^https?://doi.org/', ''), '[.]$', ''), source_id, pos FROM s UNION ALL SELECT 4, pmid, source_id, pos FROM s) WHERE key IS NOT NULL GROUP BY kind, key),
a AS (SELECT sentence_id, token, 0 AS kind, token AS key FROM m UNION ALL SELECT sentence_id, token, 1, lower(token) FROM m UNION ALL SELECT sentence_id, token, 2, upper(token) FROM m UNION ALL SELECT sentence_id, token, 3, replace(lower(token), 'doi:', '') FROM m UNION ALL SELECT sentence_id, token, 4, token FROM m),
f AS (SELECT sentence_id, token, arg_min(source_id, kind) AS source_id FROM a JOIN k USING (kind, key) GROUP BY ALL),
y AS (SELECT year, min(source_id) AS source_id FROM s GROUP BY year HAVING count(*) = 1),
resolved AS (SELECT m.sentence_id, m.token, coalesce(f.source_id, y.source_id) AS source_id FROM m LEFT JOIN f USING (sentence_id, token) LEFT JOIN y ON m.token LIKE 'author_year:%' AND y.year = try_cast(right(m.token, 4) AS INT))"""


def _resolved(spark):
    return R.resolve(_rows(spark, _MARKERS), _rows(spark, _SOURCES))


def _cited(spark):
    return _resolved(spark).where("source_id IS NOT NULL").select("sentence_id", "source_id").distinct()


@example(_RESOLVED_SQL + " SELECT * FROM resolved")
def citation_resolution(spark, sf_dir):
    """JOIN01."""
    return _resolved(spark)


_MISSING_SQL = (
    _RESOLVED_SQL
    + f""", c AS (SELECT DISTINCT sentence_id, source_id FROM resolved WHERE source_id IS NOT NULL), q AS (SELECT * FROM {_QUANTITIES}), e AS (SELECT * FROM {_EVIDENCE}),
missing AS (SELECT sentence_id, quantity_id FROM (SELECT DISTINCT sentence_id, quantity_id FROM q) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sentence_id = x.sentence_id AND NOT EXISTS (
  SELECT 1 FROM q WHERE q.sentence_id = x.sentence_id AND q.quantity_id = x.quantity_id AND NOT EXISTS (SELECT 1 FROM e WHERE e.source_id = c.source_id AND e.value_key = q.value_key))))"""
)


@example(_MISSING_SQL + " SELECT * FROM missing")
def numeric_containment(spark, sf_dir):
    """JOIN02."""
    return R.missing_quantities(_rows(spark, _QUANTITIES), _cited(spark), _rows(spark, _EVIDENCE))


def _contradicted_sql(having: str) -> str:
    return (
        _RESOLVED_SQL
        + f""", c AS (SELECT DISTINCT sentence_id, source_id FROM resolved WHERE source_id IS NOT NULL), j AS (SELECT m.sentence_id, m.measure, m.value, c.source_id, v.value AS ev, v.evidence_pos, abs(m.value - v.value) > 1e-6 * greatest(1.0, abs(v.value)) AS differs
  FROM (SELECT * FROM {_MEASURED}) m JOIN c USING (sentence_id) JOIN (SELECT * FROM {_VALUES}) v USING (source_id, measure)),
contradicted AS (SELECT sentence_id, measure, value::DOUBLE AS value, source_id, (arg_min(ev, evidence_pos) FILTER (differs))::DOUBLE AS evidence_value FROM j GROUP BY sentence_id, measure, value, source_id HAVING {having})"""
    )


def _contradicted(spark, mode):
    measured, values = (_rows(spark, x).withColumn("value", F.col("value").cast("double")) for x in (_MEASURED, _VALUES))
    return R.contradictions(measured, _cited(spark), values, mode)


@example(_contradicted_sql("bool_and(differs)") + " SELECT * FROM contradicted")
def contradictions(spark, sf_dir):
    """JOIN03: no value of the source is equal."""
    return _contradicted(spark, "none_equal")


@example(_contradicted_sql("bool_or(differs)") + " SELECT * FROM contradicted")
def contradictions_any(spark, sf_dir):
    """JOIN03: some value of the source differs."""
    return _contradicted(spark, "any_differs")


#: Facts of sentences, one for each rung.
_FACTS = """(VALUES
 (1, 0, 0, 0, 0, 0, 0, true, 0, 0, CAST(NULL AS STRING), 0, 0, 0), (2, 0, 0, 2, 0, 0, 0, true, 0, 0, CAST(NULL AS STRING), 0, 1, 1), (3, 1, 1, 0, 0, 1, 0, true, 0, 0, CAST(NULL AS STRING), 0, 0, 0), (4, 1, 1, 1, 0, 1, 0, false, 0, 0, CAST(NULL AS STRING), 0, 0, 0),
 (5, 2, 2, 1, 1, 1, 0, true, 0, 0, CAST(NULL AS STRING), 1, 1, 0), (6, 1, 1, 1, 1, 0, 0, true, 1, 1, CAST(NULL AS STRING), 1, 1, 0), (7, 1, 1, 1, 1, 0, 0, true, 1, 0, 'defensible', 1, 1, 0), (8, 1, 1, 1, 1, 0, 0, true, 0, 0, 'defensible', 1, 1, 1),
 (9, 1, 1, 1, 1, 0, 0, true, 0, 0, 'unlinked', 1, 1, 1), (10, 1, 1, 1, 1, 0, 0, true, 0, 0, 'transcribed', 1, 1, 1), (11, 1, 1, 1, 1, 0, 0, true, 0, 0, 'prose', 1, 1, 1), (12, 1, 1, 1, 1, 0, 0, true, 0, 0, CAST(NULL AS STRING), 0, 1, 1),
 (13, 1, 1, 1, 1, 0, 0, true, 0, 0, CAST(NULL AS STRING), 1, 2, 0), (14, 1, 1, 0, 1, 0, 0, true, 0, 0, CAST(NULL AS STRING), 1, 0, 0), (15, 1, 1, 1, 1, 0, 0, true, 0, 0, CAST(NULL AS STRING), 1, 2, 1), (16, 1, 1, 0, 0, 0, 1, true, 0, 0, CAST(NULL AS STRING), 0, 0, 0))
 AS f(sentence_id, n_markers, n_citing, n_triggers, n_resolved, n_stray, n_author_year, closed, n_retracted, n_retracted_unverified, contradiction, n_graded, n_checkable, n_missing)"""
_VERDICTS_SQL = """(VALUES (1, 'no_citation_needed', 'D01'), (2, 'unattributed', 'D02'), (3, 'unattributed', 'D03'), (4, 'unverifiable', 'D06'), (5, 'unattributed', 'D03'), (6, 'unverifiable', 'D11'), (7, 'conflict', 'D04'), (8, 'conflict', 'D08'),
 (9, 'unverifiable', 'D11'), (10, 'unverifiable', 'D13'), (11, 'unverifiable', 'D12'), (12, 'unverifiable', 'D05'), (13, 'attributed', 'D09'), (14, 'synthesis', 'D10'), (15, 'unverifiable', 'D07'), (16, 'unattributed', 'D03')) AS v(sentence_id, state, rule)"""


def _verdicts(spark):
    state, rule = R.ladder()
    return _rows(spark, _FACTS).select("sentence_id", state.alias("state"), rule.alias("rule"))


@example(f"SELECT * FROM {_VERDICTS_SQL}")
def verdict_ladder(spark, sf_dir):
    """RUL01, UDF03: one sentence for each way through the ladder, against the verdicts as they should be."""
    return _verdicts(spark)


@example(f"SELECT 16::BIGINT AS total, 15::BIGINT AS claiming, count(*) FILTER (state IN ('attributed', 'synthesis')) AS supported, round(2 / 15, 4) AS coverage, round(200 / 15, 1) AS percent FROM {_VERDICTS_SQL}")
def coverage_rollup(spark, sf_dir):
    """AGG01."""
    return R.coverage(_verdicts(spark))


@example("SELECT 'unknown_rule' AS issue, 1::BIGINT AS n")
def cross_foot(spark, sf_dir):
    """AGG02: a rule that isn't known is told."""
    return R.cross_foot(_verdicts(spark), [f"D{i:02d}" for i in range(1, 14) if i != 9])


@query("""SELECT o_custkey AS source_id, count(*) AS n_sentences, count(*) FILTER (o_totalprice > 1000) AS n_needing, count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F') AS n_held,
  CASE WHEN count(*) FILTER (o_totalprice > 1000) > 0 THEN greatest(1, round(count(*) FILTER (o_totalprice > 1000) * 0.4)::BIGINT) ELSE 0 END AS required,
  CASE WHEN count(*) FILTER (o_totalprice > 1000) = 0 THEN 'not_needed' WHEN count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F') >= greatest(1, round(count(*) FILTER (o_totalprice > 1000) * 0.4)::BIGINT) THEN 'sufficient' ELSE 'insufficient_evidence' END AS status FROM orders GROUP BY o_custkey""")
def evidence_sufficiency(spark, sf_dir):
    """AGG03: customers stand for sources, their orders for the sentences that cite them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("sentence_id"), (F.col("o_totalprice") > 1000).alias("needs"), (F.col("o_orderstatus") == "F").alias("held"))
    return R.sufficiency(o, "share", 0.4)


_CLAIMS = """(VALUES ('C001', 'verified', 'S001;S002'), ('C002', 'draft', 'S009'), ('C003', 'verified', 'S003;S004')) AS c(claim_id, status, ids)"""
_LEDGER = """(VALUES ('S001', 'verified', 'included', 'clear', true), ('S002', 'verified', 'included', 'retracted', true), ('S003', 'unverified', 'excluded', 'clear', false), ('S004', 'verified', 'included', 'clear', false)) AS s(source_id, status, inclusion, retraction, held)"""


@example("""SELECT * FROM (VALUES ('C001', 'S002', 'source_retracted'), ('C002', 'S009', 'unknown_source'), ('C003', 'S003', 'source_not_verified'), ('C003', 'S003', 'source_not_included'), ('C003', 'S003', 'verified_claim_on_unverified_source'), ('C003', 'S003', 'gap_no_text'), ('C003', 'S004', 'gap_no_text')) AS t(claim_id, source_id, issue)""")
def fk_audit(spark, sf_dir):
    """JOIN05, SET06: claims against sources."""
    claims = _rows(spark, _CLAIMS).select("claim_id", "status", F.split("ids", ";").alias("source_ids"))
    return R.claim_audit(claims, _rows(spark, _LEDGER))


@query("SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def unused_sources(spark, sf_dir):
    """JOIN06, SET04: customers without orders, orders without customers."""
    return R.two_way_difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


_PAIRS = """(VALUES (1, '10.1000/aB', 'Effects of tea on sleep', 2020, '12', '33-40', 'Smith, J', '10.1000/ab', 'Effects of tea on sleep.', 2020, '12', '33', 'smith'), (2, '10.1000/c', 'Coffee', 2019, '3', 'e12', 'Lee, K', '10.1000/d', 'Tobacco and its harms', 2018, '3', 'e13', 'Kim'),
 (3, '10.1000/e', 'Sugar', 2001, '1', '1', 'Diaz', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING))) AS p(id, doi, title, year, volume, pages, author, doi2, title2, year2, volume2, pages2, author2)"""


@example("SELECT * FROM (VALUES (1, ''), (2, 'doi,title,year,pages,author'), (3, 'unchecked,pages')) AS t(id, issues)")
def record_comparison(spark, sf_dir):
    """JOIN07, JOIN08."""
    names = ("doi", "title", "year", "volume", "pages", "author")
    p = _rows(spark, _PAIRS).select("id", F.struct(*names).alias("a"), F.struct(*(F.col(f"{n}2").alias(n) for n in names)).alias("b"))
    return p.select("id", F.array_join(R.compare_record(F.col("a"), F.col("b")), ",").alias("issues"))


@example("SELECT * FROM (VALUES (1, true, 'ok'), (2, false, 'partial'), (3, false, 'unreachable'), (4, true, 'partial')) AS t(id, is_retracted, status)")
def retraction_signals(spark, sf_dir):
    """JOIN13, JOIN14."""
    rows = spark.sql("SELECT * FROM VALUES (1, true, false, false), (2, false, null, false), (3, null, null, null), (4, null, true, null) AS t(id, a, b, c)").select("id", *(F.col(x).cast("boolean").alias(x) for x in "abc"))
    hit, status = R.retraction([F.col(x) for x in "abc"])
    return rows.select("id", hit.alias("is_retracted"), status.alias("status"))


@query("SELECT conv_id AS doc_id, turn AS pos, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def conversation_section(spark, sf_dir):
    """JOIN11: the user's turns are headings, each turn belongs to the last of them."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role", "text")
    return R.section_of(c, c.where("role = 'user'").select("doc_id", "pos", F.col("text").alias("heading")))


@example("SELECT * FROM (VALUES ('S001_smith.pdf', 'S001'), ('lee2018-final.PDF', 'S002'), ('effects of tea on sleep in adults a trial.pdf', 'S003')) AS t(file, source_id)")
def file_matches(spark, sf_dir):
    """JOIN12."""
    files = spark.sql("SELECT * FROM VALUES ('S001_smith.pdf'), ('lee2018-final.PDF'), ('effects of tea on sleep in adults a trial.pdf'), ('other.pdf') AS t(file)")
    sources = spark.sql("SELECT * FROM VALUES ('S001', 'smith2020', 'Coffee and its many effects on work'), ('S002', 'lee2018', 'Short'), ('S003', 'diaz2019', 'Effects of tea on sleep in adults: a trial') AS t(source_id, citekey, title)")
    return R.match_files(files, sources).drop("method")


@query("SELECT o_custkey AS k, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'fail' WHEN bool_or(o_orderstatus = 'O') THEN 'warn' ELSE 'pass' END AS status FROM orders GROUP BY o_custkey")
def gate_rollup(spark, sf_dir):
    """RUL05."""
    s = F.col("o_orderstatus")
    return R.worst(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(s == "P", "fail").when(s == "O", "warn").otherwise("pass").alias("status")), "k")


@example("SELECT * FROM (VALUES (1, true, ''), (2, false, 'citations_unresolved,retracted_cited')) AS t(id, passed, blockers)")
def attribution_gate(spark, sf_dir):
    """AGG15."""
    rows = spark.sql("SELECT * FROM VALUES (1, 0, 0, 0, 0, 0, 0, 0), (2, 0, 0, 3, CAST(NULL AS INT), 0, 0, 0) AS t(id, passage_findings, open_reviews, citations_unresolved, retracted_cited, quotes_unmarked, data_unverified, self_overlap)")
    return R.attribution_gate(rows, ["id"]).withColumn("blockers", F.array_join("blockers", ","))


@example("SELECT v.sentence_id, v.state, a.grade FROM (SELECT * FROM " + _VERDICTS_SQL + ") v LEFT JOIN (VALUES (1, 'weak'), (13, 'strong')) AS a(sentence_id, grade) USING (sentence_id)")
def advisory_join(spark, sf_dir):
    """RUL06: grades of a model stand beside a verdict and never change it."""
    grades = spark.sql("SELECT * FROM VALUES (1, 'weak'), (13, 'strong') AS a(sentence_id, grade)")
    return _verdicts(spark).join(grades, "sentence_id", "left").select("sentence_id", "state", "grade")

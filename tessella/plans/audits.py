"""Audits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import audits as A
from tessella.operators import registry as R
from tessella.operators import ledgers as L
from tessella.operators import literature as P
from tessella.plans.literature import _PAPERS, papers
from tessella.plans.registry import query, table


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_NO_CODE = r"regexp_replace(coalesce(text, ''), '(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[^\n]*$|\z)', '', 'g')"
#: Texts in which wording of the kinds that are looked for occurs: every document with a sentence of its own added.
_SAID = "CASE doc_id % 5 WHEN 0 THEN chr(10) || 'This is not a guarantee, but it is perfect and certified.' WHEN 1 THEN chr(10) || 'No overlap was found. It''s running and was checked.' WHEN 2 THEN chr(10) || 'Nothing was flagged, measured on two sets.' WHEN 3 THEN chr(10) || 'You must not use --all-rows of run_me.py over 30 words; exit 2.' ELSE '' END"


def _said(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), _added()).alias("text"))


def _added():
    k, line = F.col("doc_id") % 5, lambda x: F.lit("\n" + x)
    return F.when(k == 0, line("This is not a guarantee, but it is perfect and certified.")).when(k == 1, line("No overlap was found. It's running and was checked.")).when(k == 2, line("Nothing was flagged, measured on two sets.")).when(k == 3, line("You must not use --all-rows of run_me.py over 30 words; exit 2.")).otherwise("")


_TEXTS = f"d AS (SELECT doc_id, coalesce(text, '') || {_SAID} AS text FROM documents)"


@query(rf"""WITH {_TEXTS}, t AS (SELECT doc_id, {_NO_CODE} AS t FROM d), l AS (SELECT doc_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM t)),
h AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_q(A.FORBIDDEN)}', 1) AS hits, string_split_regex(line, '{_q(A.FORBIDDEN)}') AS parts FROM l WHERE regexp_matches(line, '{_q(A.FORBIDDEN)}')),
k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM h), b AS (SELECT doc_id, line_no, hits[k] AS found, right(array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN i > 1 THEN hits[i - 1] ELSE '' END || parts[i]), ''), 30) AS before FROM k)
SELECT doc_id AS id, line_no::INT AS line_no, 'FORBIDDEN' AS kind, lower(found) AS found FROM b WHERE NOT regexp_matches(before, '{_q(A.NEGATION)}') UNION ALL SELECT doc_id, 0, 'UNBOUNDED', '' FROM t WHERE regexp_matches(t, '{_q(A.CLEAN)}') AND NOT regexp_matches(t, '{_q(A.BOUND)}')""")
def document_claims(spark, sf_dir):
    """FLT09."""
    return A.claim_findings(_said(spark, sf_dir))


_TRIM = r"regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


@query(rf"""WITH {_TEXTS}, p AS (SELECT doc_id, unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) AS p FROM d), c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_TRIM}), lambda s: s <> '') AS s FROM p),
u AS (SELECT doc_id, unnest(s) AS s FROM c), w AS (SELECT doc_id, s, regexp_matches(s, '{_q(A.INSTRUCTION)}') AS told, len(regexp_extract_all(s, '{A.WORD}')) AS n FROM u),
r AS (SELECT doc_id, 'long_instruction' AS rule, count(*) FILTER (told AND n > 20) AS n FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'long_sentence', count(*) FILTER (NOT told AND n > 25) FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'contraction', count(*) FILTER (regexp_matches(s, '{_q(A.CONTRACTION)}')) FROM w GROUP BY 1
  UNION ALL SELECT doc_id, 'progressive', count(*) FILTER (regexp_matches(s, '{_q(A.PROGRESSIVE)}')) FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'passive', count(*) FILTER (regexp_matches(s, '{_q(A.PASSIVE)}')) FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'long_paragraph', count(*) FILTER (len(s) > 6) FROM c GROUP BY 1)
SELECT doc_id AS id, rule, n FROM r WHERE n > 0""")
def document_controlled_english(spark, sf_dir):
    """FLT12."""
    return A.controlled_english(_said(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 3 AS k, p_size % 2 = 0 AS declares FROM part) SELECT id, 'missing_section' AS issue, 'abstract' AS item FROM p WHERE k = 2 UNION ALL SELECT id, 'missing_section', 'methods' FROM p WHERE k = 0 UNION ALL SELECT id, 'missing_declaration', 'conflicts' FROM p WHERE declares UNION ALL SELECT id, 'citation_in_section', 'abstract' FROM p WHERE k = 0""")
def manuscript_sections(spark, sf_dir):
    """FLT17: a manuscript made of every part."""
    k = F.col("p_size") % 3
    text = F.concat(F.when(k == 0, "# Abstract\nTea [1, 2].\n").when(k == 1, "# Abstract\nTea.\n## Methods\nAs (Lee et al., 2019).\n").otherwise("# Methods\n"), F.when(F.col("p_size") % 2 == 0, "# Declarations\nFunding: none.").otherwise(""))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return A.section_audit(docs, ["abstract", "methods"], {"funding": "(?i)funding", "conflicts": "(?i)conflict|competing"}, ["abstract"])


@query(r"""WITH o AS (SELECT o_orderkey AS id, o_custkey % 4 AS k, o_orderkey % 90 + 10 AS p FROM orders), l AS (SELECT *, CASE WHEN k < 2 THEN p / 100.0 END AS v FROM o)
SELECT id, 2 AS line_no, CASE WHEN k = 0 THEN CASE WHEN p / 100.0 > 0.05 THEN 'p above 0.05 called significant' ELSE 'ok' END WHEN k = 1 THEN CASE WHEN p / 1000.0 < 0.05 THEN 'p below 0.05 called not significant' ELSE 'ok' END ELSE 'no p value' END AS kind FROM l""")
def order_significance(spark, sf_dir):
    """WIN05: a p value on the line after an unfinished one counts, one after a finished sentence doesn't."""
    k, p = F.col("o_custkey") % 4, (F.col("o_orderkey") % 90 + 10).cast("string")
    line = F.when(k == 0, F.concat(F.lit("It was significant\n(p = 0."), p, F.lit(")."))).when(k == 1, F.concat(F.lit("It was not significant, p = 0.0"), p, F.lit(".\np = 0.9"))).when(k == 2, "A significant rise.\np = 0.01").otherwise("A significant rise")
    return A.significance_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Results\n"), line).alias("text")))


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', ''), '')"


@query(rf"""WITH h AS (SELECT page_id, {_HOST} || CASE WHEN page_id % 3 = 0 THEN '.co.uk' ELSE '' END AS host FROM pages), l AS (SELECT page_id, host, string_split(host, '.') AS l FROM h), w AS (SELECT *, len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu') AS wide FROM l)
SELECT page_id, CASE WHEN wide THEN l[-3] WHEN len(l) > 1 THEN l[-2] END AS sld, CASE WHEN wide THEN l[-2] || '.' || l[-1] WHEN len(l) > 1 THEN l[-1] END AS tld, CASE WHEN wide THEN l[-3] || '.' || l[-2] || '.' || l[-1] WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE host END AS registrable FROM w""")
def page_host_parts(spark, sf_dir):
    """SRC19."""
    host = F.concat(T.host(F.col("url")), F.when(F.col("page_id") % 3 == 0, ".co.uk").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", A.host_parts(host).alias("h")).select("page_id", "h.*")


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(t, '{_q(p)}', 1))) AS token FROM t" for k, p in A.NORMATIVE.items())
_TOKENS = rf"""WITH {_TEXTS}, t AS (SELECT doc_id, regexp_replace({_NO_CODE}, '`([^`\n]*)`', '\1', 'g') AS t FROM d),
c AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(s, '[\x20\x09-\x0D]+', ' ', 'g'))) AS s FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM t) WHERE regexp_matches(s, '{_q(A.CLAUSE)}')),
f AS ({_FOUND} UNION ALL SELECT doc_id, 'clause', substr(sha1(s), 1, 12) FROM c)"""


@query(_TOKENS + " SELECT doc_id AS id, kind, token FROM f")
def document_normative_tokens(spark, sf_dir):
    """SCA17."""
    return A.normative_tokens(_said(spark, sf_dir))


@query(_TOKENS + " SELECT doc_id AS id, kind, token FROM f WHERE kind <> 'clause' AND contains(token, 'run')")
def document_lost_tokens(spark, sf_dir):
    """JOIN10: what every text loses when its tokens with "run" go."""
    said = A.normative_tokens(_said(spark, sf_dir))
    return A.lost_tokens(said, said.where(~F.contains("token", F.lit("run"))))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_linenumber = 7 THEN ' ' ELSE (l_partkey || '-' || l_suppkey) END AS k, l_partkey AS study, CASE WHEN l_tax > 0.02 THEN l_suppkey END AS dep, l_returnflag AS f FROM lineitem), n AS (SELECT trim(k) AS k, count(*) AS n FROM r GROUP BY 1), m AS (SELECT study, count(*) AS m FROM r GROUP BY 1),
j AS (SELECT r.row, trim(r.k) AS k, n, m, dep, f FROM r JOIN n ON trim(r.k) = n.k JOIN m USING (study))
SELECT row, 'blank key' AS issue FROM j WHERE k = '' UNION ALL SELECT row, 'repeated key' FROM j WHERE k <> '' AND n > 1 UNION ALL SELECT row, 'repeated study without dependency' FROM j WHERE m > 1 AND dep IS NULL UNION ALL SELECT row, 'unknown f' FROM j WHERE f NOT IN ('A', 'N')""")
def line_sheet_issues(spark, sf_dir):
    """AGG13."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("row"), F.when(c("l_linenumber") == 7, " ").otherwise(F.concat("l_partkey", F.lit("-"), "l_suppkey")).alias("key"), c("l_partkey").alias("study"), F.when(c("l_tax") > 0.02, c("l_suppkey")).alias("dep"), c("l_returnflag").alias("f"))
    return A.sheet_issues(rows, "key", "study", "dep", {"f": ["A", "N"]})


@query("""WITH r AS (SELECT l_linestatus AS s, l_returnflag IN ('A', 'N') AS x, l_shipmode_ AS y FROM (SELECT *, (l_partkey + l_suppkey) % 3 < 2 AS l_shipmode_ FROM lineitem)), g AS (SELECT s, count(*) AS n, count(*) FILTER (x = y) AS same, count(*) FILTER (x AND NOT y) AS a_first, count(*) FILTER (y AND NOT x) AS b_first, count(*) FILTER (x) AS na, count(*) FILTER (y) AS nb FROM r GROUP BY s),
p AS (SELECT *, same / n AS po, (na * nb + (n - na) * (n - nb)) / (n * n) AS pe FROM g) SELECT s, n, same, a_first, b_first, round((po - pe) / (1 - pe), 9) AS kappa FROM p""")
def line_rater_strata(spark, sf_dir):
    """AGG17: three categories collapsed to two, by stratum, with the direction of disagreement."""
    other = F.element_at(F.array(*map(F.lit, "ANR")), ((F.col("l_partkey") + F.col("l_suppkey")) % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("a"), other.alias("b"))
    return A.rater_table(rows, "a", "b", {"A": "in", "N": "in", "R": "out"}, ["s"]).withColumn("kappa", F.round("kappa", 9))


@query(f"""WITH {_PAPERS} SELECT journal, count(year) AS count, count(*) FILTER (year IS NULL) AS missing, round(min(year), 3)::DOUBLE AS least, round(max(year), 3)::DOUBLE AS most, round(avg(year), 3) AS mean, round(stddev_samp(year), 3) AS std, round(quantile_cont(year, 0.5), 3)::DOUBLE AS median, round(quantile_cont(year, 0.75) - quantile_cont(year, 0.25), 3)::DOUBLE AS iqr FROM p GROUP BY journal""")
def paper_years(spark, sf_dir):
    """AGG04: the distribution of years."""
    return A.distribution(papers(spark, sf_dir), F.col("year"), ["journal"])


@query(f"""WITH {_PAPERS}, a AS (SELECT CASE WHEN paper_id % 6 = 0 THEN NULL ELSE paper_id % 5 + 1 END AS n FROM p) SELECT count(n) AS count, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS several, round(avg(n), 3) AS mean, round(stddev_samp(n), 3) AS std, round(quantile_cont(n, 0.5), 3)::DOUBLE AS median FROM a""")
def paper_author_counts(spark, sf_dir):
    """AGG04: numbers of authors; an empty list is missing."""
    p = papers(spark, sf_dir).withColumn("authors", F.when(F.col("paper_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("x"), (F.col("paper_id") % 5 + 1).cast("int"))))
    n = F.nullif(F.size("authors"), F.lit(0))
    both = A.distribution(p, n).crossJoin(p.agg(F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("several")))
    return both.select("count", "missing", "single", "several", "mean", "std", "median")


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS batch FROM events")
def event_batches(spark, sf_dir):
    """STR06: requests of each type in chunks of fifty."""
    return A.batches(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 50, ["event_type"]).select("event_id", "batch")


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 8 = 0 THEN 'UNCHECKED' WHEN p_partkey % 7 = 0 THEN 'FAIL' WHEN p_partkey % 5 = 0 THEN 'RETRACTED' WHEN p_size % 2 = 0 OR p_partkey % 3 = 0 THEN 'WARN' ELSE 'OK' END AS status,
  CASE WHEN p_partkey % 9 > 0 AND p_partkey % 8 > 0 AND p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND (p_size % 2 = 0 OR p_partkey % 3 = 0) THEN concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'year' END, CASE WHEN p_partkey % 3 = 0 THEN 'title' END) END AS detail FROM part""")
def part_bibliography(spark, sf_dir):
    """JOIN08: an unreachable registry is no finding."""
    c, every = F.col, lambda n: F.col("p_partkey") % n == 0
    p = table(spark, sf_dir, "part")
    entries = p.select(c("p_partkey").alias("key"), F.when(~every(9), F.concat(F.lit("id"), "p_partkey")).alias("ident"), c("p_name").alias("title"), c("p_size").alias("year"))
    records = p.select(F.concat(F.lit("id"), "p_partkey").alias("ident"), (~every(8)).alias("reached"), (~every(7)).alias("found"), F.when(every(3), F.concat(F.lit("x"), "p_name")).otherwise(F.upper("p_name")).alias("title"), (c("p_size") + F.when(c("p_size") % 2 == 0, 1).otherwise(0)).alias("year"), every(5).alias("retracted"))
    return R.bibliography_status(entries, records)


@query("""WITH p AS (SELECT p_partkey AS id, lpad(p_partkey::VARCHAR, 9, '0') AS k FROM part) SELECT id, CASE id % 4 WHEN 0 THEN 'a/Part_' || k || '.PDF' WHEN 1 THEN 'b/part_' || k || '.txt' WHEN 2 THEN 'c/my part_' || k || 'x.pdf' END AS file FROM p WHERE id % 4 < 3""")
def part_file_search(spark, sf_dir):
    """JOIN12: the same base name, the same stem, one stem in the other."""
    k, n, p = F.col("p_partkey"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), table(spark, sf_dir, "part")
    name = F.concat(F.lit("part_"), n, F.when(k % 4 == 2, "x").otherwise(""), F.lit(".pdf"))
    file = F.when(k % 4 == 0, F.concat(F.lit("a/Part_"), n, F.lit(".PDF"))).when(k % 4 == 1, F.concat(F.lit("b/part_"), n, F.lit(".txt"))).when(k % 4 == 2, F.concat(F.lit("c/my part_"), n, F.lit("x.pdf"))).otherwise(F.concat(F.lit("d/zz"), n, F.lit(".pdf")))
    got = R.find_files(p.select(name.alias("name")).where(~F.col("name").isNull()), p.select(file.alias("file")))
    ids = p.select(k.alias("id"), name.alias("name")).where(k % 4 < 3)
    return ids.join(got, "name").select("id", "file")


@query("""SELECT c_custkey AS id, c_custkey % 3 < 2 AS same FROM customer""")
def customer_names(spark, sf_dir):
    """FLT04: names with accents outside Latin-1, particles, initials and suffixes, one for each customer."""
    k = F.col("c_custkey")
    family = F.concat(F.lit("Dvořák"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    a = F.concat(family, F.lit(", Łucja Anna").substr(F.lit(1), F.lit(0)), F.lit(", Željko Jan"))
    b = F.when(k % 3 == 0, F.concat(F.lit("Z. "), F.translate(family, "řá", "ra"))).when(k % 3 == 1, F.concat(F.lit("Zeljko "), family, F.lit(" Jr"))).otherwise(F.concat(F.lit("Marie "), family))
    return table(spark, sf_dir, "customer").select(k.alias("id"), P.same_person(a, b).alias("same"))


@query(f"""SELECT c_custkey AS id, (c_custkey % 31)::INT AS said, (c_nationkey + 5)::BIGINT AS held FROM customer WHERE c_custkey % 31 <> c_nationkey + 5""")
def customer_claimed_counts(spark, sf_dir):
    """AGG11: numbers in digits and in words up to thirty."""
    k = F.col("c_custkey")
    word = F.element_at(F.array(*map(F.lit, L.NUMBER_WORDS)), (k % 31 + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    text = c.select(k.alias("id"), F.concat(F.lit("We had "), F.when(k % 2 == 0, word).otherwise((k % 31).cast("string")), F.lit(" studies in all.")).alias("text"))
    return L.claimed_counts(text, c.select(k.alias("id"), (F.col("c_nationkey") + 5).cast("long").alias("held")), "studies")


@query(r"""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '(\d),(\d{3})', '\1\2', 'g'), '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS n FROM documents) SELECT doc_id, len(n)::INT AS n, len(list_distinct(n))::INT AS n_different, list_max(n) AS most, list_min(n) AS least FROM n""")
def document_numbers(spark, sf_dir):
    """SCA06: all numbers as doubles, with signs, decimals and thousands."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.coalesce("text", F.lit(""))).alias("f"))
    return d.select("doc_id", F.size("f").alias("n"), F.size(F.array_distinct("f")).alias("n_different"), F.array_max("f").alias("most"), F.array_min("f").alias("least"))


_SOURCES = """SELECT 'S' || lpad(p_partkey::VARCHAR, 8, '0') AS source_id, p_partkey AS k, p_size AS n FROM part"""


@query(f"""WITH s AS ({_SOURCES}) SELECT CASE WHEN k % 19 = 0 THEN 'X' || k ELSE source_id END AS source_id, code, severity, detail FROM s, LATERAL (SELECT * FROM (VALUES
  ('INVALID_SOURCE_ID', 'error', '', k % 19 = 0), ('MISSING_TITLE', 'error', '', k % 19 > 0 AND n % 5 = 0), ('MISSING_AUTHORS', 'error', '', k % 19 > 0 AND k % 7 = 0), ('INVALID_YEAR', 'error', '', k % 19 > 0 AND n % 6 = 1), ('YEAR_OUT_OF_RANGE', 'error', '', k % 19 > 0 AND n % 6 = 2),
  ('MALFORMED_DOI', 'error', '', k % 19 > 0 AND k % 4 = 1), ('INCLUDED_WITHOUT_IDENTIFIER', 'error', '', k % 19 > 0 AND k % 4 = 2 AND k % 3 < 2), ('RETRIEVED_WITHOUT_IDENTIFIER', 'warning', '', k % 19 > 0 AND k % 4 = 2 AND k % 3 < 2), ('VERIFIED_WITHOUT_IDENTIFIER', 'error', '', k % 19 > 0 AND k % 4 = 2 AND n % 2 = 0),
  ('INVALID_PUBLICATION_TYPE', 'error', '', k % 19 > 0 AND n % 9 = 0), ('PREPRINT_INCLUDED_LABEL_REQUIRED', 'warning', '', k % 19 > 0 AND n % 9 = 1 AND k % 3 < 2), ('PEER_REVIEW_STATUS_UNKNOWN', 'warning', '', k % 19 > 0 AND k % 6 = 0), ('VERIFIED_WITHOUT_VERIFIER', 'error', '', k % 19 > 0 AND n % 2 = 0 AND k % 5 = 0),
  ('VERIFIED_DATE_IN_FUTURE', 'error', '', k % 19 > 0 AND n % 2 = 0 AND k % 8 = 0), ('UNVERIFIED_SOURCE_INCLUDED', 'error', '', k % 19 > 0 AND n % 2 = 1 AND k % 3 < 2), ('RETRACTED_SOURCE_INCLUDED', 'error', '', k % 19 > 0 AND k % 10 = 0 AND k % 3 < 2), ('RETRACTED_RETAINED_FOR_CONTEXT', 'info', '', k % 19 > 0 AND k % 10 = 0 AND k % 3 = 2),
  ('EXCLUDED_WITHOUT_REASON', 'error', '', k % 19 > 0 AND k % 3 = 2), ('CONTEXT_CITATION_NOT_IN_EVIDENCE_BASE', 'info', '', k % 19 > 0 AND k % 3 = 1 AND n % 2 = 0), ('MISSING_EXTRACTION_FIELD', 'warning', 'theme', k % 19 > 0 AND k % 3 = 0 AND n % 2 = 0), ('AMBIGUOUS_EXTRACTION_VALUE', 'warning', 'comparator', k % 19 > 0 AND k % 3 = 0 AND n % 2 = 0),
  ('MISSING_PAGES_FOR_JOURNAL_ARTICLE', 'warning', '', k % 19 > 0 AND k % 3 = 0 AND n % 2 = 0 AND n % 9 > 1), ('INVALID_N_PARTICIPANTS', 'warning', '', k % 19 > 0 AND k % 3 = 0 AND n % 2 = 0 AND n % 4 = 0), ('EFFECT_ESTIMATE_WITHOUT_NUMBER', 'warning', '', k % 19 > 0 AND k % 3 = 0 AND n % 2 = 0 AND n % 8 = 0), ('POSSIBLE_PHI_EMAIL', 'error', 'notes', k % 19 > 0 AND k % 25 = 0)) AS v(code, severity, detail, told)) WHERE told""")
def part_source_issues(spark, sf_dir):
    """RUL02: a ledger made of every part, whose rows break one constraint or another."""
    k, n = F.col("p_partkey"), F.col("p_size")
    when = lambda test, a, b="": F.when(test, a).otherwise(b)
    fields = {
        "source_id": F.when(k % 19 == 0, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("S"), F.lpad(k.cast("string"), 8, "0"))), "title": when(n % 5 == 0, "TBD", "Tea"), "authors": when(k % 7 == 0, " ", "Lee"), "container": F.lit("J"), "year": F.when(n % 6 == 1, "20x0").when(n % 6 == 2, "1400").otherwise("2020"),
        "doi": F.when(k % 4 == 1, "no doi").when(k % 4 == 2, "").otherwise("10.1000/x"), "publication_type": F.when(n % 9 == 0, "poem").when(n % 9 == 1, "preprint").otherwise("review"), "peer_reviewed": when(k % 6 == 0, "unknown", "Yes"), "verification_status": when(n % 2 == 0, "verified", "unverified"),
        "inclusion_status": F.when(k % 3 == 0, "included").when(k % 3 == 1, "cited_for_context").otherwise("excluded"), "retraction_status": when(k % 10 == 0, "retracted", "clear"), "retrieval_status": F.lit("returned"), "verifier": when(k % 5 == 0, "", "me"), "verified_date": when(k % 8 == 0, "2030-01-01", "2024-01-01"), "locator": F.lit("p. 1"),
        "volume": F.lit("3"), "n_participants": when(n % 4 == 0, "many", "1,200"), "effect_estimate": when(n % 8 == 0, "better", "HR 0.8"), "comparator": F.lit("None"), "notes": when(k % 25 == 0, "ask ann@example.org", "ok"), **{f: F.lit("told") for f in ("study_design", "population", "intervention", "follow_up", "key_outcomes", "main_finding")},
    }
    return A.source_issues(table(spark, sf_dir, "part").select(*(x.alias(f) for f, x in fields.items())), "2026-01-01")


@query("""WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_nationkey % 5 = 0 THEN 'not_reported' ELSE 't' || s_nationkey % 5 END AS theme, CASE WHEN s_suppkey % 4 > 0 THEN 1000 + s_suppkey END AS n, CASE WHEN s_acctbal > 0 THEN 'up' ELSE 'down' END AS direction, ['cohort', 'rct', 'review'][s_suppkey % 3 + 1] AS design FROM supplier),
c AS (SELECT theme, ['very low', 'low', 'moderate', 'high'][max(o_custkey % 4 + 1)] AS certainty, string_agg(DISTINCT CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, ';' ORDER BY CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END) AS caveats FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN s ON source_id = l_suppkey GROUP BY theme),
d AS (SELECT theme, string_agg(direction || ':' || n, ';' ORDER BY direction) AS directions FROM (SELECT theme, direction, count(*) AS n FROM s GROUP BY ALL) GROUP BY theme), e AS (SELECT theme, string_agg(design || ':' || n, ';' ORDER BY design) AS designs FROM (SELECT theme, design, count(*) AS n FROM s GROUP BY ALL) GROUP BY theme)
SELECT theme, count(*) AS n_sources, sum(n)::BIGINT AS participants, any_value(certainty) AS certainty, any_value(directions) AS directions, any_value(designs) AS designs, any_value(caveats) AS caveats FROM s LEFT JOIN c USING (theme) LEFT JOIN d USING (theme) LEFT JOIN e USING (theme) GROUP BY theme""")
def supplier_certainty(spark, sf_dir):
    """AGG08: suppliers as sources, orders as claims that rest on them."""
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.when(F.col("s_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("s_nationkey") % 5)).alias("theme"), F.when(k % 4 > 0, F.format_number(1000 + k, 0)).otherwise("many").alias("participants"), F.when(F.col("s_acctbal") > 0, "up").otherwise("down").alias("direction"), F.element_at(F.array(*map(F.lit, ("cohort", "rct", "review"))), (k % 3 + 1).cast("int")).alias("design"))
    o = table(spark, sf_dir, "orders")
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("source_ids"))
    certainty = F.element_at(F.array(*map(F.lit, ("very low", "low", "moderate", "high"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return A.certainty_table(sources, o.join(ids, "o_orderkey").select(certainty.alias("certainty"), F.nullif("o_orderstatus", F.lit("O")).alias("caveat"), "source_ids"))

"""Readers, citations, evidence and verdicts over whole tables: ledgers are made of orders, line items, parts, pages and documents, in both engines alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import quantities as Q
from tessella.functions import text as T
from tessella.operators import checks as C
from tessella.operators import registry as R
from tessella.operators import synthesis as S
from tessella.plans.evidence import _RESOLVED_SQL, _SOURCES, _MARKERS, _duck
from tessella.plans.registry import query, table
from tessella.sources import records as X
from tessella.sources import texts as D


def _of(spark, sf_dir, name, **columns):
    """Columns of a table by SQL that both engines read alike."""
    return table(spark, sf_dir, name).selectExpr(*(f"{sql} AS {k}" for k, sql in columns.items()))


def _select(name, **columns):
    return "SELECT " + ", ".join(f"{sql} AS {k}" for k, sql in columns.items()) + f" FROM {name}"


_ORDER_SOURCES = dict(source_id="concat('S', o_orderkey)", pos="o_orderkey", number="cast(o_orderkey % 50 AS string)", citekey="concat('cust', o_custkey)", doi="concat('https://doi.org/10.1000/', o_orderkey, '.')", pmid="cast(o_orderkey + 1000000 AS string)", year="CASE WHEN o_orderkey <= 500 THEN 1000 + o_orderkey ELSE 2000 END")
_LINE_MARKERS = dict(sentence_id="l_orderkey", token="CASE l_linenumber WHEN 1 THEN cast(l_suppkey AS string) WHEN 2 THEN concat('CUST', l_suppkey) WHEN 3 THEN concat('s', l_orderkey) WHEN 4 THEN concat('doi:10.1000/', l_partkey) WHEN 5 THEN cast(l_orderkey + 1000000 AS string) WHEN 6 THEN concat('author_year:Lee ', 1000 + l_partkey % 900) ELSE '#' END")


@query(_RESOLVED_SQL.replace(f"(SELECT * FROM {_duck(_SOURCES)})", f"({_select('orders', **_ORDER_SOURCES)})").replace(f"(SELECT * FROM {_MARKERS})", f"(SELECT DISTINCT * FROM ({_select('lineitem', **_LINE_MARKERS)}))").replace("AS INT))", "AS INT) AND regexp_matches(m.token, ' [0-9]{4}$'))") + " SELECT DISTINCT * FROM resolved")
def order_citations(spark, sf_dir):
    """JOIN01: lines cite orders by number, key, id, DOI, PMID or year."""
    return R.resolve(_of(spark, sf_dir, "lineitem", **_LINE_MARKERS), _of(spark, sf_dir, "orders", **_ORDER_SOURCES))


_LINES = dict(sentence_id="l_orderkey", quantity_id="l_linenumber", source_id="l_partkey", q="cast(l_quantity AS int)", t="cast(l_tax * 100 AS int)")
_VALUES_OF = "SELECT sentence_id, quantity_id, source_id, concat('i', q % 7) AS value_key FROM l UNION SELECT sentence_id, quantity_id, source_id, concat('i', t) FROM l"


@query(f"""WITH l AS ({_select("lineitem", **_LINES)}), v AS ({_VALUES_OF}), q AS (SELECT DISTINCT sentence_id, quantity_id, value_key FROM v), e AS (SELECT DISTINCT source_id, value_key FROM v WHERE quantity_id > 1), c AS (SELECT DISTINCT sentence_id, source_id FROM l),
k AS (SELECT sentence_id, quantity_id, list(value_key) AS need FROM q GROUP BY ALL), h AS (SELECT source_id, list(value_key) AS have FROM e GROUP BY source_id)
SELECT sentence_id, quantity_id FROM k LEFT JOIN c USING (sentence_id) LEFT JOIN h USING (source_id) GROUP BY ALL HAVING NOT bool_or(coalesce(list_has_all(have, need), false))""")
def order_quantities(spark, sf_dir):
    """JOIN02: quantities of lines of which no cited part has all values."""
    lines = _of(spark, sf_dir, "lineitem", **_LINES)
    one = lambda x: lines.select("sentence_id", "quantity_id", "source_id", F.concat(F.lit("i"), x).alias("value_key"))
    values = one(F.col("q") % 7).unionByName(one(F.col("t"))).distinct()
    return R.missing_quantities(values.select("sentence_id", "quantity_id", "value_key").distinct(), lines.select("sentence_id", "source_id").distinct(), values.where("quantity_id > 1").select("source_id", "value_key").distinct())


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS sentence_id, l_returnflag AS measure, l_discount::DOUBLE AS value FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS sentence_id, l_partkey AS source_id FROM lineitem),
e AS (SELECT l_partkey AS source_id, l_returnflag AS measure, l_tax::DOUBLE AS ev, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), j AS (SELECT m.*, source_id, ev, pos, abs(value - ev) > 1e-6 * greatest(1.0, abs(ev)) AS differs FROM m JOIN c USING (sentence_id) JOIN e USING (source_id, measure))
SELECT sentence_id, measure, value, source_id, arg_min(ev, pos) FILTER (differs) AS evidence_value FROM j GROUP BY sentence_id, measure, value, source_id HAVING bool_and(differs)""")
def order_contradictions(spark, sf_dir):
    """JOIN03: a line's discount against the taxes of the cited part's lines."""
    li = table(spark, sf_dir, "lineitem")
    measured = li.select(F.col("l_orderkey").alias("sentence_id"), F.col("l_returnflag").alias("measure"), F.col("l_discount").cast("double").alias("value")).distinct()
    evidence = li.select(F.col("l_partkey").alias("source_id"), F.col("l_returnflag").alias("measure"), F.col("l_tax").cast("double").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_pos"))
    return R.contradictions(measured, li.select(F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("source_id")).distinct(), evidence)


_FACTS = dict(
    sentence_id="l_orderkey * 10 + l_linenumber", k="l_suppkey % 4", n_markers="l_linenumber % 3", n_citing="CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 4 ELSE 0 END", n_triggers="l_suppkey % 2", n_resolved="l_partkey % 3", n_stray="CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END", n_author_year="CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    closed="l_returnflag <> 'R'", n_retracted="CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END", n_retracted_unverified="CASE WHEN l_suppkey % 18 = 0 THEN 1 ELSE 0 END", contradiction="CASE l_orderkey % 13 WHEN 0 THEN 'defensible' WHEN 1 THEN 'unlinked' WHEN 2 THEN 'transcribed' WHEN 3 THEN 'prose' END", n_graded="l_orderkey % 3", n_checkable="l_linenumber % 2", n_missing="CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END",
)
_RULES = f"""v AS (SELECT sentence_id, k, CASE WHEN n_markers = 0 AND n_triggers = 0 THEN 'D01' WHEN n_citing = 0 THEN 'D02' WHEN n_resolved = 0 AND closed AND n_stray + n_author_year > 0 THEN 'D03' WHEN n_resolved = 0 THEN 'D06' WHEN closed AND n_stray > 0 THEN 'D03' WHEN n_retracted_unverified > 0 THEN 'D11' WHEN n_retracted > 0 THEN 'D04'
  WHEN contradiction = 'defensible' THEN 'D08' WHEN contradiction = 'unlinked' THEN 'D11' WHEN contradiction = 'transcribed' THEN 'D13' WHEN contradiction = 'prose' THEN 'D12' WHEN n_graded = 0 THEN 'D05' WHEN n_missing = 0 AND n_checkable > 0 THEN 'D09' WHEN n_missing = 0 THEN 'D10' ELSE 'D07' END AS rule FROM ({_select("lineitem", **_FACTS)})),
w AS (SELECT sentence_id, k, CASE WHEN rule = 'D01' THEN 'no_citation_needed' WHEN rule IN ('D02', 'D03') THEN 'unattributed' WHEN rule IN ('D04', 'D08') THEN 'conflict' WHEN rule = 'D09' THEN 'attributed' WHEN rule = 'D10' THEN 'synthesis' ELSE 'unverifiable' END AS state, rule FROM v)"""


def _verdicts(spark, sf_dir):
    state, rule = R.ladder()
    return _of(spark, sf_dir, "lineitem", **_FACTS).select("sentence_id", "k", state.alias("state"), rule.alias("rule"))


@query(f"WITH {_RULES} SELECT sentence_id, state, rule FROM w")
def line_verdicts(spark, sf_dir):
    """RUL01, UDF03: every line's facts through the ladder."""
    return _verdicts(spark, sf_dir).drop("k")


@query(f"WITH {_RULES}, c AS (SELECT k, count(*) AS total, count(*) FILTER (rule <> 'D01') AS claiming, count(*) FILTER (rule IN ('D09', 'D10')) AS supported FROM w GROUP BY k) SELECT k, total, claiming, supported, round(supported / claiming, 4) AS coverage, round(100 * supported / claiming, 1) AS percent FROM c")
def line_coverage(spark, sf_dir):
    """AGG01."""
    return R.coverage(_verdicts(spark, sf_dir), ["k"])


@query(f"WITH {_RULES} SELECT 'unknown_rule' AS issue, count(*) AS n FROM w WHERE rule IN ('D06', 'D12')")
def line_cross_foot(spark, sf_dir):
    """AGG02."""
    return R.cross_foot(_verdicts(spark, sf_dir), [f"D{i:02d}" for i in range(1, 14) if i not in (6, 12)])


@query(f"WITH {_RULES} SELECT sentence_id, state, CASE WHEN n_name IS NOT NULL THEN n_name END AS grade FROM w LEFT JOIN nation ON n_nationkey = sentence_id % 40")
def line_grades(spark, sf_dir):
    """RUL06: grades stand beside a verdict and never change it."""
    grades = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("grade"))
    return _verdicts(spark, sf_dir).withColumn("g", F.col("sentence_id") % 40).join(grades, "g", "left").select("sentence_id", "state", "grade")


@query("""WITH c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'draft' END AS claim_status FROM orders), l AS (SELECT l_orderkey AS claim_id, l_suppkey::VARCHAR AS source_id FROM lineitem UNION SELECT o_orderkey, o_custkey || 'x' FROM orders),
s AS (SELECT s_suppkey::VARCHAR AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'draft' ELSE 'verified' END AS status, CASE WHEN s_nationkey > 20 THEN 'excluded' ELSE 'included' END AS inclusion, CASE WHEN s_suppkey % 7 = 0 THEN 'retracted' ELSE 'clear' END AS retraction, s_acctbal > 0 AS held FROM supplier),
j AS (SELECT claim_id, source_id, claim_status, status, inclusion, retraction, held FROM c JOIN l USING (claim_id) LEFT JOIN s USING (source_id))
SELECT claim_id, source_id, 'unknown_source' AS issue FROM j WHERE status IS NULL UNION ALL SELECT claim_id, source_id, 'source_not_verified' FROM j WHERE status <> 'verified' UNION ALL SELECT claim_id, source_id, 'source_not_included' FROM j WHERE inclusion <> 'included' UNION ALL SELECT claim_id, source_id, 'source_retracted' FROM j WHERE retraction = 'retracted'
UNION ALL SELECT claim_id, source_id, 'verified_claim_on_unverified_source' FROM j WHERE claim_status = 'verified' AND status <> 'verified' UNION ALL SELECT claim_id, source_id, 'gap_no_text' FROM j WHERE claim_status = 'verified' AND NOT held""")
def order_claim_audit(spark, sf_dir):
    """JOIN05, SET06: orders claim on suppliers, and on ids that aren't known."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    links = li.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").cast("string").alias("s")).unionByName(o.select(F.col("o_orderkey").alias("claim_id"), F.concat("o_custkey", F.lit("x")).alias("s")))
    ids = links.groupBy("claim_id").agg(F.collect_set("s").alias("source_ids"))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("draft").alias("status")).join(ids, "claim_id")
    sources = _of(spark, sf_dir, "supplier", source_id="cast(s_suppkey AS string)", status="CASE WHEN s_suppkey % 3 = 0 THEN 'draft' ELSE 'verified' END", inclusion="CASE WHEN s_nationkey > 20 THEN 'excluded' ELSE 'included' END", retraction="CASE WHEN s_suppkey % 7 = 0 THEN 'retracted' ELSE 'clear' END", held="s_acctbal > 0")
    return R.claim_audit(claims, sources)


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'unchecked' END, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 7 = 0 THEN 'doi' END, CASE WHEN p_partkey % 4 = 0 THEN 'title' END, CASE WHEN p_partkey % 3 = 0 THEN 'year' END, CASE WHEN p_size % 2 = 0 THEN 'volume' END, CASE WHEN p_partkey % 6 = 0 THEN 'pages' END, CASE WHEN p_brand <> 'Brand#1' THEN 'author' END) AS issues FROM part""")
def part_records(spark, sf_dir):
    """JOIN07, JOIN08: parts against records of which every so many differ in one field."""
    p, c = table(spark, sf_dir, "part"), F.col
    every = lambda n: c("p_partkey") % n == 0
    own = F.struct(F.concat(F.lit("10.1000/A"), "p_partkey").alias("doi"), c("p_name").alias("title"), c("p_size").alias("year"), F.lit("1").alias("volume"), F.concat(F.lit("e"), c("p_partkey"), F.lit("-9")).alias("pages"), F.concat("p_brand", F.lit(", J")).alias("author"))
    far = F.struct(F.when(~every(5), F.concat(F.lit("https://doi.org/10.1000/a"), c("p_partkey") + F.when(every(7), 1).otherwise(0))).alias("doi"), F.when(every(4), F.lit("0123456789 abcdefghij 0123456789 xyzxyzxyz")).otherwise(F.concat("p_name", F.lit("."))).alias("title"), (c("p_size") + F.when(every(3), 1).otherwise(0)).alias("year"), F.when(c("p_size") % 2 == 0, "2").otherwise("1").alias("volume"), (c("p_partkey") + F.when(every(6), 1).otherwise(0)).cast("string").alias("pages"), F.lit("brand#1").alias("author"))
    return p.select(c("p_partkey").alias("id"), F.array_join(R.compare_record(own, far), ",").alias("issues"))


_SIGNALS = dict(id="o_orderkey", a="CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus = 'F' END", b="CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 5 = 0 END", c="CASE WHEN o_orderkey % 2 > 0 THEN false END")


@query(f"SELECT id, coalesce(a, false) OR coalesce(b, false) AS is_retracted, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'unreachable' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'partial' ELSE 'ok' END AS status FROM ({_select('orders', **_SIGNALS)})")
def order_retractions(spark, sf_dir):
    """JOIN13, JOIN14."""
    hit, status = R.retraction([F.col(x) for x in "abc"])
    return _of(spark, sf_dir, "orders", **_SIGNALS).select("id", hit.alias("is_retracted"), status.alias("status"))


@query("SELECT page_id, url FROM pages")
def page_links(spark, sf_dir):
    """SRC19: every page's address, wrapped as a search engine does, comes out again."""
    wrapped = F.concat(F.lit("https://find.example/l?x=1&url="), F.url_encode("url"), F.lit("&y=2"))
    return table(spark, sf_dir, "pages").select("page_id", X.unwrap(wrapped).alias("url"))


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat([p_size, 3], range(p_size + 2, p_size + 2 + p_partkey % 5 + 1)))), ',') AS numbers FROM part")
def part_markers(spark, sf_dir):
    """SCA04: markers with ranges by hyphen and by dash."""
    c = F.col
    text = F.concat(F.lit("as ["), c("p_size"), F.lit(", 3] and ["), c("p_size") + 2, F.when(c("p_partkey") % 2 == 0, "-").otherwise("–"), c("p_size") + 2 + c("p_partkey") % 5, F.lit("] say [a]"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.array_join(Q.numeric_markers(text), ",").alias("numbers"))


@query("SELECT c_custkey AS id, 'lee ' || (1990 + c_custkey % 30) || ';kim ' || (2000 + c_nationkey) || 'b' AS markers FROM customer")
def customer_markers(spark, sf_dir):
    """SCA04: author and year."""
    text = F.concat(F.lit("It rose (Lee et al., "), 1990 + F.col("c_custkey") % 30, F.lit("; Kim and Diaz "), 2000 + F.col("c_nationkey"), F.lit("b) in "), F.col("c_custkey"), F.lit(" rows."))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(Q.author_year_markers(text), ";").alias("markers"))


@query("""SELECT p_partkey AS id, 'p_value:p < 0.0' || (1 + p_size % 9) || '|measure:HR 0.' || (10 + p_size) || '|confidence_interval:95% CI 0.' || (10 + p_size) || ' to 1.' || (10 + p_size) || '|percent:' || p_size || '.5%|fraction:' || p_size || '/90|count:n = ' || (p_partkey + 10000) || '|unit:' || p_size || ' mg|duration:' || p_size || ' weeks|year:2019|number:' || (p_partkey + 10000) AS q FROM part""")
def part_quantities(spark, sf_dir):
    """SCA05: a quantity of each kind, of which the earlier owns its text."""
    c, size = F.col, F.col("p_size")
    text = F.concat(F.lit("HR 0."), 10 + size, F.lit(" (95% CI 0."), 10 + size, F.lit(" to 1."), 10 + size, F.lit("), p < 0.0"), 1 + size % 9, F.lit("; "), size, F.lit(".5% ("), size, F.lit("/90) in 2019, n = "), c("p_partkey") + 10000, F.lit(", on "), size, F.lit(" mg over "), size, F.lit(" weeks; then "), c("p_partkey") + 10000)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.array_join(F.transform(Q.quantities(text), lambda s: F.concat_ws(":", s["kind"], s["raw"])), "|").alias("q"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, abs(l_extendedprice::DOUBLE / 7 - round(l_extendedprice::DOUBLE / 7 + l_linenumber % 3 * 0.004, 2)) <= 0.005 + 1e-12 AS two, abs(l_extendedprice::DOUBLE / 7 - round(l_extendedprice::DOUBLE / 7 + l_linenumber % 2, 0)) <= 0.5 + 1e-12 AS none FROM lineitem""")
def line_traceability(spark, sf_dir):
    """SCA08: numbers as they are written, with two decimals and with none."""
    value, c = F.col("l_extendedprice").cast("double") / 7, F.col
    two = F.format_string("%.2f", F.round(value + c("l_linenumber") % 3 * 0.004, 2))
    none = F.format_string("%.0f", F.round(value + c("l_linenumber") % 2, 0))
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), Q.traceable(two, F.array(value)).alias("two"), Q.traceable(none, F.array(value)).alias("none"))


_IDS = "CASE p_partkey % 6 WHEN 0 THEN concat('10.1000/x', p_partkey) WHEN 1 THEN concat('https://doi.org/10.1000/Y', p_partkey) WHEN 2 THEN concat('arXiv:2101.0', 1000 + p_partkey % 9000, 'v2') WHEN 3 THEN concat('PMC', p_partkey) WHEN 4 THEN concat('PMID: ', 10000 + p_partkey) ELSE p_name END"


@query(f"SELECT p_partkey AS id, {_IDS} AS value, CASE p_partkey % 6 WHEN 0 THEN 'doi' WHEN 1 THEN 'doi' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'pmcid' WHEN 4 THEN 'pmid' ELSE 'title' END AS kind FROM part")
def part_identifier_kinds(spark, sf_dir):
    """SCA09."""
    return _of(spark, sf_dir, "part", id="p_partkey", value=_IDS).withColumn("kind", T.identifier_kind(F.col("value")))


@query(r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\d+(?:\.\d+)?')) AS a, list_distinct(regexp_extract_all(replace(coalesce(text, ''), '1', '7'), '\d+(?:\.\d+)?')) AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS dropped FROM d""")
def document_revisions(spark, sf_dir):
    """FLT11, SET04: what a revision of every text adds and drops."""
    text = F.coalesce("text", F.lit(""))
    more, less = C.added(text, F.replace(text, F.lit("1"), F.lit("7")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(more, ",").alias("added"), F.array_join(less, ",").alias("dropped"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[#*_`>\x20\x09-\x0D]', '', 'g') AS bare FROM documents), n AS (SELECT doc_id, bare, length(regexp_replace(bare, '[^A-Za-z]', '', 'g')) AS ascii, length(regexp_replace(bare, '[\x00-\x7F]', '', 'g')) AS other FROM d)
SELECT doc_id, CASE WHEN bare = '' THEN 'blank' WHEN ascii = 0 THEN 'no letters' WHEN other > ascii THEN 'other script' END AS gap FROM n""")
def document_prose_gaps(spark, sf_dir):
    """FLT11."""
    return table(spark, sf_dir, "documents").select("doc_id", C.prose_gap(F.col("text")).alias("gap"))


@query("SELECT p_partkey AS id, 'article' AS type, 'k' || p_partkey AS key, p_name AS title, (1900 + p_size)::VARCHAR AS year, p_brand AS journal FROM part")
def part_bibtex(spark, sf_dir):
    """SRC10: entries written of every part, with comments between, are read again."""
    text = F.concat(F.lit("@comment{x}\n@Article{k"), "p_partkey", F.lit(",\n  title = {"), "p_name", F.lit("},\n  year = "), 1900 + F.col("p_size"), F.lit(',\n  journal="'), "p_brand", F.lit('"\n}\n'))
    b = X.bibtex(table(spark, sf_dir, "part").select(text.alias("text")))
    return b.select(F.substring("key", 2, 20).cast("long").alias("id"), "type", "key", *(F.col("fields")[n].alias(n) for n in ("title", "year", "journal")))


@query("""WITH l AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || ',"a,
b",' || l_suppkey || CASE WHEN l_suppkey % 3 = 0 THEN ',more' ELSE '' END) + 1 AS line, CASE WHEN l_suppkey % 3 = 0 THEN 4 ELSE 3 END AS cells FROM lineitem) SELECT path, line::INT AS line, cells, 3 AS expected FROM l WHERE cells <> 3""")
def order_csv_rows(spark, sf_dir):
    """SRC09: an order is a file of three columns; some lines have four, and some cells quote a comma or a line's end."""
    c = F.col
    row = F.concat(c("l_partkey"), F.lit(",\"a,\nb\","), c("l_suppkey"), F.when(c("l_suppkey") % 3 == 0, ",more").otherwise(""))
    files = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("path")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    text = F.concat(F.lit("x,y,z\n"), F.array_join(F.transform("rows", lambda s: s["r"]), "\n"), F.lit("\n"))
    return X.ragged_rows(files.select("path", text.alias("text")))


@query("SELECT p_partkey::VARCHAR AS pmid, p_name AS title, 'AIM: ' || p_type || ' END: ' || p_name AS abstract, 1900 + p_size AS year, p_brand || ';' || p_type AS authors, '10.1000/p' || p_partkey AS doi FROM part")
def part_articles(spark, sf_dir):
    """SRC15, SRC16."""
    parts = ['<PubmedArticle><PMID V="1">', "p_partkey", "</PMID><ArticleTitle><i>", "p_name", "</i></ArticleTitle><PubDate><Year>", "y", '</Year></PubDate><Abstract><AbstractText Label="AIM">', "p_type", '</AbstractText><AbstractText Label="END">', "p_name", "</AbstractText></Abstract><Author><LastName>", "p_brand", "</LastName></Author><Author><CollectiveName>", "p_type", '</CollectiveName></Author><ReferenceList><ArticleId IdType="doi">10.1000/ref</ArticleId></ReferenceList><ArticleId IdType="doi">10.1000/P', "p_partkey", "</ArticleId></PubmedArticle>"]
    xml = F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))
    return X.articles(table(spark, sf_dir, "part").withColumn("y", 1900 + F.col("p_size")).select(xml.alias("xml"))).withColumn("authors", F.array_join("authors", ";"))


@query("SELECT p_partkey AS id, 'Aim\n\n' || p_name || ' is ' || p_type AS body FROM part")
def part_article_bodies(spark, sf_dir):
    """SRC17."""
    xml = F.concat(F.lit("<article><body><sec><title>Aim</title><p>"), "p_name", F.lit(" is <b>"), "p_type", F.lit("</b></p><table-wrap>x</table-wrap></sec></body><ref-list><ref>x</ref></ref-list></article>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.body_text(xml).alias("body"))


@query("SELECT p_partkey AS id, '# ' || p_type || '\n\n' || 'We follow [k' || p_partkey || '] on ' || p_name || '.' AS body FROM part")
def part_latex(spark, sf_dir):
    """SRC03."""
    tex = F.concat(F.lit("\\documentclass{a}\\begin{document}\\section{"), "p_type", F.lit("} We \\emph{follow}~\\cite{k"), F.col("p_partkey").cast("string"), F.lit("} on "), "p_name", F.lit(". % note\n\\begin{table}x\\end{table}\\end{document}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), D.latex_text(tex).alias("body"))


@query("SELECT p_brand AS doc, p_partkey % 9999 AS number, CASE WHEN p_size % 2 = 0 THEN '10.1000/r' || p_partkey END AS doi, 1950 + p_size AS year, CASE WHEN p_size % 2 = 1 THEN (10000 + p_partkey)::VARCHAR END AS pmid FROM part")
def part_references(spark, sf_dir):
    """SRC11."""
    c = F.col
    mark = F.when(c("p_size") % 3 == 0, F.concat(F.lit("["), c("p_partkey") % 9999, F.lit("]"))).otherwise(F.concat(c("p_partkey") % 9999, F.lit(".")))
    line = F.concat(mark, F.lit(" Lee. Tea. "), 1950 + c("p_size"), F.when(c("p_size") % 2 == 0, F.concat(F.lit(". doi:10.1000/R"), c("p_partkey"), F.lit("."))).otherwise(F.concat(F.lit(". PMID: "), 10000 + c("p_partkey"))))
    return X.reference_list(table(spark, sf_dir, "part").select(c("p_brand").alias("doc"), line.alias("line"))).select("doc", "number", "doi", "year", "pmid")


_LEDGER = dict(source_id="p_partkey", effect_estimate="CASE p_size % 4 WHEN 0 THEN 'HR 0.8' WHEN 1 THEN 'not_reported' ELSE '' END", n_participants="''", follow_up="cast(NULL AS string)", main_finding="CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END", key_outcomes="' '", population="CASE WHEN p_partkey % 5 = 0 THEN 'adults' ELSE NULL END", intervention="''", comparator="'Not_reported'")


@query("SELECT p_partkey AS source_id, CASE WHEN p_size % 4 = 0 THEN 'recorded_estimate' WHEN p_partkey % 3 = 0 THEN 'prose_summary' WHEN p_partkey % 5 = 0 THEN 'metadata_only' ELSE 'none' END AS strength FROM part")
def part_strength(spark, sf_dir):
    """SRC12."""
    return _of(spark, sf_dir, "part", **_LEDGER).select("source_id", R.strength().alias("strength"))


_GIVEN = "CASE p_partkey % 4 WHEN 0 THEN concat('https://doi.org/10.1000/A', p_partkey) WHEN 1 THEN concat('pmc', p_partkey) WHEN 2 THEN cast(p_partkey + 500000 AS string) ELSE concat('none', p_partkey) END"


@query(f"SELECT {_GIVEN} AS given, CASE WHEN p_partkey % 4 < 3 THEN '10.1000/a' || p_partkey END AS doi, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey + 500000)::VARCHAR END AS pmid, CASE WHEN p_partkey % 4 < 3 THEN 'PMC' || p_partkey END AS pmcid FROM part")
def part_crosswalk(spark, sf_dir):
    """SRC20."""
    return X.crosswalk(_of(spark, sf_dir, "part", given=_GIVEN), _of(spark, sf_dir, "part", doi="concat('10.1000/a', p_partkey)", pmid="cast(p_partkey + 500000 AS string)", pmcid="concat('PMC', p_partkey)"))


_TRIES = dict(source_id="l_orderkey", tier="CASE l_linenumber % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'pdf' ELSE 'cli' END", title="concat('Part ', l_partkey % 5)", text="CASE WHEN l_suppkey % 4 > 0 THEN concat('on part ', l_suppkey % 5, ' and tea') END")


@query(f"WITH a AS ({_select('lineitem', **_TRIES)}) SELECT source_id, CASE min(CASE tier WHEN 'api' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END) WHEN 0 THEN 'api' WHEN 1 THEN 'pdf' ELSE 'cli' END AS tier FROM a WHERE contains(lower(text), lower(title)) GROUP BY source_id")
def order_acquisition(spark, sf_dir):
    """SRC18: the first tier whose text is of the cited work."""
    return X.acquired(_of(spark, sf_dir, "lineitem", **_TRIES)).select("source_id", "tier")


_GATES = dict(id="o_orderkey", passage_findings="0", open_reviews="o_custkey % 2", citations_unresolved="CASE WHEN o_orderkey % 5 > 0 THEN 0 END", retracted_cited="CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END", quotes_unmarked="0", data_unverified="0", self_overlap="0")


@query(f"SELECT id, open_reviews = 0 AND coalesce(citations_unresolved = 0, false) AND retracted_cited = 0 AS passed, concat_ws(',', CASE WHEN open_reviews <> 0 THEN 'open_reviews' END, CASE WHEN citations_unresolved IS NULL THEN 'citations_unresolved' END, CASE WHEN retracted_cited <> 0 THEN 'retracted_cited' END) AS blockers FROM ({_select('orders', **_GATES)})")
def order_gates(spark, sf_dir):
    """AGG15: every order's facts through the gate."""
    return R.attribution_gate(_of(spark, sf_dir, "orders", **_GATES), ["id"]).withColumn("blockers", F.array_join("blockers", ","))


@query("SELECT 'S' || p_partkey || '_final.pdf' AS file, 'S' || p_partkey AS source_id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'key' || p_partkey || '-v2.PDF', 'S' || p_partkey FROM part WHERE p_partkey % 2 = 1")
def part_files(spark, sf_dir):
    """JOIN12: files named by id or by key."""
    p = table(spark, sf_dir, "part")
    files = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), "p_partkey", F.lit("_final.pdf"))).otherwise(F.concat(F.lit("key"), "p_partkey", F.lit("-v2.PDF"))).alias("file"))
    return R.match_files(files, p.select(F.concat(F.lit("S"), "p_partkey").alias("source_id"), F.concat(F.lit("key"), "p_partkey").alias("citekey"), F.lit("short").alias("title"))).drop("method")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, round((l_discount + l_quantity - l_discount)::DOUBLE / (2 * 1.959963984540054), 9) AS se, round(CASE WHEN l_tax > 0 THEN ln(l_tax::DOUBLE * 20) END, 9) AS lr, round(CASE WHEN l_discount < 0.1 THEN atanh(l_discount::DOUBLE * 10) END, 9) AS z, round(CASE WHEN l_quantity > 3 THEN 1 / sqrt(l_quantity - 3) END, 9) AS z_se FROM lineitem""")
def line_effect_sizes(spark, sf_dir):
    """STA01."""
    c = {n: F.col(f"l_{n}").cast("double") for n in ("discount", "quantity", "tax")}
    sizes = (("se", S.se_from_ci(c["discount"], c["discount"] + c["quantity"])), ("lr", S.log_ratio(c["tax"] * 20)), ("z", S.fisher_z(c["discount"] * 10)), ("z_se", S.fisher_se(c["quantity"])))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *(F.round(x, 9).alias(k) for k, x in sizes))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 'no estimate' WHEN o_custkey % 5 = 0 THEN 'no standard error' WHEN o_orderstatus = 'P' THEN 'standard error not positive' END AS reason FROM orders")
def order_drop_reasons(spark, sf_dir):
    """STA03, AGG13."""
    o = table(spark, sf_dir, "orders")
    yi, sei = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice").cast("double")), F.when(F.col("o_custkey") % 5 != 0, F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(0.5))
    return o.select(F.col("o_orderkey").alias("id"), S.drop_reason(yi, sei).alias("reason"))

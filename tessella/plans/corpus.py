"""Documents, pages and labels: profiles, duplicates, checks, markup, agreement."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import agreement as A
from tessella.operators import audits as A2
from tessella.operators import checks as C
from tessella.plans.registry import query, table

_FRAME = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT min(doc_id) AS first_id, count(*) AS n, text FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_duplicates(spark, sf_dir):
    """AGG07: texts that occur more than once, with the first."""
    return _docs(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "n", "text")


@query("""SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')), lang) AS first_id, length(text) AS n FROM documents) WHERE n >= 80 AND doc_id <> first_id""")
def doc_prefix_duplicates(spark, sf_dir):
    """AGG07: documents that begin like an earlier one of their language; the later one is the offender."""
    d = _docs(spark, sf_dir).where(F.length("text") >= 0).select("doc_id", "lang", T.title_key(F.substring("text", 1, 80)).alias("key"), F.length("text").alias("n"))
    firsts = d.groupBy("key", "lang").agg(F.min("doc_id").alias("first_id"))
    return d.where("n >= 80").join(firsts, ["key", "lang"]).where("doc_id <> first_id").select("doc_id", "first_id")


_PII_SQL = ", ".join(f"len(regexp_extract_all(text, '{p}'))::INT AS n_{k}" for k, p in C.PII.items())


@query(f"SELECT doc_id, {_PII_SQL} FROM documents")
def pii_flags(spark, sf_dir):
    """FLT10."""
    return _docs(spark, sf_dir).select("doc_id", *(C.matches(F.col("text"), p).alias(f"n_{k}") for k, p in C.PII.items()))


@query(f"""SELECT doc_id, len(w)::INT AS n_words, round(len(list_filter(w, lambda x: x IN ({_FRAME}))) / nullif(len(w), 0), 9) AS share,
  round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z\\x80-\\x{{10FFFF}}]', '', 'g')), 0), 9) AS latin
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def doc_language_share(spark, sf_dir):
    """WIN03: the share of English function words, and of ASCII among all letters."""
    d = _docs(spark, sf_dir).select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w"))
    letters = F.regexp_count("text", F.lit("[A-Za-z]")) / F.nullif(F.regexp_count("text", F.lit(r"[A-Za-z\x{80}-\x{10FFFF}]")), F.lit(0))
    return d.select("doc_id", F.size("w").alias("n_words"), F.round(C.function_share(F.col("w")), 9).alias("share"), F.round(letters, 9).alias("latin"))


@query(f"""SELECT doc_id, regexp_matches(text, '{C.SUPERLATIVE}') OR regexp_matches(text, '{C.VAGUE}') OR regexp_matches(text, '{C.DEFINITION}') OR regexp_matches(text, '{C.STATISTIC}') AS x FROM documents""")
def citation_triggers(spark, sf_dir):
    """FLT08: whether a document makes statements that ask for a source."""
    return _docs(spark, sf_dir).select("doc_id", (F.size(C.triggers(F.col("text"))) > 0).alias("x"))


@query("""SELECT count(*) AS n_rows, count(text) AS n_text, count(nullif(lang, '')) AS n_lang, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
  round(stddev_samp(n_chars), 6) AS std, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents""")
def field_availability(spark, sf_dir):
    """AGG04."""
    n = F.col("n_chars")
    return _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_text"), F.count(F.nullif("lang", F.lit(""))).alias("n_lang"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.percentile(n, 0.5).alias("median"), (F.percentile(n, 0.75) - F.percentile(n, 0.25)).alias("iqr"))


@query("""WITH s AS (SELECT doc_id, length(x) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]')) AS x FROM documents)), r AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, count(*) OVER (PARTITION BY doc_id) AS c, sum(n) OVER (PARTITION BY doc_id) AS t, max(n) OVER (PARTITION BY doc_id) AS m FROM s)
SELECT doc_id, n AS median, m AS longest, (n > 400 OR (c >= 10 AND m >= 800 AND m / nullif(t, 0) > 0.2)) AS suspect FROM r WHERE k = c // 2 + 1""")
def sentence_split_health(spark, sf_dir):
    """WIN02: the upper median length of a document's sentences, and whether the split looks broken."""
    s = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[.!?]")).alias("x")).select("doc_id", F.length("x").cast("long").alias("n"))
    by = W.partitionBy("doc_id")
    r = s.select("doc_id", "n", F.row_number().over(by.orderBy("n")).alias("k"), F.count(F.lit(1)).over(by).alias("c"), F.sum("n").over(by).alias("t"), F.max("n").over(by).alias("m"))
    suspect = (F.col("n") > 400) | ((F.col("c") >= 10) & (F.col("m") >= 800) & (F.col("m") / F.nullif("t", F.lit(0)) > 0.2))
    return r.where("k = c div 2 + 1").select("doc_id", F.col("n").alias("median"), F.col("m").alias("longest"), F.coalesce(suspect, F.lit(False)).alias("suspect"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\b(?:is|are|was|were) [a-z]+ed\\b'))::INT AS passives,
  len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: len(regexp_extract_all(s, '[^\\x09-\\x0D\\x20]+')) > 25))::INT AS long_sentences FROM documents""")
def style_findings(spark, sf_dir):
    """FLT12, FLT13: passive phrases and sentences above 25 words."""
    long_ = F.filter(F.split("text", "[.!?]"), lambda s: F.regexp_count(s, F.lit(r"[^\x09-\x0D\x20]+")) > 25)
    return _docs(spark, sf_dir).select("doc_id", C.matches(F.col("text"), r"\b(?:is|are|was|were) [a-z]+ed\b").alias("passives"), F.size(long_).alias("long_sentences"))


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[^\n]*$|\z)', '', 'g') AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
h AS (SELECT doc_id, regexp_extract_all(line, '{C.OVERCLAIM}', 1) AS hits, string_split_regex(line, '{C.OVERCLAIM}') AS parts FROM l WHERE regexp_matches(line, '{C.OVERCLAIM}')), k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM h),
b AS (SELECT doc_id, right(array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN i > 1 THEN hits[i - 1] ELSE '' END || parts[i]), ''), 30) AS before FROM k)
SELECT doc_id, count(*) AS n_lines, (SELECT count(*) FROM b WHERE b.doc_id = l.doc_id AND NOT regexp_matches(before, '{A2.NEGATION.replace("'", "''")}')) AS overclaims FROM l GROUP BY doc_id""")
def overclaim_lines(spark, sf_dir):
    """FLT09: overclaims of a document that no negation stands before within 30 characters, each judged by itself."""
    d = _docs(spark, sf_dir)
    found = A2.claim_findings(d, forbidden=C.OVERCLAIM).where("kind = 'FORBIDDEN'").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    lines = d.select("doc_id", F.size(F.split(A2.without_code(F.coalesce("text", F.lit(""))), "\n")).cast("long").alias("n_lines"))
    return lines.join(found, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n", F.lit(0).cast("long")).alias("overclaims"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\d+'))::INT AS n, len(list_distinct(regexp_extract_all(text, '\\d+')))::INT AS n_different, coalesce(list_max(list_transform(regexp_extract_all(text, '\\d+'), lambda x: length(x))), 0)::INT AS longest FROM documents""")
def numbers_in_text(spark, sf_dir):
    """SCA06: the whole numbers of each document."""
    d = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(r"(\d+)")).alias("f"))
    return d.select("doc_id", F.size("f").alias("n"), F.size(F.array_distinct("f")).alias("n_different"), F.coalesce(F.array_max(F.transform("f", F.length)), F.lit(0)).alias("longest"))


@query("SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', ''), '') AS host FROM pages")
def page_registrable_host(spark, sf_dir):
    """SRC19."""
    return table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>', 1) AS levels, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]', 1) AS titles FROM pages)
SELECT page_id, generate_subscripts(titles, 1)::INT - 1 AS pos, unnest(titles) AS title FROM h""")
def page_outline(spark, sf_dir):
    """SRC06: the headings of a page, in order."""
    titles = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(titles).alias("pos", "title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|noscript|svg|math|head)\b.*?</(script|style|noscript|svg|math|head)[\x09-\x0D\x20]*>', ' ', 'g'), '(?is)<table\b.*?</table[\x09-\x0D\x20]*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?(p|div|section|article|li|ul|ol|h[1-6]|br|tr|blockquote|header|footer|nav|main)\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(x, '[ \t\r\x0B\f]+', ' ', 'g'), ' ?\n[\n ]*', chr(10) || chr(10), 'g') AS x FROM c)
SELECT page_id, regexp_replace(regexp_replace(x, '^[\n ]+|[\n ]+$', '', 'g'), ' ([.,;:!?])', '\1', 'g') AS body FROM d""")
def html_to_text(spark, sf_dir):
    """SRC05."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("""SELECT page_id, CASE WHEN length(html) < 200 THEN 'short' WHEN regexp_matches(html, '(?i)captcha|access denied|are you a robot|enable javascript') THEN 'botwall' WHEN NOT regexp_matches(html, '(?i)<body') THEN 'shape' ELSE 'ok' END AS status FROM pages""")
def response_shape(spark, sf_dir):
    """FLT16: which pages are what was asked for."""
    h = F.col("html")
    status = F.when(F.length(h) < 200, "short").when(h.rlike("(?i)captcha|access denied|are you a robot|enable javascript"), "botwall").when(~h.rlike("(?i)<body"), "shape").otherwise("ok")
    return table(spark, sf_dir, "pages").select("page_id", status.alias("status"))


_RATED = """r AS (SELECT l.doc_id, quality = 1 AS actual, n_chars >= 1000 AS predicted, CASE WHEN quality = 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS a,
  CASE WHEN n_chars >= 1000 THEN 'INCLUDE' WHEN n_chars >= 300 THEN 'UNCERTAIN' ELSE 'EXCLUDE' END AS b, n_chars FROM labels l JOIN documents USING (doc_id))"""


def _rated(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").select("doc_id", (F.col("quality") == 1).alias("actual"), (n >= 1000).alias("predicted"), F.when(F.col("quality") == 1, "INCLUDE").otherwise("EXCLUDE").alias("a"), F.when(n >= 1000, "INCLUDE").when(n >= 300, "UNCERTAIN").otherwise("EXCLUDE").alias("b"), "n_chars")


_WILSON = """greatest((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 0) AS low,
  least((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 1) AS high"""


@query(f"""WITH {_RATED}, c AS (SELECT count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND NOT predicted) AS tn, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn FROM r),
m AS (SELECT 'accuracy' AS metric, tp + tn AS k, tp + tn + fp + fn AS n FROM c UNION ALL SELECT 'sensitivity', tp, tp + fn FROM c UNION ALL SELECT 'specificity', tn, tn + fp FROM c UNION ALL SELECT 'precision', tp, tp + fp FROM c)
SELECT metric, k, n, round(value, 9) AS value, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT metric, k, n, k / n AS value, {_WILSON} FROM (SELECT metric, k, n::DOUBLE AS n FROM m))""".replace("SELECT metric, k, n, round(value", "SELECT metric, k, n::BIGINT AS n, round(value"))
def label_confusion_wilson(spark, sf_dir):
    """AGG16, STA13."""
    out = A.binary_metrics(_rated(spark, sf_dir), F.col("actual"), F.col("predicted"))
    return out.select("metric", "k", "n", *(F.round(c, 9).alias(c) for c in ("value", "low", "high")))


@query(f"""WITH {_RATED}, c AS (SELECT unnest(['EXCLUDE', 'INCLUDE', 'UNCERTAIN']) AS class), t AS (SELECT class, count(*) FILTER (a = class AND b = class) AS tp, count(*) FILTER (a <> class AND b = class) AS fp, count(*) FILTER (a = class AND b <> class) AS fn FROM r, c GROUP BY class)
SELECT class, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM t""")
def label_class_metrics(spark, sf_dir):
    """AGG16, one against the rest."""
    out = A.class_metrics(_rated(spark, sf_dir), "a", "b")
    return out.select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_RATED}, t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM r), p AS (SELECT sum(x.c * y.c) / (SELECT n * n FROM t) AS pe FROM (SELECT a AS k, count(*) AS c FROM r GROUP BY a) x JOIN (SELECT b AS k, count(*) AS c FROM r GROUP BY b) y USING (k))
SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa, round(2 * po - 1, 9) AS pabak FROM t, p""")
def label_agreement_kappa(spark, sf_dir):
    """AGG17."""
    return A.kappa(_rated(spark, sf_dir), "a", "b").select("n", *(F.round(c, 9).alias(c) for c in ("po", "pe", "kappa", "pabak")))


@query(f"""WITH {_RATED}, p AS (SELECT n_chars FROM r WHERE actual), q AS (SELECT n_chars FROM r WHERE NOT actual)
SELECT (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM q) AS n_neg, round(avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0.0 END), 9) AS auc FROM p, q""")
def score_auc_midrank(spark, sf_dir):
    """AGG18."""
    return A.auc(_rated(spark, sf_dir), "n_chars", "actual").withColumn("auc", F.round("auc", 9))


@query(f"""WITH {_RATED}, t AS (SELECT DISTINCT n_chars AS threshold FROM r), x AS (SELECT threshold, count(*) FILTER (actual AND n_chars >= threshold) / (SELECT count(*) FROM r WHERE actual) AS sensitivity, count(*) FILTER (NOT actual AND n_chars >= threshold) / (SELECT count(*) FROM r WHERE NOT actual) AS fpr FROM t, r GROUP BY threshold)
SELECT threshold, round(sensitivity, 9) AS sensitivity, round(fpr, 9) AS fpr FROM x WHERE fpr <= 0.05 ORDER BY sensitivity DESC, threshold DESC LIMIT 1""")
def score_operating_point(spark, sf_dir):
    """AGG18."""
    return A.operating_point(_rated(spark, sf_dir), "n_chars", "actual").select("threshold", F.round("sensitivity", 9).alias("sensitivity"), F.round("fpr", 9).alias("fpr"))


@query()
def score_auc_bootstrap(spark, sf_dir):
    """AGG19: resamples are drawn by hash, so there is no SQL; a test holds the bounds against numpy's."""
    return A.bootstrap_auc(_rated(spark, sf_dir), "n_chars", "actual")


@query(f"""WITH {_RATED}, x AS (SELECT n_chars, actual, doc_id % 2 AS fold FROM r), p AS (SELECT fold, n_chars FROM x WHERE actual), q AS (SELECT fold, n_chars FROM x WHERE NOT actual)
SELECT p.fold, round(avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0.0 END), 9) AS auc FROM p JOIN q USING (fold) GROUP BY p.fold""")
def score_auc_folds(spark, sf_dir):
    """AGG18, cross-validated over two folds."""
    r = _rated(spark, sf_dir)
    folds = [A.auc(r.where(F.col("doc_id") % 2 == k), "n_chars", "actual").select(F.lit(k).cast("long").alias("fold"), F.round("auc", 9).alias("auc")) for k in (0, 1)]
    return folds[0].unionByName(folds[1])


@query("""SELECT doc_id, position('10.' IN text) > 0 AS has_doi, len(list_distinct(regexp_extract_all(lower(text), '10\\.\\d{4,9}/[^\\x09-\\x0D\\x20"<>]+')))::INT AS n_dois FROM documents""")
def identifiers_in_text(spark, sf_dir):
    """SCA09, SRC11."""
    return _docs(spark, sf_dir).select("doc_id", F.contains("text", F.lit("10.")).alias("has_doi"), F.size(T.find_dois(F.col("text"))).alias("n_dois"))

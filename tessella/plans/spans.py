"""Numeric statements of documents, and what they share with annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import spans as S
from tessella.plans.registry import query, table


def _places(text: str, pattern: str) -> str:
    """[{start, raw}] of a pattern's matches: the lengths of what splits and of what is split off add up."""
    quoted = pattern.replace("'", "''")
    return f"""(SELECT list_transform(range(1, len(f) + 1), lambda i: {{'s': (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::INT, 'raw': f[i]}})
  FROM (SELECT string_split_regex({text}, '{quoted}') AS s, regexp_extract_all({text}, '{quoted}') AS f))"""


def _masked(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""(SELECT array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(regexp_replace(f[i], '[0-9]', ' ', 'g'), '')), '') FROM (SELECT string_split_regex({text}, '{quoted}') AS s, regexp_extract_all({text}, '{quoted}') AS f))"""


def _sql(name: str, key: str, text: str, last: str | None = None) -> str:
    """Matches of each kind by offsets, then a fold over all of them in the order of ownership. What may not stand before is matched and cut off again."""
    kinds = []
    for i, (kind, pattern, apart, *_, case) in enumerate(S.KINDS):
        whole = ("" if case else "(?i)") + (rf"(?:^|[^\pL\pN_.])(?:{pattern})" if apart else pattern)
        lead = r"CASE WHEN regexp_matches(x.raw, '^[0-9]') THEN 0 ELSE 1 END" if apart else "0"
        kinds.append(f"list_transform({_places('t', whole)}, lambda x: {{'rank': {i}, 'kind': '{kind}', 'start': x.s + {lead}, 'raw': substr(x.raw, 1 + {lead})}})")
    label = r"regexp_extract(z.raw, '^(.*?)[\s):=,]*[-+−–]?[0-9]+(?:[.,][0-9]+)?$', 1)"
    core = f"regexp_replace({label}, '^[aA](.)', '\\1')"
    value = r"coalesce(try_cast(replace(regexp_extract(z.raw, '([0-9]+(?:[.,][0-9]+)?)$', 1), ',', '.') AS DOUBLE), 0)"
    upper = ", ".join(f"'{x}'" for x in sorted(S.UPPER_CASE_ONLY))
    guard = f"(z.kind <> 'measure' OR NOT ((upper({core}) IN ({upper}) AND {core} <> upper({core})) OR substr(t, z.start + 1 + length(z.raw), 1) = '%' OR {value} >= {S.LARGEST_MEASURE}))"
    return f"""WITH m AS (SELECT {key} AS doc_id, {_masked(text, S.VERSION)} AS t FROM {name} WHERE regexp_matches({text}, '[0-9]')), n AS MATERIALIZED (SELECT doc_id, {_masked("t", "(?i)" + S.STRUCTURE)} AS t FROM m),
c AS MATERIALIZED (SELECT doc_id, t, list_concat({", ".join(kinds)}) AS q FROM n),
g AS (SELECT doc_id, list_filter(q, lambda z: {guard}) AS q FROM c),
o AS (SELECT doc_id, list_reduce(list_transform(q, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda o: x[1].start < o.start + length(o.raw) AND o.start < x[1].start + length(x[1].raw))) > 0 THEN a ELSE list_concat(a, x) END) AS q FROM g WHERE len(q) > 0),
r AS (SELECT doc_id, x.kind AS kind, x.raw AS raw, x.start AS start, x.start + length(x.raw) AS stop FROM (SELECT doc_id, unnest(q) AS x FROM o))
{last or f' SELECT doc_id AS {key}, kind, raw, start, stop AS "end" FROM r'}"""


@query(_sql("documents", "doc_id", "text"))
def document_quantities(spark, sf_dir):
    """SCA05: the numeric statements of whole documents with their offsets; an earlier kind owns its span."""
    return S.quantity_spans(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "kind", "raw", "start", "end")


@query(_sql("pages", "page_id", "html"))
def page_quantities(spark, sf_dir):
    """SCA05: the same over the source of pages."""
    return S.quantity_spans(table(spark, sf_dir, "pages"), ["page_id"], "html").select("page_id", "kind", "raw", "start", "end")


#: A line item as a sentence with all kinds of numbers, labels and words that only look like some.
_SENTENCE = [
    "In ", "1990 + l_suppkey % 40", ", HR ", "l_quantity / 10", " (95% CI 0.", "10 + l_linenumber", " to ", "l_linenumber", ".5), p < 0.0", "l_linenumber", "; of n = ", "l_orderkey % 900", " some ", "l_linenumber", "/", "10 + l_suppkey % 90", " (", "l_suppkey % 100",
    ".5%) took ", "l_partkey % 60", " mg for 6 or ", "l_linenumber", " weeks, see Figure ", "l_linenumber", " and ICD-", "l_linenumber", "; OR 95% CI, MD ", "20000 + l_orderkey", ", 10-", "20 + l_linenumber", "% and 1,", "100 + l_suppkey % 800", " or 0,", "10 + l_linenumber", ".",
]
_TEXT = " || ".join(f"'{x}'" if i % 2 == 0 else f"(floor({x})::BIGINT)" for i, x in enumerate(_SENTENCE))


@query(_sql("(SELECT l_orderkey * 10 + l_linenumber AS line_id, " + _TEXT + " AS text FROM lineitem) lines", "line_id", "text", """ SELECT doc_id AS line_id, count(*) AS n, string_agg(kind || ':' || raw || '@' || start, '|' ORDER BY start, kind || ':' || raw || '@' || start) AS q FROM r GROUP BY doc_id"""))
def line_quantities(spark, sf_dir):
    """SCA05: every kind in a sentence written from each line's own numbers."""
    text = F.concat(*(F.lit(x) if i % 2 == 0 else F.floor(F.expr(x)).cast("string") for i, x in enumerate(_SENTENCE)))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return S.quantity_notes(lines, "line_id", text)


@query(_sql("documents", "doc_id", "text", """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, length(x) AS n FROM l)
SELECT r.doc_id, r.kind, r.raw, s.line, (greatest(r.start, s.low) - s.low)::INT AS "from", (least(r.stop, s.low + s.n) - s.low)::INT AS "to" FROM r JOIN s ON r.doc_id = s.doc_id AND r.start < s.low + s.n AND s.low < r.stop"""))
def document_annotations(spark, sf_dir):
    """SRC20: annotations (here the numeric statements) with the line that each lies in, and where in it."""
    docs = table(spark, sf_dir, "documents")
    both = S.overlaps(S.quantity_spans(docs, ["doc_id"]), S.line_spans(docs, ["doc_id"]), ["doc_id"])
    return both.select("doc_id", "kind", "raw", "line", (F.col("from") - F.col("start_right")).alias("from"), (F.col("to") - F.col("start_right")).alias("to"))

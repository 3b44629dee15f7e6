"""Wording and numbers of manuscripts over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import manuscript as M
from tessella.operators.controlled import _IN, _S
from tessella.plans.registry import query, table

#: What is added to the texts, so that every code has cases: by doc_id % 6.
ADDED = [
    "\nTea causes sleep. Dr. B saw patient AB12, born on a Monday. It is unprecedented and always works.\n```\nTea causes sleep, 7/0 (5%).\n```\nTea may cause sleep. Causes of tea; the cause of it.",
    "\nOf all, 5/40 (12.5%) and 7/40 (12%), 9/4 (225%); 50% (2/4), 51 % (2 / 4).\nHR 0.80 (95% CI 0.70 to 0.91), 2.0 (95% CI: 0.7-0.9), 1.5, 95% CI 1.9 to 1.1.\n| 7/0 (5%) |",
    "\nGlucose was 90 mg/dL, then 5 mmol/l. It led to a miracle, which resulted in a paradigm shift. Call 555-123-4567 or a.b@c.org.",
    "\nHazard ratio 0.8 and 12% [claim:C001].\naHR of 0.9, 13% [claim:C000] [claim:C001]\nOR 2 [claim:C002]. Odds ratio: 2 in 4% [claim:C002]; 1/0 (3%)",
    "\n" + " ".join(["tea"] * 56) + ". Led to of it; causing of causing tea.",
    "",
]


def _q(text: str) -> str:
    return text.replace("'", "''")


_TEXT = "coalesce(text, '') || CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{_q(t)}'" for i, t in enumerate(ADDED)) + " ELSE '' END"
_trim = lambda x: rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_LINES = rf"""d AS (SELECT doc_id AS id, {_TEXT} AS text FROM documents),
r AS (SELECT id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT id, string_split_regex(text, '\r\n|\r|\n') AS x FROM d)),
f AS (SELECT *, starts_with({_trim("line")}, '```') AS fence FROM r),
l AS (SELECT id, line_no, line FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY id ORDER BY line_no) AS n FROM f) WHERE NOT fence AND n % 2 = 0)"""
_CODES = " UNION ALL ".join(f"SELECT id, line_no, '{k}' AS code FROM l WHERE regexp_matches(line, '{_q(p)}')" for k, p in {**M.PERSONAL, **M.WORDING}.items())


def _docs(spark, sf_dir):
    k = F.col("doc_id") % len(ADDED)
    added = F.coalesce(*(F.when(k == i, F.lit(t)) for i, t in enumerate(ADDED)), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("text"))


@query(rf"""WITH {_LINES}, v AS (SELECT *, regexp_replace(regexp_replace(line, '([^{_IN}])', '\1\1', 'g'), '(?i)({M._B})(?:{M.CAUSE}){_S}+of({M._E})', '\1\2', 'g') AS verbs FROM l)
SELECT id, line_no::INT AS line_no, code FROM ({_CODES}
  UNION ALL SELECT id, line_no, 'CAUSAL_CLAIM_WITHOUT_HEDGE' FROM v WHERE regexp_matches(verbs, '(?i){M._B}(?:{M.CAUSE}){M._E}') AND NOT regexp_matches(line, '{M.NOUN_CAUSE}') AND NOT list_bool_or([contains(lower(line), h) FOR h IN {M.HEDGES}])
  UNION ALL SELECT DISTINCT id, line_no, 'VERY_LONG_SENTENCE' FROM (SELECT id, line_no, unnest(string_split(regexp_replace({_trim("line")}, '([.!?]){_S}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM l) WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) > {M.LONG_SENTENCE})""")
def document_line_issues(spark, sf_dir):
    """FLT10: personal data, claims, absolutes, causes without a hedge, long sentences."""
    return M.line_issues(_docs(spark, sf_dir))


def _numbers(pattern: str, order: str) -> str:
    a, b, c = (rf"replace(regexp_extract(m, '{pattern}', {g}), ',', '')::DOUBLE" for g in order)
    return rf"SELECT id, line_no, m, {a} AS a, {b} AS b, {c} AS c FROM (SELECT id, line_no, unnest(regexp_extract_all(line, '{pattern}')) AS m FROM s)"


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EFFECTS.items())
_MIXED = " UNION ALL ".join(f"SELECT id, 0, 'mixed units', '{a} and {b}' FROM d WHERE contains(lower(text), '{a.lower()}') AND contains(lower(text), '{b.lower()}')" for a, b in M.UNIT_PAIRS)


@query(rf"""WITH {_LINES}, s AS (SELECT * FROM l WHERE NOT regexp_matches({_trim("line")}, '^[#|]')),
n AS ({_numbers(M.FRACTION, "123")} UNION ALL {_numbers(M.REVERSED, "231")}), i AS ({_numbers(M.INTERVAL, "123")} UNION ALL {_numbers(M.BARE, "123")}),
k AS (SELECT id, line, regexp_extract_all(line, '{M.CLAIM}', 1)[-1] AS claim FROM s WHERE regexp_matches(line, '{M.CLAIM}')),
e AS (SELECT id, claim, CASE lower(regexp_extract(m, '{M.EFFECT}', 1)) {_NAMES} END AS effect, regexp_extract(m, '{M.EFFECT}', 2) AS v FROM (SELECT id, claim, unnest(regexp_extract_all(line, '{M.EFFECT}')) AS m FROM k)),
p AS (SELECT id, claim, unnest(regexp_extract_all(line, '{M.PERCENT}', 1)) AS v FROM k),
x AS (SELECT id, line_no, CASE WHEN b = 0 THEN 'zero denominator' WHEN a > b THEN 'numerator above denominator' WHEN c > 100 THEN 'above 100 percent' WHEN abs(100 * a / b - c) > 0.6 THEN 'percent differs' END AS code, m AS detail FROM n
  UNION ALL SELECT id, line_no, CASE WHEN b > c THEN 'bounds inverted' WHEN a < b OR a > c THEN 'estimate outside' END, m FROM i
  UNION ALL SELECT id, line_no, 'above 100 percent', v FROM (SELECT id, line_no, unnest(regexp_extract_all(line, '{M.PERCENT}', 1)) AS v FROM s) WHERE v::DOUBLE > 100
  UNION ALL {_MIXED}
  UNION ALL SELECT id, 0, 'effect differs within claim', claim || ' ' || effect FROM e GROUP BY id, claim, effect HAVING count(DISTINCT v) > 1
  UNION ALL SELECT id, 0, 'several percentages in claim', claim FROM p GROUP BY id, claim HAVING count(DISTINCT v) > 1)
SELECT id, line_no::INT AS line_no, code, detail FROM x WHERE code IS NOT NULL""")
def document_number_issues(spark, sf_dir):
    """SCA07: fractions, intervals, percentages, units and effects of claims."""
    return M.number_issues(_docs(spark, sf_dir))

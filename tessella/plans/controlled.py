"""Controlled English over whole texts, line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import controlled as C
from tessella.plans.registry import query, table

#: What is added to the texts, which are plain words, so that every rule has cases: by doc_id % 8.
ADDED = [
    "\n\nRun the tool, then check the file. It's running and was quickly checked by the XQZ team.\n<!-- ste-allow R4, R6: a quote -->\nIt's known that it was checked. It's written that it was checked.",
    "\n\nThe PQR (Plain Query Report) of RST tells of RST.\n\n<!-- ste-allow R8: a name -->\nThe MNO tells of MNO. In order to utilize it, prior to use, e.g. a cup.",
    "\n```\nIt's running, isn't it? Utilize it.\n```\n| It's | a row |\n- Add build check and run all of it.\n- You MUST do it. A. B. C. D. E. F.",
    "\nThe ABX is old.\nABX (A Better Exchange) is new. We were sorting `it's` <!-- it's --> here. It was taken and was found and was given.",
    "\n\n<!-- ste-allow R9: the next line only -->\n\nLeverage it. Do it approximately, in the event that we're late; ascertain a number of things.",
    "\n\n# Heading that isn't read\n\nOpen the file;\nread it and\nwrite to it again, and again, and again, and again, and again, and again, and again, and again, and again.",
    "",
    "\n\n<!-- ste-allow R1 : none -->\n<!-- ste-allow R5, R6: both -->\nIt was being made, is running, was added.\nIt is running and was being removed.",
]


def _q(text: str) -> str:
    return text.replace("'", "''")


def _list(words) -> str:
    return "(" + ", ".join(f"'{_q(w)}'" for w in words) + ")"


_TEXT = "coalesce(text, '') || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{_q(t)}'" for i, t in enumerate(ADDED)) + " ELSE '' END"
_trim = lambda x: rf"regexp_replace({x}, '^{C._S}+|{C._S}+$', '', 'g')"
_verb = lambda x: f"({x} IN {_list(C.VERBS)} AND {x} NOT IN {_list(C.NO_INSTRUCTIONS)})"
_words = lambda x: rf"list_filter(regexp_extract_all({x}, '{C.RUN}'), lambda w: regexp_matches(w, '{C.ABBREVIATION}') AND w NOT IN {_list(C.CAPITALS)} AND w NOT IN {_list(C.ACRONYMS)})"
_TERMS = " UNION ALL ".join(f"SELECT id, line_no, 'R9' AS rule, '{t}' AS detail FROM s WHERE regexp_matches(doubled, '(?i){C._B}{t.replace(' ', '  ')}{C._E}')" for t in C.GLOSSARY)
SQL = rf"""WITH d AS (SELECT doc_id AS id, {_TEXT} AS text FROM documents),
r AS (SELECT id, generate_subscripts(x, 1) AS n, unnest(x) AS raw FROM (SELECT id, string_split_regex(text, '{C.LINE_END}') AS x FROM d)),
b AS (SELECT *, {_trim("raw")} AS bare FROM r),
m AS (SELECT *, starts_with(bare, '<!--') AS mark, bool_or(n = 1 AND bare = '---') OVER w AND n <= coalesce(min(n) FILTER (n > 1 AND bare = '---') OVER w, 1) AS meta FROM b WINDOW w AS (PARTITION BY id)),
f AS (SELECT *, NOT meta AND starts_with(bare, '```') AS fence FROM m),
g AS (SELECT *, sum(fence::INT) OVER w % 2 = 1 AS fenced, sum((NOT mark)::INT) OVER w + mark::INT AS target FROM f WINDOW w AS (PARTITION BY id ORDER BY n)),
k AS (SELECT id, target, unnest(regexp_extract_all(raw, '{C.MARK}{C._S}+([A-Z0-9, ]+):', 1)) AS told FROM g WHERE mark),
allows AS (SELECT DISTINCT g.id, g.n AS line_no, {_trim("rule")} AS rule FROM (SELECT id, target, unnest(string_split(told, ',')) AS rule FROM k) k JOIN g ON g.id = k.id AND g.target = k.target AND NOT g.mark),
l AS (SELECT id, n, CASE WHEN meta OR fence OR fenced OR regexp_matches(raw, '{C.TABLE_ROW}') OR regexp_matches(regexp_replace(raw, '`[^`]*`', 'code', 'g'), '{C.COMMENT}') THEN '' ELSE regexp_replace(regexp_replace(raw, '`[^`]*`', 'code', 'g'), '<!--.*?-->', '', 'g') END AS line FROM g),
a AS (SELECT *, sum(({_trim("line")} = '')::INT) OVER (PARTITION BY id ORDER BY n) AS block FROM l),
w AS (SELECT id, block, min(n) AS start, string_agg(regexp_replace(line, '{C.BULLET}', ''), chr(10) ORDER BY n) AS whole FROM a WHERE {_trim("line")} <> '' GROUP BY id, block),
p AS (SELECT id, block, start, generate_subscripts(x, 1) AS pos, unnest(x) AS piece FROM (SELECT id, block, start, string_split(regexp_replace(regexp_replace(whole, '(?i)({C._B})({C.PERIODS})[.]', '\1\2' || chr(2), 'g'), '([.!?]{C._S}+)', '\1' || chr(1), 'g'), chr(1)) AS x FROM w WHERE NOT starts_with({_trim("whole")}, '#'))),
o AS (SELECT id, block, start, start + coalesce(sum(len(regexp_extract_all(piece, '\n'))) OVER (PARTITION BY id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(regexp_extract_all(regexp_extract(piece, '^{C._S}*'), '\n')) AS line_no, replace(replace({_trim("piece")}, chr(2), '.'), chr(10), ' ') AS sentence FROM p),
t AS (SELECT id, block, start, line_no, sentence, regexp_extract_all(sentence, '{_q(C.TOKEN)}') AS tokens, regexp_replace(sentence, '([^{C._IN}])', '\1\1', 'g') AS doubled, regexp_matches(sentence, '{C.SEQUENCE}') AS sequence FROM o WHERE sentence <> ''),
v AS (SELECT *, len(tokens) > 0 AND (regexp_matches(sentence, '{C.ORDERED}') OR {_verb("lower(tokens[1])")}) AS told FROM t),
s AS (SELECT *, CASE WHEN told THEN len(list_filter(tokens, lambda w: {_verb("lower(w)")})) ELSE 0 END AS heads, lower(regexp_extract(doubled, '{_q(C.PROGRESSIVE)}', 1)) AS doing FROM v),
found AS (
  SELECT id, line_no, 'R1' AS rule, len(tokens)::VARCHAR AS detail FROM s WHERE len(tokens) > CASE WHEN told THEN 20 ELSE 25 END
  UNION ALL SELECT id, line_no, CASE WHEN sequence THEN 'R2' ELSE 'R10' END, heads::VARCHAR FROM s WHERE heads >= 3 OR heads = 2 AND sequence
  UNION ALL SELECT id, min(start), 'R3', count(*)::VARCHAR FROM s GROUP BY id, block HAVING count(*) > 6
  UNION ALL SELECT id, line_no, 'R4', '' FROM s WHERE regexp_matches(doubled, '{_q(C.CONTRACTION)}')
  UNION ALL SELECT id, line_no, 'R5', doing FROM s WHERE doing <> '' AND (doing[:-4] IN {_list(C.VERBS)} OR doing[:-4] || 'e' IN {_list(C.VERBS)} OR doing[:-5] IN {_list(C.VERBS)})
  UNION ALL SELECT id, line_no, 'R6', lower(x) FROM (SELECT id, line_no, unnest(regexp_extract_all(doubled, '{_q(C.PASSIVE)}', 1)) AS x FROM s) WHERE lower(x) NOT IN {_list(C.STATES)}
  UNION ALL {_TERMS}
  UNION ALL SELECT id, line_no, 'R8', x FROM (SELECT id, x, min(line_no) AS line_no FROM (SELECT id, line_no, unnest({_words("sentence")}) AS x FROM s) GROUP BY id, x) u
    LEFT JOIN (SELECT id, x, count(*) AS c FROM (SELECT id, unnest({_words("line")}) AS x FROM l) WHERE NOT regexp_matches(x, '[0-9]') GROUP BY id, x) n USING (id, x)
    LEFT JOIN (SELECT id, x, min(n) AS given FROM (SELECT id, n, unnest(regexp_extract_all(line, '{C.DEFINED[0]}', 1)) AS x FROM l UNION ALL SELECT id, n, unnest(regexp_extract_all(line, '{C.DEFINED[1]}', 1)) FROM l) GROUP BY id, x) e USING (id, x)
    WHERE CASE WHEN given IS NOT NULL THEN line_no < given ELSE c >= 2 END)
SELECT id, line_no::INT AS line_no, rule, detail FROM found ANTI JOIN allows USING (id, line_no, rule)"""


@query(SQL)
def document_line_rules(spark, sf_dir):
    """FLT12: nine rules by line (R7 is left out), with marks for the next line."""
    k = F.col("doc_id") % len(ADDED)
    added = F.coalesce(*(F.when(k == i, F.lit(t)) for i, t in enumerate(ADDED)), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("text"))
    return C.line_rules(docs)

"""Quality rules: a ledger of failure bits and measurements, to which versioned policies and ablations are applied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NOT_SPACE, SPACES, byte_class, documents, raw, slices, small_batches, word_hashes, words

SYMBOLS = b"#*$%&|<>"
#: Rule by rule, bit 0 first: its name and when it fails, over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > 2 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the bits of which none may be set.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_words"],
    "v1": BITS["few_words"] | BITS["repeated_words"] | BITS["symbols"] | BITS["repeated_lines"],
    "v2": sum(BITS.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(h: np.ndarray, n: int) -> int:
    """Words within 3-word windows, given by their hashes, that stand twice or more."""
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : j + len(h)] |= twice
    return int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol, step = byte_class(inside=SYMBOLS), np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        data, offsets = raw(batch.column(1))
        out = np.zeros((len(MEASURES), len(offsets) - 1), np.int64)
        for a, _, d, o in slices(data, offsets):
            starts, ends, counts = words(d, o, NOT_SPACE)
            points = np.zeros(len(d) + 1, np.int64)
            np.cumsum(NOT_SPACE[d] & ((d & 0xC0) != 0x80), out=points[1:])
            marks = np.zeros(len(d) + 1, np.int64)
            np.cumsum(symbol[d], out=marks[1:])
            h = word_hashes(d, starts, ends)
            windows = (((h[:-2] * step) + h[1:-1]) * step + h[2:]) * step if len(h) > 2 else np.zeros(0, np.uint64)
            at = 0
            for i, n in enumerate(counts.tolist()):
                lines = [x for x in d[o[i] : o[i + 1]].tobytes().split(b"\n") if x.strip(SPACES)]
                out[:, a + i] = n, points[o[i + 1]] - points[o[i]], marks[o[i + 1]] - marks[o[i]], len(lines), len(lines) - len(set(lines)), _repeated(windows[at : at + max(n - 2, 0)], n)
                at += n
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits: every rule is evaluated once, whatever policies come later.

    One pass over the whole texts without a shuffle. A null text has no words. Rows that repeat an id are rows of their own.
    """
    small_batches(docs.sparkSession)
    measured = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measured.withColumn("failed_bits", out.cast("long"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rules: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without): for each policy and rule of it, the documents that fail the rule, those that fail it alone, those kept, and those kept if the policy lacked it.

    The ledger is first counted by its bit patterns, so that what is exploded has one row for each pattern that occurs.
    """
    patterns = rules.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for p, mask in POLICIES.items() for r in BITS if mask & BITS[r])))
    seen = F.col("failed_bits").bitwiseAND(F.col("mask"))
    rows = patterns.withColumn("c", cases).select("n", "failed_bits", "c.*").withColumn("seen", seen)
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("policy", "rule").agg(count(F.col("seen").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("seen") == F.col("bit")).alias("n_only"), count(F.col("seen") == 0).alias("n_kept"), count(F.col("seen").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(documents(spark, sf_dir)).select("doc_id", *MEASURES, "failed_bits", (~passes("base")).alias("base_failed"), passes("v2").alias("kept"))


def llm_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(documents(spark, sf_dir)))


_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w),
t AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM t),
r AS (SELECT doc_id, greatest(twice, coalesce(lag(twice) OVER o, 0), coalesce(lag(twice, 2) OVER o, 0)) AS covered FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n_lines, 0) AS n_lines, coalesce(u.n_dup_lines, 0) AS n_dup_lines, coalesce(n.n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN n USING (doc_id)
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_symbols > 2 * n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed_bits FROM m
)
"""

SQL = {
    "op8_quality_rules": _LEDGER + "SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b",
    "llm_rule_ablations": _LEDGER
    + """, k AS (SELECT * FROM (VALUES ('base', 3), ('v1', 15), ('v2', 63)) AS v(policy, mask)),
q AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) AS v(rule, bit))
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits & mask = bit) AS n_only,
  count(*) FILTER (failed_bits & mask = 0) AS n_kept, count(*) FILTER (failed_bits & mask & ~bit = 0) AS n_kept_without
FROM b, k JOIN q ON k.mask & q.bit <> 0 GROUP BY policy, rule""",
}

"""Lines of manuscripts: personal data and wording (FLT10), reported numbers against each other (SCA07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.audits import lines_of
from tessella.operators.checks import fraction_ok, interval_ok
from tessella.operators.controlled import _B, _E, _IN, _S, trimmed

# What may name a patient.
PERSONAL = {
    "POSSIBLE_PHI_EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "POSSIBLE_PHI_PHONE": rf"{_B}(?:\+?[0-9]{{1,3}}[ -]?)?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ -][0-9]{{3}}[ -][0-9]{{4}}{_E}",
    "POSSIBLE_PHI_MRN": rf"(?i){_B}(?:MRN|medical record number|hospital number|accession number){_E}",
    "POSSIBLE_PHI_DOB": rf"(?i){_B}(?:date of birth|DOB|born on){_E}",
    "POSSIBLE_PHI_PATIENT_INITIALS": rf"{_B}(?:Mr|Mrs|Ms|Miss|Dr)\.?{_S}+[A-Z]{_E}",
    "POSSIBLE_PHI_NAMED_PATIENT": rf"{_B}patient{_S}+[A-Z]{{1,3}}[0-9]{{1,4}}{_E}",
}
# Wording that claims too much, allows no exception, or states a cause; hedges.
WORDING = {
    "OVERCLAIMING_LANGUAGE": rf"(?i){_B}(?:breakthrough|revolutionary|miracle|game[- ]chang[A-Za-z0-9_]+|cutting[- ]edge|unprecedented|paradigm shift|state[- ]of[- ]the[- ]art|miracle cure|dramatically (?:reduced|improved|cured)|cure[sd]? all|completely safe|no side effects|risk[- ]free|proves? that|cures? (?:cancer|the disease)){_E}",
    "ABSOLUTE_LANGUAGE": rf"(?i){_B}(?:always|never|invariably|in all patients|every patient|guarantee[sd]?|conclusively (?:proves|demonstrates)|definitively establishes){_E}",
}
CAUSE = "causes?|caused|causing|leads?  to|led  to|result(?:s|ed)  in|because  of  the  treatment"
NOUN_CAUSE = rf"(?i){_B}(?:leading|common|major|principal|main|underlying|possible|likely|only|no|a|the){_S}+causes?{_E}"
HEDGES = ["associated with", "may", "might", "suggests", "suggest", "appears", "possible", "potentially", "cannot", "did not", "no evidence"]
LONG_SENTENCE = 55
# Units of which one text should use one system; names of effects.
UNIT_PAIRS = [("mg/dL", "mmol/L"), ("ng/mL", "pmol/L"), ("ug/mL", "nmol/L"), ("mcg/mL", "nmol/L")]
EFFECTS = {"hazard ratio": "hr", "hr": "hr", "ahr": "hr", "odds ratio": "or", "or": "or", "aor": "or", "risk ratio": "rr", "rr": "rr", "arr": "rr", "irr": "irr"}

_N, _C = r"-?[0-9]+(?:\.[0-9]+)?", "[0-9][0-9,]*"
#: n/N (p%), and p% (n/N); the estimate with an interval in brackets, and without.
FRACTION = rf"({_C}){_S}*/{_S}*({_C}){_S}*\(([0-9]+(?:\.[0-9]+)?){_S}*%"
REVERSED = rf"([0-9]+(?:\.[0-9]+)?){_S}*%{_S}*\(({_C}){_S}*/{_S}*({_C})\)"
INTERVAL = rf"(?i)({_N}){_S}*\(9[0-9]%{_S}*(?:CI|confidence interval)[^0-9-]{{0,6}}({_N}){_S}*(?:to|and|[-–,]){_S}*({_N})\)"
BARE = rf"(?i)({_N}){_S}*[,;]?{_S}*(?:9[0-9]%{_S}*(?:CI|CrI|confidence interval)|CI){_S}*:?{_S}*({_N}){_S}*(?:to|and|[–-]){_S}*({_N})"
PERCENT = rf"([0-9]+(?:\.[0-9]+)?){_S}*%"
CLAIM = r"\[claim:(C[0-9]{3,8})\]"
EFFECT = rf"(?i){_B}(a?HR|a?OR|a?RR|IRR|hazard ratio|odds ratio|risk ratio)[^{_IN}][^0-9]{{0,23}}([0-9]+(?:\.[0-9]+)?)"


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with their numbers in the whole text, those of fenced code emptied."""
    lines = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r", "\n")
    fences = F.col("_n_before") % 2 == 1
    cut = lines_of(docs.select(F.col(id_col).alias("_id"), lines.alias("_text")), "_id", "_text")
    fence = trimmed(F.col("line")).startswith("```")
    state = cut.withColumn("_n_before", F.sum(F.when(fence, 1).otherwise(0)).over(W.partitionBy("id").orderBy("line_no")))
    return state.where(~fence & ~fences).select("id", "line_no", "line")


def line_issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, code): each code once a line, outside fenced code (FLT10).

    Personal data by PERSONAL; OVERCLAIMING_LANGUAGE, ABSOLUTE_LANGUAGE; CAUSAL_CLAIM_WITHOUT_HEDGE: a causal verb that "of" doesn't
    follow, in a line without a noun phrase of a cause and without a hedge; VERY_LONG_SENTENCE: more than 55 words. Null text is
    empty; ids are unique; other columns are ignored.
    """
    line = F.col("line")
    doubled = F.regexp_replace(line, rf"([^{_IN}])", "$1$1")
    verbs = F.regexp_replace(doubled, rf"(?i)({_B})(?:{CAUSE}){_S}+of({_E})", "$1$2")
    hedged = F.exists(F.array(*(F.lit(h) for h in HEDGES)), lambda h: F.contains(F.lower(line), h))
    causal = line.rlike("(?i)caus|lead|led|result") & verbs.rlike(rf"(?i){_B}(?:{CAUSE}){_E}") & ~line.rlike(NOUN_CAUSE) & ~hedged
    pieces = F.split(F.regexp_replace(trimmed(line), rf"([.!?]){_S}+", "$1\x01"), "\x01")
    long_ = F.exists(pieces, lambda s: F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")) > LONG_SENTENCE)
    codes = [F.when(line.rlike(p), F.lit(k)) for k, p in {**PERSONAL, **WORDING}.items()]
    codes += [F.when(causal, F.lit("CAUSAL_CLAIM_WITHOUT_HEDGE")), F.when(long_, F.lit("VERY_LONG_SENTENCE"))]
    return _kept(docs, id_col, text_col).select("id", "line_no", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("double")


def _groups(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """The three numbers of each match of a pattern, and the match."""
    whole = F.regexp_extract_all(text, F.lit(f"{'(?i)' if pattern.startswith('(?i)') else ''}({pattern.removeprefix('(?i)')})"), 1)
    return F.transform(whole, lambda m: F.struct(*(_number(F.regexp_extract(m, pattern, g)).alias(n) for n, g in zip("abc", order, strict=True)), m.alias("raw")))


def number_issues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", headings: bool = False) -> DataFrame:
    """(id, line_no, code, detail): reported numbers that contradict each other, outside fenced code (SCA07).

    A fraction with its percentage (either order), an interval with its estimate, what is wrong as `fraction_ok` and `interval_ok`
    say; "above 100 percent" for any percentage. Lines that begin with # or | count only with `headings`. By text, at line 0: "mixed
    units", both units of a pair; and for each claim marker (the last of a line): "effect differs within claim" for two values of one
    kind of effect (hazard, odds, risk or rate ratio under any of their names), "several percentages in claim". Null text is empty; ids are
    unique; other columns are ignored.
    """
    lines = _kept(docs, id_col, text_col)
    scanned = lines if headings else lines.where(~trimmed(F.col("line")).rlike(r"^[#|]"))
    fractions = F.concat(_groups(F.col("line"), FRACTION, (1, 2, 3)), _groups(F.col("line"), REVERSED, (2, 3, 1)))
    intervals = F.concat(_groups(F.col("line"), INTERVAL, (1, 2, 3)), _groups(F.col("line"), BARE, (1, 2, 3)))
    percents = F.filter(F.regexp_extract_all("line", F.lit(PERCENT), 1), lambda p: p.cast("double") > 100)
    told = F.concat(
        F.transform(fractions, lambda x: F.struct(fraction_ok(x["a"], F.when(x["b"] != 0, x["b"]).otherwise(0.0), x["c"]).alias("code"), x["raw"].alias("detail"))),
        F.transform(intervals, lambda x: F.struct(interval_ok(x["a"], x["b"], x["c"]).alias("code"), x["raw"].alias("detail"))),
        F.transform(percents, lambda p: F.struct(F.lit("above 100 percent").alias("code"), p.alias("detail"))),
    )
    here = scanned.where(F.col("line").rlike("[0-9]")).select("id", "line_no", F.explode(told).alias("x")).select("id", "line_no", "x.*").where("code IS NOT NULL")
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    mixed = docs.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*(F.when(F.contains(text, F.lit(a.lower())) & F.contains(text, F.lit(b.lower())), F.lit(f"{a} and {b}")) for a, b in UNIT_PAIRS)))).alias("detail")).select("id", F.lit(0).alias("line_no"), F.lit("mixed units").alias("code"), "detail")
    marked = scanned.where(F.col("line").rlike(CLAIM)).select("id", "line", F.element_at(F.regexp_extract_all("line", F.lit(CLAIM), 1), -1).alias("claim"))
    names = F.create_map(*(F.lit(x) for kv in EFFECTS.items() for x in kv))
    effects = marked.select("id", "claim", F.explode(F.regexp_extract_all("line", F.lit(f"(?i)({EFFECT.removeprefix('(?i)')})"), 1)).alias("m"))
    named = effects.select("id", "claim", names[F.lower(F.regexp_extract("m", EFFECT, 1))].alias("effect"), F.regexp_extract("m", EFFECT, 2).alias("v"))
    drift = named.groupBy("id", "claim", "effect").agg(F.count_distinct("v").alias("n")).where("n > 1").select("id", F.lit(0).alias("line_no"), F.lit("effect differs within claim").alias("code"), F.concat_ws(" ", "claim", "effect").alias("detail"))
    shares = marked.select("id", "claim", F.explode(F.regexp_extract_all("line", F.lit(PERCENT), 1)).alias("v")).groupBy("id", "claim").agg(F.count_distinct("v").alias("n")).where("n > 1").select("id", F.lit(0).alias("line_no"), F.lit("several percentages in claim").alias("code"), F.col("claim").alias("detail"))
    return here.unionByName(mixed).unionByName(drift).unionByName(shares)

"""Audits of text and tables: claims, controlled English, sections, normative wording, sheets, raters, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Claims that no measurement supports, results that need a bound, and the bounds (FLT09).
FORBIDDEN = r"(?i)(plagiari[sz]m[\x20\x09-\x0D-]?free|\berror[\x20\x09-\x0D-]?free\b|\bperfect(?:ly)?\b|\bmedical[\x20\x09-\x0D-]?grade\b|\bcertified?\b|\bclearance\b|\bguarantee[ds]?\b|\bflawless\b|\bbulletproof\b|\b100%[\x20\x09-\x0D]*(?:accurate|correct|reliable)\b)"
CLEAN = r"(?i)\bno (?:overlap|match(?:es)?|passage|finding)s? (?:was|were|is|are)? ?(?:found|detected|above)\b|\bclean report\b|\b0 findings\b|\ball checks? passed\b|\bnothing was flagged\b|\bno (?:defect|error)s? (?:was|were) found\b"
BOUND = r"(?i)against the sources? (?:checked|supplied|read)|not a clearance|cannot certify|does not cover|is not covered|known limitation|bounded by|on the (?:classes|set|cases) tested|measured on|input gap|could not be (?:read|checked|resolved)|not (?:a )?(?:claim|guarantee|proof)|limitations"
NEGATION = r"(?i)\b(?:not|no|never|without|cannot|can't|isn't|aren't|doesn't)\b[^.]{0,24}$"
#: Where a word begins and ends, in every regex dialect alike: no letter of any script stands there.
_B, _E = r"(?:^|[^A-Za-z0-9_\x80-\x{10FFFF}])", r"(?:[^A-Za-z0-9_\x80-\x{10FFFF}]|$)"
#: Contractions, progressive and passive forms (FLT12).
CONTRACTION = rf"(?i){_B}(?:don|doesn|isn|aren|wasn|weren|can|won|couldn|shouldn|wouldn|hasn|haven|hadn|mustn)['’]t{_E}|{_B}(?:it|that|there|we|you|he|she|they)['’](?:s|re|ve|ll){_E}"
PROGRESSIVE = rf"(?i){_B}(?:is|are|was|were|be|been) [a-z]+ing{_E}"
PASSIVE = rf"(?i){_B}(?:is|are|was|were|be|been) [a-z]+ed{_E}"
INSTRUCTION = rf"(?i)^(?:add|apply|ask|build|call|check|choose|compare|create|define|delete|do|download|enter|find|follow|give|include|install|keep|list|make|open|put|read|record|remove|repeat|report|run|save|search|select|send|set|show|start|stop|take|test|turn|use|verify|wait|write){_E}"
WORD = r"[^\x20\x09-\x0D]+"
#: Classes of wording that a rewrite must keep (SCA17, JOIN10).
NORMATIVE = {
    "exit_code": r"(?i)\b(?:exit|exits|rc|return code)[\x20\x09-\x0D]*=?[\x20\x09-\x0D]*([0-9])\b",
    "flag": r"(?:^|[^A-Za-z0-9_-])(--[a-z][a-z0-9-]{1,30})",
    "tool": r"\b([a-z0-9-]+__[a-z0-9_]+)\b",
    "home_path": r"(~/[A-Za-z0-9._/-]+)",
    "file_name": r"\b([A-Za-z0-9_.-]+\.(?:py|sh|json|md|yml|yaml|csv|bib|txt|docx|pdf|html))\b",
    "number": r"(?i)(?:^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)?[\x20\x09-\x0D]*(?:%|words?|sentences?|seconds?|min|hours?|pages?|chars?|bytes?|KB|MB))",
    "check_id": r"\b([CHSRKDF][0-9]{1,2}[a-z]?)\b",
}
CLAUSE = rf"(?i){_B}(?:must not|must|shall not|shall|never|do not|don't|forbidden|refuses?|avoids?|prohibited|required){_E}"
PROHIBITION, OBLIGATION = rf"(?i){_B}(?:must not|shall not|never|do not|don't|forbidden|refuses?|avoids?|prohibited){_E}", rf"(?i){_B}(?:must|shall)(?! not){_E}|{_B}required{_E}"


def without_code(text: Column) -> Column:
    """A text without fenced blocks (FLT09, SCA17)."""
    return F.regexp_replace(text, r"(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[^\n]*$|\z)", "")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line), from 1."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("p", "line")).select("id", (F.col("p") + 1).alias("line_no"), "line")


def claim_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forbidden: str = FORBIDDEN) -> DataFrame:
    """(id, line_no, kind, found): each claim of a line that no negation stands before within 30 characters, one by one; and UNBOUNDED once for a text with a clean result and no bound (FLT09)."""
    plain = docs.withColumn("_t", without_code(F.coalesce(F.col(text_col), F.lit(""))))
    lines = lines_of(plain, id_col, "_t")
    hits, parts = F.regexp_extract_all("line", F.lit(forbidden), 1), F.split("line", forbidden)
    one = lines.where(F.col("line").rlike(forbidden)).select("id", "line_no", hits.alias("hits"), parts.alias("parts")).select("id", "line_no", "hits", "parts", F.posexplode("hits").alias("k", "found"))
    before = F.array_join(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.concat(F.when(i > 0, F.get("hits", i - 1)).otherwise(F.lit("")), F.get("parts", i))), "")
    claims = one.withColumn("before", F.right(before, F.lit(30))).where(~F.col("before").rlike(NEGATION)).select("id", "line_no", F.lit("FORBIDDEN").alias("kind"), F.lower("found").alias("found"))
    unbounded = plain.where(F.col("_t").rlike(CLEAN) & ~F.col("_t").rlike(BOUND)).select(F.col(id_col).alias("id"), F.lit(0).alias("line_no"), F.lit("UNBOUNDED").alias("kind"), F.lit("").alias("found"))
    return claims.unionByName(unbounded)


def controlled_english(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, n): findings of controlled English by rule (FLT12).

    Sentences end at . ! or ? before white space; a paragraph at an empty line. long_instruction: more than 20 words in a sentence
    that begins with an instruction; long_sentence: more than 25 in another; long_paragraph: more than six sentences; contraction,
    progressive and passive: sentences with such a form.
    """
    paragraphs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n[\x20\x09-\x0D]*\n")).alias("p"))
    trim = lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    cut = paragraphs.select("id", F.filter(F.transform(F.split(F.regexp_replace("p", r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01"), trim), lambda s: s != "").alias("s"))
    n = lambda s: F.regexp_count(s, F.lit(WORD))
    rules = {
        "long_instruction": lambda s: s.rlike(INSTRUCTION) & (n(s) > 20),
        "long_sentence": lambda s: ~s.rlike(INSTRUCTION) & (n(s) > 25),
        "contraction": lambda s: s.rlike(CONTRACTION),
        "progressive": lambda s: s.rlike(PROGRESSIVE),
        "passive": lambda s: s.rlike(PASSIVE),
    }
    counts = [F.sum(F.size(F.filter("s", f))).alias(k) for k, f in rules.items()]
    wide = cut.groupBy("id").agg(*counts, F.count_if(F.size("s") > 6).alias("long_paragraph"))
    names = [*rules, "long_paragraph"]
    return wide.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("n")) for k in names))).alias("r")).select("id", "r.*").where("n > 0")


def section_audit(docs: DataFrame, required: list[str], declarations: dict[str, str], bare: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, issue, item) of markdown manuscripts (FLT17).

    missing_section: no heading has a required name; missing_declaration: the section of declarations lacks a pattern (only where
    there is such a section); citation_in_section: a [number] or (name, year) marker under a heading that must have none.
    """
    lines = lines_of(docs, id_col, text_col)
    heading = F.when(F.col("line").startswith("#"), F.lower(F.trim(F.regexp_replace("line", r"^#+", ""))))
    scoped = lines.withColumn("h", heading).withColumn("scope", F.last("h", ignorenulls=True).over(W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    heads = scoped.groupBy("id").agg(F.array_join(F.collect_set("h"), "\n").alias("all"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("h").isNull() & F.contains("scope", F.lit("declaration")), F.struct("line_no", "line")))).getField("line"), "\n").alias("block"), F.count_if(F.contains("h", F.lit("declaration"))).alias("declares"))
    missing = heads.select("id", F.explode(F.array_compact(F.array(*(F.when(~F.contains("all", F.lit(s)), F.lit(s)) for s in required)))).alias("item")).select("id", F.lit("missing_section").alias("issue"), "item")
    undeclared = heads.where("declares > 0").select("id", F.explode(F.array_compact(F.array(*(F.when(~F.col("block").rlike(p), F.lit(k)) for k, p in declarations.items())))).alias("item")).select("id", F.lit("missing_declaration").alias("issue"), "item")
    marker = r"\[\d+(?:[,;-]\s*\d+)*\]|\([A-Z][A-Za-z'-]+(?: et al\.?)?,? (?:19|20)\d{2}[a-z]?\)"
    cited = scoped.where(F.col("h").isNull() & F.col("scope").isin(bare) & F.col("line").rlike(marker)).select("id", F.lit("citation_in_section").alias("issue"), F.col("scope").alias("item")).distinct()
    return missing.unionByName(undeclared).unionByName(cited)


def significance_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kind): lines that speak of significance, each with the line after it if it doesn't end a sentence: with a p value, without, or a p value against the wording (WIN05)."""
    lines = lines_of(docs, id_col, text_col)
    follows = F.lead("line").over(W.partitionBy("id").orderBy("line_no"))
    open_ = ~F.col("line").rlike(r"[.!?][\"')\]]*[\x20\x09-\x0D]*$")
    joined = lines.withColumn("whole", F.when(open_, F.concat_ws(" ", "line", follows)).otherwise(F.col("line"))).where(F.lower("line").rlike(r"significan"))
    p = F.try_to_number(F.regexp_extract("whole", r"(?i)\bp[\x20]?[<=][\x20]?(0?\.[0-9]{1,6})", 1), F.lit("9.999999")).cast("double")
    negative = F.lower("whole").rlike(r"(?:not|no|non)[\x20-]?(?:statistically )?significan")
    kind = F.when(p.isNull(), "no p value").when(negative & (p < 0.05), "p below 0.05 called not significant").when(~negative & (p > 0.05), "p above 0.05 called significant").otherwise("ok")
    return joined.select("id", "line_no", kind.alias("kind"))


def host_parts(host: Column) -> Column:
    """struct(sld, tld, registrable) of a host: the last label, the one before, and both; for second-level names under a country (co, com, org, net, ac, gov, edu) three labels (SRC19)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    wide = (n > 2) & (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin("co", "com", "org", "net", "ac", "gov", "edu")
    tld = F.when(wide, F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1))).when(n > 1, F.get(labels, n - 1))
    sld = F.when(wide, F.get(labels, n - 3)).when(n > 1, F.get(labels, n - 2))
    return F.struct(sld.alias("sld"), tld.alias("tld"), F.coalesce(F.concat_ws(".", sld, tld), host).alias("registrable"))


def normative_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, token): exit codes, flags, tools, paths, file names, numbers with units, check ids, and clauses by the first 12 hex digits of the SHA-1 of their lower-case text, outside fenced code (SCA17)."""
    plain = docs.select(F.col(id_col).alias("id"), F.regexp_replace(without_code(F.coalesce(F.col(text_col), F.lit(""))), "`([^`\n]*)`", "$1").alias("t"))
    found = [F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(p), 1)), (lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("token")))(k)) for k, p in NORMATIVE.items()]
    norm = lambda s: F.trim(F.regexp_replace(s, r"[\x20\x09-\x0D]+", " "))
    clauses = F.filter(F.split(F.regexp_replace("t", r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01"), lambda s: s.rlike(CLAUSE))
    hashed = F.transform(F.array_distinct(F.transform(clauses, lambda s: F.lower(norm(s)))), lambda s: F.struct(F.lit("clause").alias("kind"), F.substring(F.sha1(s.cast("binary")), 1, 12).alias("token")))
    return plain.select("id", F.explode(F.concat(*found, hashed)).alias("r")).select("id", "r.*")


def lost_tokens(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, kind, token): what a rewrite has lost, clauses apart, which may be reworded (JOIN10)."""
    return before.where("kind <> 'clause'").join(after, ["id", "kind", "token"], "left_anti")


def modal_classes(text: Column) -> Column:
    """The kinds of rule that a text states: prohibition, obligation (SCA17)."""
    return F.array_compact(F.array(F.when(text.rlike(PROHIBITION), F.lit("prohibition")), F.when(text.rlike(OBLIGATION), F.lit("obligation"))))


def sheet_issues(rows: DataFrame, key: str, study: str, dependency: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(row, issue) of a coding or screening sheet (row, ...): blank and repeated keys, studies that repeat without a dependency group, and values outside a field's vocabulary (AGG13)."""
    k = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    n = rows.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n_key"))
    m = rows.groupBy(F.col(study).alias("s")).agg(F.count(F.lit(1)).alias("n_study"))
    j = rows.withColumn("k", k).join(n, "k").join(m, F.col(study).eqNullSafe(F.col("s")), "left")
    checks = [F.when(F.col("k") == "", F.lit("blank key")), F.when((F.col("k") != "") & (F.col("n_key") > 1), F.lit("repeated key")), F.when((F.col("n_study") > 1) & F.col(dependency).isNull(), F.lit("repeated study without dependency"))]
    checks += [F.when(~F.coalesce(F.col(f).isin(values), F.lit(False)), F.lit(f"unknown {f}")) for f, values in vocabulary.items()]
    return j.select("row", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def rater_table(pairs: DataFrame, a: str, b: str, collapse: dict[str, str], strata: list[str]) -> DataFrame:
    """(stratum, n, same, a_first, b_first, kappa) of two raters after collapsing categories, by stratum (AGG17).

    a_first counts rows where only a has the first category (in order), b_first those where only b has: the direction of
    disagreement. kappa is null where chance agreement is complete and actual isn't.
    """
    to = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in collapse.items() for x in kv)), F.col(c)), F.col(c))
    rows = pairs.select(*strata, to(a).alias("x"), to(b).alias("y"))
    first = min(set(collapse.values()))
    is_a, is_b = F.col("x") == first, F.col("y") == first
    g = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_a == is_b).alias("same"), F.count_if(is_a & ~is_b).alias("a_first"), F.count_if(is_b & ~is_a).alias("b_first"), F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"))
    po = F.col("same") / F.col("n")
    pe = (F.col("na") * F.col("nb") + (F.col("n") - F.col("na")) * (F.col("n") - F.col("nb"))) / (F.col("n") * F.col("n"))
    return g.select(*strata, "n", "same", "a_first", "b_first", F.when(pe < 1, (po - pe) / (1 - pe)).when(po >= 1, 1.0).alias("kappa"))


def distribution(df: DataFrame, value: Column, group: list[str] | None = None) -> DataFrame:
    """(count, missing, least, most, mean, std, median, iqr) of numbers to three places; infinite and non-numbers are missing (AGG04)."""
    v = value.cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    r = lambda x, n: F.round(x, 3).alias(n)
    return df.withColumn("_v", v).groupBy(*(group or [])).agg(F.count("_v").alias("count"), F.count_if(F.isnull("_v")).alias("missing"), r(F.min("_v"), "least"), r(F.max("_v"), "most"), r(F.avg("_v"), "mean"), r(F.stddev_samp("_v"), "std"), r(F.percentile("_v", 0.5), "median"), r(F.percentile("_v", 0.75) - F.percentile("_v", 0.25), "iqr"))


def batches(ids: DataFrame, key: str, size: int, group: list[str]) -> DataFrame:
    """ids with `batch`: chunks of at most `size` ids of each group, in the order of the id (STR06)."""
    return ids.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(key)) - 1) / size))


# The vocabularies of a source ledger (RUL02).
PUBLICATION_TYPES = "journal_article randomised_trial systematic_review meta_analysis review guideline consensus_statement cohort_study case_control_study cross_sectional_study case_report case_series editorial comment letter preprint conference_abstract registry_record book_chapter report other".split()
JOURNAL_TYPES = PUBLICATION_TYPES[:12]
VOCABULARIES = {
    "peer_reviewed": ["yes", "no", "unknown"],
    "verification_status": ["verified", "unverified", "failed"],
    "inclusion_status": ["included", "excluded", "pending", "cited_for_context"],
    "retraction_status": ["not_checked", "clear", "retracted", "expression_of_concern", "corrected"],
    "retrieval_status": ["returned", "empty", "unavailable", "error", "user_supplied"],
}
EXTRACTED = "study_design population intervention comparator n_participants follow_up key_outcomes main_finding effect_estimate theme".split()
PERSONAL = {
    "EMAIL": r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(com|org|net|edu|gov|io)",
    "MRN": r"(?i)\b(MRN|medical record number)\b",
    "DOB": r"(?i)\b(DOB|date of birth)\b",
    "PHONE": r"\b[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\b",
    "NHS_NPI": r"(?i)\b(NPI|NHS number)\b",
}


def source_issues(sources: DataFrame, today: str, strict: bool = False) -> DataFrame:
    """(source_id, code, severity, detail) of a source ledger's rows, each constraint a column expression (RUL02).

    A row whose id is no S and digits has that one issue. Columns that a ledger lacks count as blank. today is a date, which
    verified dates and years are held against. strict makes missing extraction fields errors.
    """
    has = set(sources.columns)
    raw = {n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) if n in has else F.lit("") for n in ["source_id", "title", "authors", "container", "year", "doi", "pmid", "pmcid", "publication_type", "verifier", "verified_date", "locator", "exclusion_reason", "pages", "volume", "issue", "notes", *VOCABULARIES, *EXTRACTED]}
    c = {n: F.lower(x) if n in VOCABULARIES else x for n, x in raw.items()}
    blank = lambda x: F.lower(x).isin("", "unknown", "na", "n/a", "-", "none", "tbd", "todo", "?")
    absent = lambda x: blank(x) | (F.lower(x).isin("not_reported", "not_applicable"))
    identified = ~absent(c["doi"]) | ~absent(c["pmid"]) | ~absent(c["pmcid"])
    status, inclusion, retraction, kind = c["verification_status"], c["inclusion_status"], c["retraction_status"], c["publication_type"]
    citable, verified, used = inclusion.isin("included", "cited_for_context"), status == "verified", (inclusion == "included") & (status == "verified")
    year, n, effect = F.try_to_number(c["year"], F.lit("9999")).cast("int"), F.regexp_replace(F.lower(c["n_participants"]), "[, ]", ""), F.lower(c["effect_estimate"])
    dated = c["verified_date"].rlike(r"^\d{4}-\d{2}-\d{2}$")
    given = lambda x: (x != "") & ~x.isin("not_reported", "not_applicable")
    rules = [
        ("MISSING_TITLE", "error", blank(c["title"])),
        ("MISSING_AUTHORS", "error", c["authors"] == ""),
        ("MISSING_CONTAINER", "error", c["container"] == ""),
        ("INVALID_YEAR", "error", ~c["year"].rlike(r"^\d{4}$")),
        ("YEAR_OUT_OF_RANGE", "error", c["year"].rlike(r"^\d{4}$") & ~year.between(1500, int(today[:4]) + 1)),
        ("MALFORMED_DOI", "error", ~absent(c["doi"]) & ~c["doi"].rlike(r"^(?i)(https?://(dx\.)?doi\.org/|doi:)?10\.\d{4,9}/\S+$")),
        ("MALFORMED_PMID", "error", ~absent(c["pmid"]) & ~c["pmid"].rlike(r"^\d{1,8}$")),
        ("MALFORMED_PMCID", "error", ~absent(c["pmcid"]) & ~c["pmcid"].rlike(r"^(?i)PMC\d+$")),
        ("INVALID_PUBLICATION_TYPE", "error", ~kind.isin(PUBLICATION_TYPES)),
        ("INVALID_PEER_REVIEWED", "error", ~c["peer_reviewed"].isin(VOCABULARIES["peer_reviewed"])),
        ("PEER_REVIEW_STATUS_UNKNOWN", "warning", c["peer_reviewed"] == "unknown"),
        *((f"INVALID_{f.upper()}", "error", ~c[f].isin(VOCABULARIES[f])) for f in VOCABULARIES if f != "peer_reviewed"),
        ("INCLUDED_WITHOUT_IDENTIFIER", "error", citable & ~identified),
        ("RETRIEVED_WITHOUT_IDENTIFIER", "warning", citable & ~identified & (c["retrieval_status"] == "returned")),
        ("VERIFIED_WITHOUT_VERIFIER", "error", verified & (c["verifier"] == "")),
        ("VERIFIED_WITHOUT_DATE", "error", verified & ~dated),
        ("VERIFIED_DATE_IN_FUTURE", "error", verified & dated & (c["verified_date"] > today)),
        ("VERIFIED_WITHOUT_LOCATOR", "error", verified & (c["locator"] == "")),
        ("VERIFIED_WITHOUT_IDENTIFIER", "error", verified & ~identified),
        ("UNVERIFIED_SOURCE_INCLUDED", "error", status.isin("unverified", "failed") & citable),
        ("RETRACTION_NOT_CHECKED", "warning", retraction == "not_checked"),
        ("RETRACTED_SOURCE_INCLUDED", "error", (retraction == "retracted") & citable),
        ("RETRACTED_RETAINED_FOR_CONTEXT", "info", (retraction == "retracted") & ~citable),
        ("EXPRESSION_OF_CONCERN", "warning", retraction == "expression_of_concern"),
        ("PREPRINT_INCLUDED_LABEL_REQUIRED", "warning", (kind == "preprint") & citable),
        ("ABSTRACT_INCLUDED_QUALIFY_IN_TEXT", "warning", (kind == "conference_abstract") & citable),
        ("EXCLUDED_WITHOUT_REASON", "error", (inclusion == "excluded") & (c["exclusion_reason"] == "")),
        ("PENDING_INCLUSION_DECISION", "warning", inclusion == "pending"),
        ("CONTEXT_CITATION_NOT_IN_EVIDENCE_BASE", "info", (inclusion == "cited_for_context") & verified),
        ("MISSING_PAGES_FOR_JOURNAL_ARTICLE", "warning", used & kind.isin(JOURNAL_TYPES) & F.lower(c["pages"]).isin("", "unknown", "na", "n/a", "-")),
        ("MISSING_VOLUME_AND_ISSUE", "warning", used & kind.isin(JOURNAL_TYPES) & absent(c["volume"]) & absent(c["issue"])),
        ("INVALID_N_PARTICIPANTS", "warning", used & given(n) & ~n.rlike(r"^\d+$")),
        ("EFFECT_ESTIMATE_WITHOUT_NUMBER", "warning", used & given(effect) & ~effect.rlike(r"\d")),
    ]
    told = [(code, severity, "", bad) for code, severity, bad in rules]
    told += [("MISSING_EXTRACTION_FIELD", "error" if strict else "warning", f, used & (c[f] == "")) for f in EXTRACTED]
    told += [("AMBIGUOUS_EXTRACTION_VALUE", "warning", f, used & F.lower(c[f]).isin("unknown", "na", "n/a", "-", "none")) for f in EXTRACTED]
    told += [(f"POSSIBLE_PHI_{code}", "error", f, c[f].rlike(p)) for f in ("title", "population", "key_outcomes", "notes", "main_finding") for code, p in PERSONAL.items()]
    issue = lambda code, severity, detail: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(detail).alias("detail"))
    fit = c["source_id"].rlike(r"^S\d{3,8}$")
    found = F.array_compact(F.array(F.when(~fit, issue("INVALID_SOURCE_ID", "error", "")), *(F.when(fit & bad, issue(code, severity, detail)) for code, severity, detail, bad in told)))
    return sources.select(c["source_id"].alias("source_id"), F.explode(found).alias("f")).select("source_id", "f.*")


def certainty_table(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(theme, n_sources, participants, certainty, directions, designs, caveats) of sources (source_id, theme, participants, direction, design) and claims (certainty, caveat, source_ids) (AGG08).

    participants adds up digits only, with thousands' commas; certainty is the highest of the claims that rest on a source of the
    theme; directions and designs are counts by value, in the order of the values; a blank theme is not_reported.
    """
    s = sources.withColumn("theme", F.coalesce(F.nullif(F.trim("theme"), F.lit("")), F.lit("not_reported")))
    n = F.try_to_number(F.replace(F.col("participants").cast("string"), F.lit(","), F.lit("")), F.lit("999999999999999")).cast("long")
    out = s.groupBy("theme").agg(F.count(F.lit(1)).alias("n_sources"), F.sum(n).alias("participants"))
    for value, name in (("direction", "directions"), ("design", "designs")):
        one = s.groupBy("theme", value).agg(F.count(F.lit(1)).alias("n")).groupBy("theme").agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("l"))
        out = out.join(one.select("theme", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["v"], x["n"].cast("string"))), ";").alias(name)), "theme", "left")
    order = F.array_position(F.array(*map(F.lit, ("very low", "low", "moderate", "high"))), F.col("certainty"))
    links = claims.select("certainty", "caveat", F.explode("source_ids").alias("source_id")).join(s.select("source_id", "theme"), "source_id")
    of = links.groupBy("theme").agg(F.max_by("certainty", order).alias("certainty"), F.array_join(F.sort_array(F.collect_set("caveat")), ";").alias("caveats"))
    return out.join(of, "theme", "left").select("theme", "n_sources", "participants", "certainty", "directions", "designs", "caveats")

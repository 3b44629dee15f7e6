"""Sources, citations and evidence: resolution, containment, contradiction, the ladder of verdicts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import doi_key, is_placeholder

#: Kinds of keys in the order in which a marker tries them.
PRECEDENCE = ("number", "citekey", "source_id", "doi", "pmid")


def strength() -> Column:
    """How much a ledger row says: recorded_estimate, prose_summary, metadata_only or none (SRC12)."""

    def any_of(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | ~(is_placeholder(F.col(n)) | F.coalesce(F.lower(F.trim(F.col(n))) == "not_reported", F.lit(True)))
        return out

    return F.when(any_of("effect_estimate", "n_participants", "follow_up"), "recorded_estimate").when(any_of("main_finding", "key_outcomes"), "prose_summary").when(any_of("population", "intervention", "comparator"), "metadata_only").otherwise("none")


def source_keys(sources: DataFrame) -> DataFrame:
    """(kind, key, source_id): all keys of sources (source_id, pos, number, citekey, doi, pmid); of a key that two have the first has it (JOIN01)."""
    kinds = F.array(
        F.struct(F.lit("number").alias("kind"), F.col("number").cast("string").alias("key")),
        F.struct(F.lit("citekey").alias("kind"), F.lower("citekey").alias("key")),
        F.struct(F.lit("source_id").alias("kind"), F.upper("source_id").alias("key")),
        F.struct(F.lit("doi").alias("kind"), doi_key(F.col("doi")).alias("key")),
        F.struct(F.lit("pmid").alias("kind"), F.col("pmid").cast("string").alias("key")),
    )
    keys = sources.select("source_id", "pos", F.explode(kinds).alias("k")).select("source_id", "pos", "k.*").where("key IS NOT NULL")
    return keys.groupBy("kind", "key").agg(F.min_by("source_id", "pos").alias("source_id"))


def resolve(markers: DataFrame, sources: DataFrame) -> DataFrame:
    """(sentence_id, token, source_id): each marker's source by the first kind of key that knows it, null if none does (JOIN01).

    A marker "author_year:<surname> <year>" resolves by its year where exactly one source has it.
    """
    keys = source_keys(sources)
    probes = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(k).alias("kind"), {"citekey": F.lower("token"), "source_id": F.upper("token"), "doi": doi_key(F.col("token"))}.get(k, F.col("token")).alias("key")) for i, k in enumerate(PRECEDENCE)))
    asked = markers.select("sentence_id", "token", F.explode(probes).alias("p")).select("sentence_id", "token", "p.*")
    found = asked.join(keys, ["kind", "key"]).groupBy("sentence_id", "token").agg(F.min_by("source_id", "order").alias("s"))
    years = sources.groupBy(F.col("year").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("by_year")).where("n = 1").drop("n")
    year = F.nullif(F.regexp_extract("token", r"^author_year:.*\b(\d{4})[a-z]?$", 1), F.lit(""))
    out = markers.join(found, ["sentence_id", "token"], "left").withColumn("y", year).join(years, "y", "left")
    return out.select("sentence_id", "token", F.coalesce("s", "by_year").alias("source_id")).distinct()


def missing_quantities(quantities: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Quantities (sentence_id, quantity_id, value_key) of which no single cited source has all values (JOIN02)."""
    values = quantities.groupBy("sentence_id", "quantity_id").agg(F.count_distinct("value_key").alias("n"))
    met = quantities.join(cited, "sentence_id").join(evidence, ["source_id", "value_key"]).groupBy("sentence_id", "quantity_id", "source_id").agg(F.count_distinct("value_key").alias("k"))
    whole = met.join(values, ["sentence_id", "quantity_id"]).where("k = n").select("sentence_id", "quantity_id").distinct()
    return values.join(whole, ["sentence_id", "quantity_id"], "left_anti").select("sentence_id", "quantity_id")


def contradictions(measured: DataFrame, cited: DataFrame, evidence: DataFrame, mode: str = "none_equal") -> DataFrame:
    """(sentence_id, measure, value, source_id, evidence_value): a measure that a cited source has with another value (JOIN03).

    mode "none_equal": no value of the source is equal; "any_differs": some value differs. The first differing one is told.
    """
    pairs = measured.join(cited, "sentence_id").join(evidence.withColumnRenamed("value", "evidence_value"), ["source_id", "measure"])
    differs = F.abs(F.col("value") - F.col("evidence_value")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("evidence_value"))
    out = pairs.groupBy("sentence_id", "measure", "value", "source_id").agg(F.min_by("evidence_value", F.when(differs, F.col("evidence_pos"))).alias("other"), F.count_if(differs).alias("d"), F.count_if(~differs).alias("e"))
    keep = (F.col("d") > 0) & (F.col("e") == 0) if mode == "none_equal" else F.col("d") > 0
    return out.where(keep).select("sentence_id", "measure", "value", "source_id", F.col("other").alias("evidence_value"))


def ladder() -> tuple[Column, Column]:
    """(state, rule) of a sentence over its facts; the first rung that holds decides (RUL01).

    Facts: n_markers, n_citing (markers that cite works), n_triggers, n_resolved, n_stray (citing markers without a
    source), n_author_year (such markers by author and year), closed (the reference list is complete), n_retracted,
    n_retracted_unverified, contradiction (null, defensible, unlinked, transcribed or prose), n_graded (cited sources whose evidence is
    held), n_checkable and n_missing (quantities).
    """
    c = F.col
    rungs = [
        ((c("n_markers") == 0) & (c("n_triggers") == 0), "no_citation_needed", "D01"),
        (c("n_citing") == 0, "unattributed", "D02"),
        ((c("n_resolved") == 0) & c("closed") & (c("n_stray") + c("n_author_year") > 0), "unattributed", "D03"),
        (c("n_resolved") == 0, "unverifiable", "D06"),
        (c("closed") & (c("n_stray") > 0), "unattributed", "D03"),
        (c("n_retracted_unverified") > 0, "unverifiable", "D11"),
        (c("n_retracted") > 0, "conflict", "D04"),
        (c("contradiction") == "defensible", "conflict", "D08"),
        (c("contradiction") == "unlinked", "unverifiable", "D11"),
        (c("contradiction") == "transcribed", "unverifiable", "D13"),
        (c("contradiction") == "prose", "unverifiable", "D12"),
        (c("n_graded") == 0, "unverifiable", "D05"),
        ((c("n_missing") == 0) & (c("n_checkable") > 0), "attributed", "D09"),
        (c("n_missing") == 0, "synthesis", "D10"),
    ]
    state = rule = None
    for when, s, r in rungs:
        when = F.coalesce(when, F.lit(False))
        state = F.when(when, s) if state is None else state.when(when, s)
        rule = F.when(when, r) if rule is None else rule.when(when, r)
    return state.otherwise("unverifiable"), rule.otherwise("D07")


def coverage(verdicts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(total, claiming, supported, coverage, percent) over verdicts with a state (AGG01): claiming are those that need a citation or have one."""
    total, none = F.count(F.lit(1)), F.count_if(F.col("state") == "no_citation_needed")
    supported = F.count_if(F.col("state").isin("attributed", "synthesis"))
    ratio = F.coalesce(supported / F.nullif(total - none, F.lit(0)), F.lit(0.0))
    return verdicts.groupBy(*(group or [])).agg(total.alias("total"), (total - none).alias("claiming"), supported.alias("supported"), F.round(ratio, 4).alias("coverage"), F.round(100 * ratio, 1).alias("percent"))


def cross_foot(verdicts: DataFrame, known: list[str]) -> DataFrame:
    """Rows (issue, n) where a roll-up can't be right: rules that are unknown or null, states that are null (AGG02)."""
    rows = verdicts.agg(F.count_if(~F.coalesce(F.col("rule").isin(known), F.lit(False))).alias("unknown_rule"), F.count_if(F.isnull("state")).alias("no_state"))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in ("unknown_rule", "no_state")))).alias("r")).select("r.*").where("n > 0")


def sufficiency(cited: DataFrame, policy: str = "strict", share: float = 1.0) -> DataFrame:
    """(source_id, n_sentences, n_needing, n_held, required, status) over (source_id, sentence_id, needs, held) (AGG03)."""
    out = cited.groupBy("source_id").agg(F.count_distinct("sentence_id").alias("n_sentences"), F.count_if("needs").alias("n_needing"), F.count_if(F.col("needs") & F.col("held")).alias("n_held"))
    required = F.col("n_needing") if policy == "strict" else F.when(F.col("n_needing") > 0, F.greatest(F.lit(1), F.round(F.col("n_needing") * share).cast("long"))).otherwise(0)
    return out.withColumn("required", required).withColumn("status", F.when(F.col("n_needing") == 0, "not_needed").when(F.col("n_held") >= F.col("required"), "sufficient").otherwise("insufficient_evidence"))


def claim_audit(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(claim_id, source_id, issue) over claims (claim_id, status, source_ids) and sources (source_id, status, inclusion, retraction, held) (JOIN05)."""
    links = claims.select("claim_id", F.col("status").alias("claim_status"), F.explode("source_ids").alias("source_id"))
    j = links.join(sources.withColumn("known", F.lit(True)), "source_id", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.lit("unknown_source")),
            F.when(F.col("status") != "verified", F.lit("source_not_verified")),
            F.when(F.col("inclusion") != "included", F.lit("source_not_included")),
            F.when(F.col("retraction") == "retracted", F.lit("source_retracted")),
            F.when((F.col("claim_status") == "verified") & (F.col("status") != "verified"), F.lit("verified_claim_on_unverified_source")),
            F.when((F.col("claim_status") == "verified") & ~F.col("held"), F.lit("gap_no_text")),
        )
    )
    return j.select("claim_id", "source_id", F.explode(issues).alias("issue"))


def two_way_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids of one table that the other hasn't (JOIN06, SET04)."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def compare_record(row: Column, record: Column) -> Column:
    """Issues of a ledger row against a fetched record, both structs (doi, title, year, volume, pages, author) (JOIN07, JOIN08)."""
    from tessella.functions.text import title_key

    def page(x: Column) -> Column:
        return F.regexp_extract(F.coalesce(x, F.lit("")), r"^[A-Za-z]*(\d+)", 1)

    a, b = title_key(row["title"]), title_key(record["title"])
    alike = F.contains(a, b) | F.contains(b, a) | (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)) >= 0.85)
    return F.array_compact(
        F.array(
            F.when(record["doi"].isNull(), F.lit("unchecked")),
            F.when(doi_key(row["doi"]) != doi_key(record["doi"]), F.lit("doi")),
            F.when(~alike, F.lit("title")),
            F.when(row["year"] != record["year"], F.lit("year")),
            F.when(row["volume"] != record["volume"], F.lit("volume")),
            F.when(page(row["pages"]) != page(record["pages"]), F.lit("pages")),
            F.when(F.lower(F.split_part(row["author"], F.lit(","), F.lit(1))) != F.lower(F.split_part(record["author"], F.lit(","), F.lit(1))), F.lit("author")),
        )
    )


def retraction(signals: list[Column]) -> tuple[Column, Column]:
    """(is_retracted, status) of boolean signals, null where not consulted (JOIN13, JOIN14): any true is enough; without any it stays open."""
    asked = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in signals[1:]), F.when(signals[0].isNotNull(), 1).otherwise(0))
    hit = F.lit(False)
    for s in signals:
        hit = hit | F.coalesce(s, F.lit(False))
    return hit, F.when(asked == 0, "unreachable").when(asked < len(signals), "partial").otherwise("ok")


def section_of(sentences: DataFrame, headings: DataFrame) -> DataFrame:
    """Each sentence (doc_id, pos) with the last heading (doc_id, pos, heading) at or before it (JOIN11): one window over both, no range join."""
    both = sentences.select("doc_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("heading")).unionByName(headings.select("doc_id", "pos", F.lit(0).alias("kind"), "heading"))
    last = F.last("heading", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("section", last).where("kind = 1").select("doc_id", "pos", "section")


def match_files(files: DataFrame, sources: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(file, source_id, method): files (file) of sources (source_id, citekey, title[, doi]), by the first that holds (JOIN12).

    filename-doi: the name is a DOI with `_` for `/`. filename-id: an id or citekey is a word of it. filename-title, for names and
    titles of 20 characters and more: the first eight words of the title stand in the name, or four fifths of its words do; the
    best score wins. Names and titles meet by a word that both have. Sources of `claimed` are left out.
    """
    from tessella.functions.text import title_key

    sources = sources if claimed is None else sources.join(claimed.select("source_id"), "source_id", "left_anti")
    stem = F.regexp_replace("file", r"\.[A-Za-z0-9]{1,5}$", "")
    names = files.select("file", stem.alias("stem"), title_key(stem).alias("name"))
    words = names.select("file", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    by_id = words.join(sources.select("source_id", F.explode(F.array(F.lower("source_id"), F.lower("citekey"))).alias("word")), "word").select("file", "source_id", F.lit(1).alias("order"), F.lit(1.0).alias("score"))
    out = by_id
    if "doi" in sources.columns:
        known = sources.select("source_id", doi_key(F.col("doi")).alias("key")).where("key IS NOT NULL")
        spelt = names.select("file", doi_key(F.regexp_replace("stem", r"^(10\.\d{4,9})[_ ]", "$1/")).alias("key"))
        out = out.unionByName(spelt.join(known, "key").select("file", "source_id", F.lit(0).alias("order"), F.lit(1.0).alias("score")))
    key = title_key(F.col("title"))
    titles = sources.select("source_id", key.alias("title"), F.split(key, " ").alias("w")).where(F.length("title") >= 20)
    terms = titles.select("source_id", "title", F.array_join(F.slice("w", 1, 8), " ").alias("head"), F.size(F.array_distinct("w")).alias("n"), F.explode(F.array_distinct("w")).alias("word"))
    met = words.where(F.length("name") >= 20).join(terms, "word").groupBy("file", "name", "source_id", "head", "n").agg(F.count(F.lit(1)).alias("k"))
    score = F.when(F.contains("name", F.col("head")), F.length("head") / F.length("name")).when(F.col("k") / F.col("n") >= 0.8, F.col("k") / F.col("n"))
    out = out.unionByName(met.select("file", "source_id", F.lit(2).alias("order"), score.alias("score")).where("score IS NOT NULL"))
    best = out.groupBy("file").agg(F.min_by(F.struct("source_id", "order"), F.struct("order", -F.col("score"), "source_id")).alias("r"))
    method = F.element_at(F.array(*map(F.lit, ("filename-doi", "filename-id", "filename-title"))), F.col("r.order") + 1)
    return best.select("file", F.col("r.source_id").alias("source_id"), method.alias("method"))


def find_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file): for each name wanted (name) a file (file): the same base name, else the same stem, else one stem within the other (JOIN12).

    For the last a stem is posted under one of its runs of half its length or more, whose number of characters is a power of two: the
    one that the others have least often; and met by the others' runs of as many. Of equal stems one is searched for, with the first file.
    Spark takes runs for as few as names, so it would broadcast them by its size check: the joins are told to merge.
    """
    base = lambda x: F.lower(F.regexp_extract(x, r"([^/\\]*)$", 1))
    stem = lambda x: F.regexp_replace(base(x), r"\.[a-z0-9]+$", "")
    a, b = wanted.select("name", base(F.col("name")).alias("base"), stem(F.col("name")).alias("stem")), files.select("file", base(F.col("file")).alias("base"), stem(F.col("file")).alias("stem"))
    found = lambda by, place: a.join(b.groupBy(by).agg(F.min("file").alias("file")).hint("merge"), by).select("name", "file", F.lit(place).alias("order"))
    stems, held = a.where("stem <> ''").select("stem").distinct(), b.where("stem <> ''").groupBy("stem").agg(F.min("file").alias("file"))
    power = F.length(F.bin(F.length("stem"))) - 1
    two = lambda k: F.pow(F.lit(2.0), k).cast("int")
    run = lambda k: F.transform(F.sequence(F.lit(1), F.length("stem") - two(k) + 1), lambda i: F.substring("stem", i, two(k)))

    def within(long: DataFrame, short: DataFrame) -> DataFrame:
        """(short, long): stems within longer ones, or equal ones."""
        powers = short.agg(F.array_sort(F.collect_set(power)).alias("powers"))  # as many as the longest name's length has binary digits
        runs = long.crossJoin(F.broadcast(powers)).select("stem", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("powers", lambda k: k <= power), run)))).alias("t"))
        own = short.select(F.col("stem"), F.explode(F.array_distinct(run(power))).alias("t")).join(runs.groupBy("t").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "t")
        rarest = own.groupBy(F.col("stem").alias("short")).agg(F.min_by("t", F.struct("n", "t")).alias("t"))
        return runs.join(rarest.hint("merge"), "t").where(F.contains("stem", F.col("short"))).select("short", F.col("stem").alias("long"))

    met = within(stems, held.select("stem")).select(F.col("long").alias("mine"), F.col("short").alias("stem")).unionByName(within(held.select("stem"), stems).select(F.col("short").alias("mine"), F.col("long").alias("stem")))
    inside = met.join(held.hint("merge"), "stem").groupBy(F.col("mine").alias("stem")).agg(F.min("file").alias("file"))
    inside = a.join(inside.hint("merge"), "stem").select("name", "file", F.lit(2).alias("order"))
    return found("base", 0).unionByName(found("stem", 1)).unionByName(inside).groupBy("name").agg(F.min_by("file", F.struct("order", "file")).alias("file"))


def bibliography_status(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(key, status, detail) of a bibliography's entries (key, ident, title, year) by registry records (ident, reached, found, title, year, retracted) (JOIN08).

    UNCHECKED: the registry wasn't reached, or there is nothing to ask by; that is no finding about the entry. FAIL: it was reached
    and has no such record. RETRACTED. WARN: year or the first 40 characters of the title differ. Else OK.
    """
    from tessella.functions.text import title_key

    r = records.select("ident", F.coalesce("reached", F.lit(False)).alias("reached"), F.coalesce("found", F.lit(False)).alias("found"), F.col("title").alias("r_title"), F.col("year").alias("r_year"), "retracted")
    j = entries.join(r, "ident", "left")
    head = lambda x: F.substring(title_key(x), 1, 40)
    year, title = F.col("year") != F.col("r_year"), head(F.col("title")) != head(F.col("r_title"))
    detail = F.array_join(F.array_compact(F.array(F.when(year, F.lit("year")), F.when(title, F.lit("title")))), ",")
    status = F.when(F.col("ident").isNull() | F.col("reached").isNull() | ~F.col("reached"), "UNCHECKED").when(~F.col("found"), "FAIL").when(F.col("retracted"), "RETRACTED").when(detail != "", "WARN").otherwise("OK")
    return j.select("key", status.alias("status"), F.when(status == "WARN", detail).alias("detail"))


def worst(statuses: DataFrame, group: str, status: str = "status") -> DataFrame:
    """The worst of each group's statuses: fail, gap, warn, pass (RUL05)."""
    order = F.when(F.col(status) == "fail", 0).when(F.col(status) == "gap", 1).when(F.col(status) == "warn", 2).otherwise(3)
    return statuses.groupBy(group).agg(F.min_by(status, order).alias("status"))


def attribution_gate(facts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, passed, blockers) of each row of facts, which must all be 0; a null blocks like a finding (AGG15)."""
    names = ["passage_findings", "open_reviews", "citations_unresolved", "retracted_cited", "quotes_unmarked", "data_unverified", "self_overlap"]
    blockers = F.array_compact(F.array(*(F.when(F.coalesce(F.col(n) != 0, F.lit(True)), F.lit(n)) for n in names)))
    return facts.select(*(keep or []), (F.size(blockers) == 0).alias("passed"), blockers.alias("blockers"))

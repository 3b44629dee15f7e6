"""Records of papers: filters, usability, relevance, names, ordered dedup, routing."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions.text import doi_key, query_terms, title_key

_PARTICLES = ("van", "von", "de", "da", "del", "di", "la", "le", "der", "den", "ten", "ter")


def passes(*, year_min=None, year_max=None, open_access=None, journal=None, exclude_journals=(), types=(), exclude_types=(), author=None, cited_min=None, cited_max=None, has_abstract=None, has_pdf=None) -> Column:
    """The conjunction of the given conditions over (year, is_open, journal, type, authors, citations, abstract, pdf); an unknown year or citation count passes (FLT01)."""
    tests = [F.lit(True)]
    if year_min is not None:
        tests.append(F.col("year").isNull() | (F.col("year") >= year_min))
    if year_max is not None:
        tests.append(F.col("year").isNull() | (F.col("year") <= year_max))
    if open_access is not None:
        tests.append(F.coalesce("is_open", F.lit(False)) == open_access)
    if journal:
        tests.append(F.coalesce(F.contains(F.lower("journal"), F.lit(journal.lower())), F.lit(False)))
    for j in exclude_journals:
        tests.append(~F.coalesce(F.contains(F.lower("journal"), F.lit(j.lower())), F.lit(False)))
    if types:
        tests.append(F.coalesce(F.lower("type").isin([t.lower() for t in types]), F.lit(False)))
    if exclude_types:
        tests.append(~F.coalesce(F.lower("type").isin([t.lower() for t in exclude_types]), F.lit(False)))
    if author:
        tests.append(F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(author.lower()))))
    if cited_min is not None:
        tests.append(F.col("citations").isNull() | (F.col("citations") >= cited_min))
    if cited_max is not None:
        tests.append(F.col("citations").isNull() | (F.col("citations") <= cited_max))
    if has_abstract is not None:
        tests.append((F.coalesce(F.trim("abstract"), F.lit("")) != "") == has_abstract)
    if has_pdf is not None:
        tests.append((F.coalesce(F.trim("pdf"), F.lit("")) != "") == has_pdf)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def regex_filter(papers: DataFrame, pattern: str, fields: list[str], mode: str = "any") -> DataFrame:
    """Rows of which any (or all) fields match, case-insensitively, with matched_<field> flags (FLT02)."""
    out = papers
    for f in fields:
        out = out.withColumn(f"matched_{f}", F.coalesce(F.col(f).rlike(f"(?i){pattern}"), F.lit(False)))
    flags = [F.col(f"matched_{f}") for f in fields]
    keep = flags[0]
    for f in flags[1:]:
        keep = keep | f if mode == "any" else keep & f
    return out.where(keep)


def usable() -> Column:
    """Some of year, authors, abstract, journal, citations is there; '' and 0 are nothing (FLT03)."""
    return (F.coalesce("year", F.lit(0)) != 0) | (F.coalesce(F.size("authors"), F.lit(0)) > 0) | (F.coalesce("abstract", F.lit("")) != "") | (F.coalesce("journal", F.lit("")) != "") | (F.coalesce("citations", F.lit(0)) != 0)


def completeness() -> Column:
    """The share of year, authors, abstract, doi and journal that is there (FLT03)."""
    has = (F.coalesce("year", F.lit(0)) != 0, F.coalesce(F.size("authors"), F.lit(0)) > 0, F.coalesce("abstract", F.lit("")) != "", F.coalesce("doi", F.lit("")) != "", F.coalesce("journal", F.lit("")) != "")
    return sum((F.when(h, 1).otherwise(0) for h in has[1:]), F.when(has[0], 1).otherwise(0)) / 5


def _share(text: Column, terms: list[str]) -> Column:
    hits = [F.when(F.coalesce(text, F.lit("")).rlike(rf"(?i)(?:^|[^\w]){re.escape(t)}\w*"), 1).otherwise(0) for t in terms]
    return sum(hits[1:], hits[0]) / len(terms)


def relevance(query: str) -> tuple[Column, Column]:
    """Score and band of (title, abstract, journal) for a query (FLT06).

    2 for the share of terms in the title, 1 in the abstract, 0.5 in the journal; 3 for the phrase in the title, 2 for all
    terms in it, else 0.5 for all terms in title or abstract. Terms match as prefixes of words.
    """
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0), F.lit("low")
    title, both = _share(F.col("title"), terms), _share(F.concat_ws(" ", "title", "abstract"), terms)
    phrase = F.coalesce(F.col("title"), F.lit("")).rlike(rf"(?i)(?:^|[^\w]){re.escape(query.strip())}(?:[^\w]|$)")
    score = 2.0 * title + 1.0 * _share(F.col("abstract"), terms) + 0.5 * _share(F.col("journal"), terms) + F.when(phrase, 3.0).otherwise(0.0) + F.when(title == 1, 2.0).when(both == 1, 0.5).otherwise(0.0)
    band = F.when(phrase | (title == 1), "high").when((title >= 0.6) | (both == 1), "medium").otherwise("low")
    return F.round(score, 3), band


def ranked(papers: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Papers by relevance, then completeness, citations and position; rank and then cut (TOP03, TOP04)."""
    score, band = relevance(query)
    out = papers.withColumn("relevance", score).withColumn("band", band).orderBy(F.desc("relevance"), F.desc(completeness()), F.desc_nulls_last("citations"), "pos")
    return out.limit(limit) if limit else out


def paper_key() -> Column:
    """doi:..., else title:... with authors, else id:... (SET02)."""
    doi = doi_key(F.col("doi"))
    title = F.nullif(title_key(F.coalesce("title", F.lit(""))), F.lit(""))
    return F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).when(title.isNotNull(), F.concat(F.lit("title:"), title, F.lit("|authors:"), F.lower(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ";")))).otherwise(F.concat(F.lit("id:"), F.col("paper_id").cast("string")))


def dedup_first(papers: DataFrame) -> DataFrame:
    """The first row of each key, by position (SET02). A min_by aggregate: no group is held by a task."""
    names = papers.columns
    return papers.withColumn("_key", paper_key()).groupBy("_key").agg(F.min_by(F.struct(*names), "pos").alias("r")).select("r.*")


@F.pandas_udf(StringType())
def _without_accents(names: pd.Series) -> pd.Series:
    """Letters are taken apart from their marks (NFKD), and the marks dropped."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def fold(name: Column) -> Column:
    """A name in lower case without accents, of any script that has them, and without punctuation (FLT04)."""
    return F.trim(F.regexp_replace(F.lower(_without_accents(name)), r"[^\p{L}\p{N},]+", " "))


def parsed_name(name: Column) -> Column:
    """struct(family, given): "Family, Given" or the last word, with particles before it (FLT04)."""
    n = F.regexp_replace(fold(name), r"\s+(jr|sr|ii|iii|iv)$", "")
    particles = "|".join(_PARTICLES)
    family = F.when(F.contains(n, F.lit(",")), F.trim(F.split_part(n, F.lit(","), F.lit(1)))).otherwise(F.regexp_extract(n, rf"((?:(?:{particles}) )*[\p{{L}}\p{{N}}]+)$", 1))
    given = F.when(F.contains(n, F.lit(",")), F.trim(F.split_part(n, F.lit(","), F.lit(2)))).otherwise(F.trim(F.regexp_replace(n, rf"((?:(?:{particles}) )*[\p{{L}}\p{{N}}]+)$", "")))
    return F.struct(family.alias("family"), given.alias("given"))


def same_person(a: Column, b: Column, initials: bool = True, family_only: bool = False) -> Column:
    """Equal family names and compatible first given names (FLT04)."""
    x, y = parsed_name(a), parsed_name(b)
    p, q = F.split_part(x["given"], F.lit(" "), F.lit(1)), F.split_part(y["given"], F.lit(" "), F.lit(1))
    either = (F.length(p) == 1) | (F.length(q) == 1)
    given = (p == q) & (p != "")
    if initials:
        given = given | (either & (F.substring(p, 1, 1) == F.substring(q, 1, 1)) & (p != "") & (q != ""))
    if family_only:
        given = given | (p == "") | (q == "")
    return (x["family"] == y["family"]) & given


def abstract_of(inverted: Column) -> Column:
    """The text of an inverted index map<word, array<position>> (SCA11)."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def field_query(terms: list[str], field: str = "", joiner: str = "AND") -> str:
    """A fielded boolean query; terms of several words are quoted (SCA12)."""
    tag = f"[{field}]" if field else ""
    return f" {joiner} ".join((f'"{t}"' if " " in t else t) + tag for t in terms)


def ladder(query: str) -> list[str]:
    """From strict to loose: phrase, all terms, word forms, the query itself (SCA13, STR07)."""
    from tessella.functions.text import variants

    terms = query_terms(query)
    rungs = [f'"{query.strip()}"', field_query(terms), " AND ".join("(" + " OR ".join(variants(t)) + ")" for t in terms), query]
    return list(dict.fromkeys(r for r in rungs if r))


def pick(rows: DataFrame, bias: str, group: str = "group") -> DataFrame:
    """One candidate of each group: top_cited, bottom_cited, most_similar, or by a sum of character codes (TOP05)."""
    by = W.partitionBy(group)
    if bias == "by_code":
        code = F.aggregate(F.transform(F.split(F.min_by("paper_id", "pos").over(by).cast("string"), ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
        numbered = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_k", F.row_number().over(by.orderBy("pos")) - 1).withColumn("_c", code)
        return numbered.where("_k = _c % _n").drop("_n", "_k", "_c")
    order = {"top_cited": F.desc_nulls_last("citations"), "bottom_cited": F.asc_nulls_last("citations"), "most_similar": F.desc_nulls_last("similarity")}[bias]
    return rows.withColumn("_k", F.row_number().over(by.orderBy(order, "pos"))).where("_k = 1").drop("_k")


def zero_reason(found: Column, pool: Column, unavailable: Column) -> Column:
    """Why nothing was found: outage, empty pool, or filtered out (FLT05)."""
    return F.when(found > 0, "found").when(unavailable > 0, "outage").when(pool == 0, "empty pool").otherwise("filtered out")

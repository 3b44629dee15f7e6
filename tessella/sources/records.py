"""Readers of tables and records: CSV, JSON, BibTeX, reference lists, XML articles, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import doi_key, find_dois, strip

PAPER = "paper_id string, title string, year int, authors array<string>, abstract string, journal string, doi string, citations int"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; cells are strings unless a schema is given; quotes may hold line ends (SRC08)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, most_bytes: int = 64 << 20) -> DataFrame:
    """JSON documents by schema; a malformed one is kept in _corrupt instead of being lost; larger ones are refused (SRC08)."""
    big = spark.read.format("binaryFile").load(path).where(F.col("length") > most_bytes).limit(1).count()
    if big:
        raise ValueError(f"a JSON file has more than {most_bytes} bytes")
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema + ", _corrupt string").json(path)


def ragged_rows(files: DataFrame) -> DataFrame:
    """(path, line, cells, expected) of CSV texts (path, text): records whose number of cells isn't the header's; an empty file is line 0 (SRC09).

    Quoted line ends and commas are masked before records and cells are counted.
    """
    masked = F.regexp_replace(F.coalesce("text", F.lit("")), r'"(?:[^"]|"")*"', "q")
    lines = files.select("path", F.split(F.regexp_replace(F.regexp_replace(masked, "\r\n", "\n"), r"\n+$", ""), "\n").alias("l"))
    cells = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) + 1
    rows = lines.select("path", cells(F.col("l")[0]).alias("expected"), (F.col("l")[0] == "").alias("empty"), F.posexplode("l").alias("line", "x"))
    out = rows.select("path", F.when(F.col("empty"), 0).otherwise(F.col("line") + 1).alias("line"), cells(F.col("x")).alias("cells"), "expected", "empty", "x")
    return out.where((F.col("empty") & (F.col("line") == 0)) | (~F.col("empty") & (F.col("cells") != F.col("expected")) & (F.col("x") != ""))).select("path", "line", "cells", "expected")


def bibtex(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, key, fields) of BibTeX entries (SRC10): fields are a map of lower-case names; values in braces (two deep) or quotes, or bare."""
    entries = docs.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n\s*(?=@[A-Za-z]+\s*\{)")).alias("e")).where(F.col("e").rlike(r"^@(?!(?i)(comment|string|preamble))[A-Za-z]+\s*\{"))
    value = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\"[^\"]*\"|[A-Za-z0-9]+"
    pairs = F.regexp_extract_all("e", F.lit(rf"(?s)([A-Za-z][A-Za-z0-9_-]*\s*=\s*(?:{value}))"))
    split = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^([^=]*?)\s*=", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^=]*=\s*", ""), r"^[{\"]|[}\"]$", "")).alias("v")))
    first = F.filter(split, lambda s, i: F.array_position(F.transform(split, lambda t: t["k"]), s["k"]) == i + 1)
    return entries.select(F.lower(F.regexp_extract("e", r"^@([A-Za-z]+)", 1)).alias("type"), F.trim(F.regexp_extract("e", r"^@[A-Za-z]+\s*\{\s*([^,\s]*)", 1)).alias("key"), F.map_from_entries(first).alias("fields"))


def reference_list(lines: DataFrame) -> DataFrame:
    """(doc, number, text, doi, year, pmid) of numbered reference lines (doc, line) (SRC11)."""
    number = F.regexp_extract("line", r"^\s*\[?(\d{1,4})[\].)]", 1)
    text = F.trim(F.regexp_replace("line", r"^\s*\[?\d{1,4}[\].)]\s*", ""))
    rows = lines.where(number != "").select("doc", number.cast("int").alias("number"), text.alias("text"))
    year = F.nullif(F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    pmid = F.nullif(F.regexp_extract("text", r"(?i)\bpmid:?\s*(\d{1,8})", 1), F.lit(""))
    return rows.select("doc", "number", "text", F.try_element_at(find_dois(F.col("text")), F.lit(1)).alias("doi"), year.cast("int").alias("year"), pmid.alias("pmid"))


def articles(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(pmid, title, abstract, year, authors, doi) of article XML (SRC15, SRC16): markup in titles is dropped, labelled abstract parts are joined, a group author counts, and the article's own DOI is taken, not one of its references'."""
    x = F.col(column)
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " "))
    own = F.regexp_replace(x, r"(?s)<ReferenceList>.*?</ReferenceList>", "")
    labels = F.regexp_extract_all(own, F.lit(r"(?s)<AbstractText[^>]*?Label=\"([^\"]*)\""), 1)
    bodies = F.transform(F.regexp_extract_all(own, F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), 1), plain)
    abstract = F.when(F.size(labels) == F.size(bodies), F.array_join(F.zip_with(labels, bodies, lambda a, b: F.concat(a, F.lit(": "), b)), " ")).otherwise(F.array_join(bodies, " "))
    persons = F.transform(F.regexp_extract_all(own, F.lit(r"(?s)<LastName>(.*?)</LastName>"), 1), plain)
    groups = F.transform(F.regexp_extract_all(own, F.lit(r"(?s)<CollectiveName>(.*?)</CollectiveName>"), 1), plain)
    year = F.coalesce(F.nullif(F.regexp_extract(own, r"(?s)<PubDate>.*?<Year>(\d{4})</Year>", 1), F.lit("")), F.nullif(F.regexp_extract(own, r"(?s)<MedlineDate>.*?(\d{4})", 1), F.lit("")))
    return xml.select(
        F.regexp_extract(own, r"<PMID[^>]*>(\d+)</PMID>", 1).alias("pmid"),
        plain(F.regexp_extract(own, r"(?s)<ArticleTitle[^>]*>(.*?)</ArticleTitle>", 1)).alias("title"),
        abstract.alias("abstract"),
        year.cast("int").alias("year"),
        F.concat(persons, groups).alias("authors"),
        F.nullif(F.lower(F.regexp_extract(own, r"<ArticleId IdType=\"doi\">([^<]*)</ArticleId>", 1)), F.lit("")).alias("doi"),
    )


def body_text(xml: Column) -> Column:
    """Text of a full-text XML article without its reference list (SRC17)."""
    x = F.regexp_extract(xml, r"(?s)<body[^>]*>(.*?)</body>", 1)
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<ref-list\b.*?</ref-list>|<table-wrap\b.*?</table-wrap>", " "), r"</?(?:p|sec|title)\b[^>]*>", "\n\n")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"[ \t]+", " "), r" ?\n\s*\n\s*", "\n\n"))


def standardized(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of a connector in the common paper schema (SRC14): names gives the source's column of each; others are null."""
    kinds = dict(x.strip().split(" ", 1) for x in PAPER.split(", "))
    return raw.select(*((F.col(names[c]) if c in names else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def page_tokens(total: int, page: int) -> list[tuple[int, int]]:
    """(offset, size) of the pages that hold `total` results, none left out (SRC14, SRC16)."""
    return [(at, min(page, total - at)) for at in range(0, total, page)]


def unwrap(url: Column) -> Column:
    """The target of a search engine's wrapped link, one hop only; other links stay (SRC19)."""
    target = F.regexp_extract(url, r"[?&](?:url|q|u|RU)=(https?(?:%3A|:)[^&]*)", 1)
    return F.when(target != "", F.url_decode(target)).otherwise(url)


def crosswalk(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(given, doi, pmid, pmcid): identifiers of one kind by the others (SRC20); unknown ones stay with nulls."""
    keys = known.select("doi", "pmid", "pmcid", F.explode(F.array_compact(F.array(doi_key(F.col("doi")), "pmid", F.lower("pmcid")))).alias("key"))
    given = ids.select("given", F.coalesce(doi_key(F.col("given")), F.lower(F.trim("given"))).alias("key"))
    return given.join(keys, "key", "left").select("given", "doi", "pmid", "pmcid").distinct()


def acquired(attempts: DataFrame) -> DataFrame:
    """(source_id, tier, text): the first tier, api, pdf, cli, whose text is of the cited work; titles decide (SRC18)."""
    order = F.when(F.col("tier") == "api", 0).when(F.col("tier") == "pdf", 1).otherwise(2)
    fits = F.col("text").isNotNull() & F.contains(F.lower("text"), F.lower("title"))
    return attempts.where(fits).groupBy("source_id").agg(F.min_by(F.struct("tier", "text"), order).alias("r")).select("source_id", "r.*")

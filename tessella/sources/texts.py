"""Readers of documents: text and markdown, LaTeX, HTML, DOCX; each gives typed paragraphs or a gap, never nothing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import html_text, strip


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of whole files, found recursively (SRC01, SRC07)."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, kind, body) of markdown or plain text (SRC01): heading, code, table, quote, list or prose; soft line ends are spaces.

    Fenced code is a block of its own, so that blank lines in it end nothing.
    """
    found = F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?s)(\n```.*?\n```|(?:(?!\n[ \t]*\n|\n```).)+)"))
    blocks = docs.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "body"))
    body = strip(F.col("body"))
    blocks = blocks.where(body != "")
    kind = (
        F.when(body.startswith("```"), "code")
        .when(body.rlike(r"^#{1,6} ") | body.rlike(r"^[^\n]+\n(=+|-+)$"), "heading")
        .when(body.rlike(r"^\|"), "table")
        .when(body.rlike(r"^>"), "quote")
        .when(body.rlike(r"^([-*+]|\d+[.)]) "), "list")
        .otherwise("prose")
    )
    text = F.when(kind == "heading", F.regexp_replace(F.regexp_replace(body, r"^#{1,6} ", ""), r"\n(=+|-+)$", "")).when(kind == "prose", F.regexp_replace(body, r"\s*\n\s*", " ")).otherwise(body)
    return blocks.select("id", "pos", kind.alias("kind"), text.alias("body"))


def latex_text(tex: Column) -> Column:
    """Prose of LaTeX: comments, figures and tables go, headings stay, citations become bracket markers (SRC03)."""
    x = F.regexp_replace(tex, r"(?m)(?<!\\)%.*$", "")
    x = F.regexp_replace(x, r"(?s)^.*?\\begin\{document\}", "")
    x = F.regexp_replace(x, r"(?s)\\end\{document\}.*$", "")
    x = F.regexp_replace(x, r"(?s)\\begin\{(figure|table|equation|align|tabular|verbatim)\*?\}.*?\\end\{\1\*?\}", " ")
    x = F.regexp_replace(x, r"\\(?:sub)*section\*?\{([^}]*)\}", "\n\n# $1\n\n")
    x = F.regexp_replace(x, r"~?\\cite[tp]?\*?(?:\[[^\]]*\])*\{([^}]*)\}", " [$1]")
    x = F.regexp_replace(x, r"\\(?:emph|textbf|textit|underline)\{([^}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n\s*\n\s*", "\n\n"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, level, heading, body, n_words) by markdown headings (SRC06); what stands before the first has level 0."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"(?m)^(?=#{1,6} )")).alias("pos", "part")).where(strip(F.col("part")) != "")
    marks = F.regexp_extract("part", r"^(#{1,6}) ", 1)
    heading = F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1)
    body = strip(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", ""))
    return parts.select("id", "pos", F.length(marks).alias("level"), heading.alias("heading"), body.alias("body"), F.regexp_count(body, F.lit(r"\S+")).alias("n_words"))


def read_corpus(spark: SparkSession, path: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """A local corpus of text and HTML files (SRC07): (path, text) with white space folded, and gaps (path, reason) for what is too short.

    An empty folder gives two empty tables; an unreadable one raises, so that the two can't be taken for each other.
    """
    raw = read_texts(spark, path)
    text = F.when(F.lower("path").rlike(r"\.html?$"), html_text(F.col("text"))).otherwise(F.col("text"))
    rows = raw.select("path", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))
    enough = F.regexp_count("text", F.lit(r"\S+")) >= least
    return rows.where(enough), rows.where(~enough).select("path", F.lit("fewer words than needed").alias("reason"))


#: Files that are read as text; all others are gaps by name.
TEXT_FILES = r"(?i)\.(?:txt|text|md|markdown|html?)$"


def scan_corpus(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """(path, text, reason): a row for every file below a folder (SRC07), either with its text or with the reason why it is a gap.

    Text and HTML have white space folded and HTML its markup removed. Reasons: no_pdf_extractor, unsupported, not UTF-8, "fewer
    words than needed", "empty or unreadable". A scan skips empty files and, here, what can't be opened; the names come from the listing,
    which Spark's driver holds for every scan, and what has no row beside its name is a gap, so no file is lost. A file that the cluster
    may not open by its permissions, and a folder that can't be listed, raise. An empty folder has no rows. A file is read whole, so one is
    at most 2 GB. Paths are as `input_file_name` writes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    told = F.when(F.lower("path").endswith(".pdf"), "no_pdf_extractor").when(~F.col("path").rlike(TEXT_FILES), "unsupported")
    names = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select("path", told.alias("told"))
    raw = F.col("content").cast("string")
    read = files.where(F.col("path").rlike(TEXT_FILES)).select(F.input_file_name().alias("path"), F.is_valid_utf8(raw).alias("valid"), F.make_valid_utf8(raw).alias("raw"))
    text = F.trim(F.regexp_replace(F.when(F.col("path").rlike(r"(?i)\.html?$"), html_text(F.col("raw"))).otherwise(F.col("raw")), r"\s+", " "))
    rows = read.select("path", "valid", text.alias("text"), F.lit(True).alias("opened"))
    reason = (
        F.when(F.col("told").isNotNull(), F.col("told"))
        .when(F.col("opened").isNull(), "empty or unreadable")
        .when(~F.col("valid"), "not UTF-8")
        .when(F.regexp_count("text", F.lit(r"\S+")) < least, "fewer words than needed")
    )
    all_ = names.join(rows, "path", "left").withColumn("reason", reason)
    return all_.select("path", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "reason")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    parts = [n for n in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml") if n in z.namelist()]
                    trees = [ElementTree.fromstring(z.read(n)) for n in parts]
            except (zipfile.BadZipFile, ElementTree.ParseError) as why:
                rows.append((path, -1, "gap", type(why).__name__))
                continue
            pos = 0
            for tree in trees:
                for p in tree.iter(f"{_W}p"):
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    kind = "heading" if style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title")) else "prose"
                    out = []
                    for r in p.iter(f"{_W}r"):
                        t = "".join(x.text or "" for x in r.iter(f"{_W}t"))
                        raised = r.find(f"{_W}rPr/{_W}vertAlign")
                        out.append(f"[{t}]" if raised is not None and raised.get(f"{_W}val") == "superscript" and t.strip().isdigit() else t)
                    if text := "".join(out).strip():
                        rows.append((path, pos, kind, text))
                        pos += 1
        yield pd.DataFrame(rows, columns=["path", "pos", "kind", "body"])


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, kind, body) of DOCX files (SRC02): raised digits are citation markers, notes follow the text; a file that is none is one row of kind "gap"."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(_docx, "path string, pos int, kind string, body string")


def read_pdf_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of PDF files (SRC04): no extractor is installed, so each is a gap and none counts as empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", F.when(F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF"), "no_pdf_extractor").otherwise("not a PDF").alias("reason"))

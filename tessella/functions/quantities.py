"""Markers, quantities and number checks of sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of quantities in order; an earlier one owns its text (SCA05).
QUANTITIES = [
    ("p_value", r"\bp\s*[<=>]\s*0?\.\d+"),
    ("measure", r"\b(?:HR|OR|RR|SMD|MD)\s*(?:=|:|of)?\s*-?\d+(?:\.\d+)?"),
    ("confidence_interval", r"\b\d{2}\s?% CI[: ]*\[?\(?-?\d+(?:\.\d+)?\s*(?:to|-|,)\s*-?\d+(?:\.\d+)?"),
    ("percent", r"-?\d+(?:\.\d+)?\s?%"),
    ("fraction", r"\b\d+\s?/\s?\d+\b"),
    ("range", r"\b\d+(?:\.\d+)?\s?(?:-|to)\s?\d+(?:\.\d+)?\b"),
    ("count", r"\bn\s?=\s?\d+"),
    ("unit", r"\b\d+(?:\.\d+)?\s?(?:mg|kg|g|ml|mmHg|cm|mm)\b"),
    ("duration", r"\b\d+(?:\.\d+)?\s?(?:days?|weeks?|months?|years?|hours?|minutes?)\b"),
    ("year", r"\b(?:19|20)\d{2}\b"),
    ("number", r"-?\d+(?:\.\d+)?"),
]


def quantities(text: Column) -> Column:
    """array<struct(kind, raw)>: each kind takes what no earlier kind has taken (SCA05). What is taken becomes a blank for the rest."""

    def as_kind(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw"))

    out, rest = None, text
    for kind, pattern in QUANTITIES:
        found = F.transform(F.regexp_extract_all(rest, F.lit(f"({pattern})")), as_kind(kind))
        out = found if out is None else F.concat(out, found)
        rest = F.regexp_replace(rest, pattern, " ")
    return out


def checkable(kind: Column, value: Column) -> Column:
    """Whether a quantity can be looked up: no interval or year; a bare number from 20 up or with a fraction (SCA05)."""
    return ~kind.isin("confidence_interval", "year") & ((kind != "number") | (F.abs(value) >= 20) | (value != F.floor(value)))


def numeric_markers(text: Column) -> Column:
    """Sorted distinct numbers of markers like [1,3-5]; ranges by hyphen or dash are expanded alike (SCA04)."""
    inner = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*[,;\-–—]\s*\d+)*)\]"), 1)
    parts = F.flatten(F.transform(inner, lambda x: F.split(x, r"\s*[,;]\s*")))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, r"\s*[\-–—]\s*"), lambda n: n.cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.when(F.element_at(e, -1) >= e[0], F.sequence(e[0], F.element_at(e, -1))).otherwise(e)))))


def author_year_markers(text: Column) -> Column:
    """Distinct "surname year" of markers like (Smith et al., 2020; Lee 2018) (SCA04)."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z'\-]+(?: et al\.?| and [A-Z][A-Za-z'\-]+)?,? \(?(?:19|20)\d{2}[a-z]?)"))
    return F.array_distinct(F.transform(found, lambda x: F.concat_ws(" ", F.lower(F.regexp_extract(x, r"^([A-Za-z'\-]+)", 1)), F.regexp_extract(x, r"(\d{4}[a-z]?)$", 1))))


def decimals(token: Column) -> Column:
    """Digits after the point of a number as it is written (SCA08)."""
    return F.length(F.regexp_extract(token, r"\.(\d+)$", 1))


def traceable(token: Column, values: Column) -> Column:
    """Whether some value rounds to a number at the decimals it is written with (SCA08)."""
    k = decimals(token)
    step = F.pow(F.lit(10.0), -k)
    return F.exists(values, lambda v: F.abs(v - token.cast("double")) <= step / 2 + 1e-12)


def unfinished(line: Column) -> Column:
    """Whether a line goes on in the next: it ends with no mark (WIN05)."""
    return ~F.trim(line).rlike(r"[.!?:;][\"')\]]*$")


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; unlike a matching-blocks ratio, so thresholds are its own (SIM07)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))

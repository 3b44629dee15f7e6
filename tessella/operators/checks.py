"""Checks of text: personal data, claims, arithmetic, language, before and after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import FUNCTION_WORDS

#: Personal data (FLT10): kind and pattern.
PII = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?\d{1,3}[ .\-]?)?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}",
    "mrn": r"(?i)\bmrn[:# ]*\d{5,}",
    "birth": r"(?i)\b(?:dob|date of birth)[: ]+\d",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
OVERCLAIM = r"(?i)\b(proves?|guarantees?|definitively|undoubtedly|conclusively|always)\b"


def _word(alternatives: str) -> str:
    """A whole word: bounded by what is no ASCII letter, digit or underscore, in every regex dialect alike."""
    return rf"(?i)(^|[^\w])({alternatives})([^\w]|$)"


SUPERLATIVE = _word("most|best|largest|highest|lowest|first|leading|greatest")
VAGUE = _word("studies show|research suggests|experts|it is known|some say|many believe")
STATISTIC = r"(?i)\d+(\.\d+)?\s?%|p\s?[<=>]\s?0?\.\d+|\d{2,}|" + _word(r"mean|median|odds|hazard|risk|rate|ratio|correlat\w*|associat\w*").removeprefix("(?i)")
DEFINITION = _word("is defined as|refers to|means that")


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def triggers(text: Column) -> Column:
    """The kinds of statements of a text that ask for a source (FLT08)."""
    kinds = (("STATISTIC", STATISTIC), ("SUPERLATIVE", SUPERLATIVE), ("VAGUE_ATTRIBUTION", VAGUE), ("DEFINITION", DEFINITION))
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in kinds)))


def function_share(words: Column) -> Column:
    """The share of English function words; null without words (WIN03)."""
    return F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS))) / F.nullif(F.size(words), F.lit(0))


def fraction_ok(numerator: Column, denominator: Column, percent: Column, tolerance: float = 0.6) -> Column:
    """What is wrong with "n/N (p%)", or null (SCA07)."""
    return F.when(denominator == 0, "zero denominator").when(numerator > denominator, "numerator above denominator").when(percent > 100, "above 100 percent").when(F.abs(100 * numerator / denominator - percent) > tolerance, "percent differs")


def interval_ok(estimate: Column, low: Column, high: Column) -> Column:
    """What is wrong with an estimate and its interval, or null (SCA07)."""
    return F.when(low > high, "bounds inverted").when((estimate < low) | (estimate > high), "estimate outside")


def added(before: Column, after: Column, pattern: str = r"(\d+(?:\.\d+)?)") -> tuple[Column, Column]:
    """Numbers that a revision adds and drops, sorted (FLT11, SET04)."""
    b, a = (F.array_distinct(F.regexp_extract_all(x, F.lit(pattern))) for x in (before, after))
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def prose_gap(text: Column) -> Column:
    """Why a text can't be judged as English prose, or null (FLT11)."""
    bare = F.regexp_replace(text, r"[#*_`>\s]", "")
    ascii_, other = F.regexp_count(bare, F.lit("[A-Za-z]")), F.regexp_count(bare, F.lit(r"[^\x00-\x7F]"))
    return F.when(bare == "", "blank").when(ascii_ == 0, "no letters").when(other > ascii_, "other script")

"""Spans in text: which pattern owns which characters, and which spans of two tables overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels, units, bounds and patterns of numeric statements; results depend on them.
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
MEASURES = r"(?:a?HR|a?OR|a?RR|IRR|SMD|MD|WMD|RD|aRD|beta|β|HR|OR|RR|PR|hazard\s+ratio|odds\s+ratio|risk\s+ratio|relative\s+risk|prevalence\s+ratio|rate\s+ratio|incidence\s+rate\s+ratio|standardised\s+mean\s+difference|mean\s+difference|risk\s+difference)"
UNITS = r"mg|mcg|µg|ug|kg|g|mL|ml|L|dL|cL|mmol|µmol|umol|IU|units?|mg/kg|mg/dL|mmol/L|mEq/L|bpm|mmHg|cm|mm|km|m"
TIMES = r"months?|weeks?|days?|years?|hours?|minutes?|hrs?|mins?|sessions?"
VERSION = r"\b[A-Za-z]{2,}(?:[-–][A-Za-z0-9]+)*[-–][0-9]{1,3}\b"
STRUCTURE = r"\b(?:fig(?:ure)?s?|tab(?:le)?s?|appendix|section|chapter|equation|eq|step|phase|stage|grade|type|class|version|scale|item|question|wave|round|group|arm|site|batch|model|session|visit|part|level)s?[.\s-]*[0-9]{1,3}\b"
UPPER_CASE_ONLY = {"OR", "MD", "HR", "RR", "PR", "RD", "IRR", "SMD", "WMD"}
SHORT = {"RELATIVERISK": "RR", "RISKRATIO": "RR", "HAZARDRATIO": "HR", "ODDSRATIO": "OR", "PREVALENCERATIO": "PR", "RATERATIO": "IRR", "INCIDENCERATERATIO": "IRR", "STANDARDISEDMEANDIFFERENCE": "SMD", "STANDARDIZEDMEANDIFFERENCE": "SMD", "MEANDIFFERENCE": "MD", "RISKDIFFERENCE": "RD"}
LARGEST_MEASURE, SMALLEST_INTEGER = 1000.0, 20
#: (kind, pattern without what may not stand before it, whether a letter, digit, _ or . may not, groups that are numbers, group of the unit, case matters). The order is that of ownership.
KINDS = [
    ("p_value", rf"\bp\s*([<>=]|≤|≥)\s*({NUMBER})", False, (2,), 0, False),
    ("measure", rf"\b({MEASURES})\b\s*\)?\s*[:=,]?\s*([-+−–]?{NUMBER})", False, (2,), 0, False),
    ("range", rf"({NUMBER})\s*(?:–|—|-|to|and)\s*({NUMBER})\s?(%|‰)", True, (1, 2), 3, False),
    ("confidence_interval", r"\b(?:95|90|99)\s?%\s*(?:CI|confidence\s+interval)", False, (), 0, False),
    ("percent", rf"({NUMBER})\s?(?:%|‰|\bpercent\b|\bper\s?cent\b)", True, (1,), 0, False),
    ("fraction", rf"\b({NUMBER})\s*/\s*({NUMBER})\b", False, (1, 2), 0, True),
    ("count", rf"\bn\s*=\s*({NUMBER})", False, (1,), 0, False),
    ("unit", rf"({NUMBER})\s?({UNITS})\b", True, (1,), 2, False),
    ("duration", rf"({NUMBER})\s?({TIMES})\b", True, (1,), 2, False),
    ("year", r"\b(1[6-9][0-9]{2}|20[0-9]{2})\b", False, (1,), 0, True),
    ("number", rf"({NUMBER})", True, (1,), 0, True),
]
# End of fixed values.
_COMPILED = [(kind, re.compile((r"(?<![\w.])" if apart else "") + pattern, 0 if case else re.IGNORECASE), numbers, unit) for kind, pattern, apart, numbers, unit, case in KINDS]
_MASKS = [re.compile(VERSION), re.compile(STRUCTURE, re.IGNORECASE)]
_SPANS = "kind string, raw string, start int, end int, low double, high double, measure string, unit string, checkable boolean"
_ARROW = pa.schema([(x.split(" ")[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[x.split(" ")[1]]) for x in _SPANS.split(", ")])


class Owned:
    """Half-open spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Takes the span unless a part of it is owned."""
        at = bisect_left(self.ends, start + 1)
        if at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def value_of(token: str) -> float:
    """1,730 has a thousands separator, 0,49 a decimal comma; a minus sign or dash in front is a sign."""
    sign = -1.0 if token[0] in "-−–" else 1.0
    whole, comma, part = token.lstrip("+-−–").partition(",")
    return sign * float(whole + part if comma and len(part) == 3 else f"{whole}.{part}" if comma else whole)


def masked(text: str) -> str:
    """The digits of version labels (ICD-11) and structural references (Figure 2) become spaces; nothing moves."""
    for pattern in _MASKS:
        text = pattern.sub(lambda m: re.sub("[0-9]", " ", m[0]), text)
    return text


def owned_quantities(text: str) -> list[tuple]:
    """Rows of _SPANS in order of start."""
    text, owned, out = masked(text), Owned(), []
    for kind, pattern, numbers, unit in _COMPILED:
        for m in pattern.finditer(text):
            values = [value_of(m[g]) for g in numbers]
            measure = {"p_value": "p", "confidence_interval": "CI", "count": "N"}.get(kind, "")
            if kind == "p_value":
                measure += m[1]
            elif kind == "measure":
                core = m[1][1:] if m[1][:1] in "aA" and len(m[1]) > 1 else m[1]
                # "or 12 weeks" is no odds ratio, a percentage after a label isn't its value, and a large integer is an identifier
                if (core.upper() in UPPER_CASE_ONLY and core != core.upper()) or text[m.end() : m.end() + 1] == "%" or abs(values[0]) >= LARGEST_MEASURE:
                    continue
                key = m[1].upper().replace(" ", "")
                measure = SHORT.get(key, key)
            if owned.take(*m.span()):
                known = kind not in ("confidence_interval", "year") and (kind != "number" or abs(values[0]) >= SMALLEST_INTEGER or values[0] != int(values[0]))
                low, high = (values + [None, None])[:2]
                out.append((kind, m[0], *m.span(), low, high, measure, "%" if kind == "percent" else m[unit] if unit else "", known))
    return sorted(out, key=lambda r: r[2])


def quantity_spans(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, kind, raw, start, end, low, high, measure, unit, checkable): the numeric statements of each text, by code points from 0 (SCA05).

    Kinds take their matches in the order of KINDS, and a match that meets an owned character is dropped whole. Labels and references are
    masked first. Texts without a digit never leave the JVM; the rest is scanned batch by batch, n matches in n log n. A null or empty
    text has none; rows of repeated or null keys are rows like others.
    """
    rows = texts.select(*keys, F.col(text_col).alias("_text")).where(F.col("_text").rlike("[0-9]"))
    schema = ", ".join([*(f"`{k}` {t}" for k, t in rows.dtypes[:-1]), _SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _ARROW
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                got = owned_quantities(text)
                at += [i] * len(got)
                found += got
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True))], names=[*keys, *kinds.names])

    return rows.mapInArrow(run, schema)


_NAMED = re.compile(r"(?:9[059](?<![0-9]..)|(?:1[6-9]|20)[0-9]{2}(?<![0-9]....))(?![0-9])")
_DIGITS = str.maketrans("123456789", "333333333")
#: Texts of one shape whose places are kept by a worker.
SHAPES = 1 << 14


def shape_of(text: str) -> str:
    """The text with 3 for each digit from the first one of a number on that isn't 0, but 2000 for each number that can be a year and 95 for each that can be an interval's level.

    All that the patterns and owned_quantities ask of digits is where they stand, whether a number is one of those that KINDS name, and whether a value
    reaches 1000, that is, how many digits it has without its leading zeros. So texts of one shape have the same quantities at the same places.
    """
    out = text.translate(_DIGITS)
    while "30" in out:
        out = out.replace("30", "33")
    for m in _NAMED.finditer(text):
        start, end = m.span()
        out = f"{out[:start]}{'95' if end - start == 2 else '2000'}{out[end:]}"
    return out


def quantity_notes(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, n, q): how many numeric statements the texts of each key have, and these as kind:raw@start, in order of start, joined by | (SCA05).

    As quantity_spans, in one line for a key: rows are dealt and sorted by key before their texts are made. Texts that are written alike
    are searched once in a worker: the places are those of their shape. Null texts have none; a key without any is left out.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key).select(key, text.alias("_text")).where(F.col("_text").rlike("[0-9]"))
    kind = dict(dealt.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, int, int, str]]] = {}
        last, found, several = None, [], False

        def line() -> tuple:
            return last, len(found), "|".join([x for _, x in (sorted(found) if several else found)])

        def made(out: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (like, pa.int64(), pa.string()), strict=True)], names=[key, "n", "q"])

        for batch in batches:
            out = []
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = shape_of(x)
                places = known.get(shape)
                if places is None:
                    if len(known) >= SHAPES:
                        known.clear()
                    places = known[shape] = [(f"{r[0]}:", r[2], r[3], f"@{r[2]}") for r in owned_quantities(shape)]
                told = [(start, f"{name}{x[start:end]}{place}") for name, start, end, place in places]
                if found and own == last:
                    found, several = found + told, True
                    continue
                if found:
                    out.append(line())
                last, found, several = own, told, False
            like = batch.schema.field(0).type
            yield made(out, like)
        if found:
            yield made([line()], like)

    return dealt.mapInArrow(run, f"`{key}` {kind}, n long, q string")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Rows of left and right, (keys, start, end, ...) each, whose half-open spans share a position, with their common span (from, to) (SRC20).

    Every span is dealt to the bins of `width` that it meets and a pair is taken in the first bin that both meet, so a key with any number of
    spans is split by bins, and no pair comes twice. Of columns with one name, other than the keys, right's ends in _right. Empty spans
    and null keys or ends meet nothing.
    """
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns if c not in keys}
    right = right.select(*keys, *(F.col(c).alias(n) for c, n in names.items()))

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))

    start, end = names["start"], names["end"]
    both = dealt(left, "start", "end").join(dealt(right, start, end), [*keys, "_bin"])
    low, high = F.greatest(F.col("start"), F.col(start)), F.least(F.col("end"), F.col(end))
    return both.where((low < high) & (F.col("_bin") == F.floor(low / width))).select(*left.columns, *names.values(), low.alias("from"), high.alias("to"))


def line_spans(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, line, start, end): the lines of each text from 0, without their ends, by code points; an empty line is an empty span, a null text has none. Keys are unique; offsets are running sums over a text's lines."""
    rows = texts.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "_text"))
    rows = rows.select(*keys, "line", F.char_length("_text").alias("_n"))
    before = F.coalesce(F.sum(F.col("_n") + 1).over(W.partitionBy(*keys).orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select(*keys, "line", before.alias("start"), (before + F.col("_n")).alias("end"))

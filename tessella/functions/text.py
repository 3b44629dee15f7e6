"""Text expressions: tokens, sentences, identifiers, numbers and markup, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that are no content words.
STOPWORDS = """
a about above after again against all also am an and any are aren't as at be
because been before being below between both but by can cannot could couldn't
did didn't do does doesn't doing don't down during each few for from further
had hadn't has hasn't have haven't having he her here hers herself him himself
his how however i if in into is isn't it its itself just let's me more most
mustn't my myself no nor not of off on once only or other ought our ours
ourselves out over own same shan't she should shouldn't so some such than that
the their theirs them themselves then there these they this those through to
too under until up very was wasn't we were weren't what when where which while
who whom why with won't would wouldn't you your yours yourself yourselves thus
therefore whereas moreover furthermore although though within without upon may
might must shall will can using used use based results study paper research
""".split()

# The words of a sentence's frame.
FUNCTION_WORDS = """
a an the this that these those and or but nor so yet for of in on at by with from to
into during after before while when where which who whom whose if whether than then
as is are was were be been being am do does did done have has had having will would
shall should can could may might must not no there here it its their his her our your
my we they he she you i them us him one such other more most much many few all both
each every any some only own same very also however therefore thus hence although
because since unless until about above below between among within without across
""".split()

TOKEN = r"[a-z0-9][a-z0-9'\-]*"


def plain(text: Column) -> Column:
    """Lower-case text without addresses and markup characters."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"[*_`#>\[\]()]", " "))


def strip(text: Column) -> Column:
    """Without white space at either end; Spark's own trim leaves line ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """All tokens, in order (SCA01)."""
    return F.regexp_extract_all(plain(text), F.lit(f"({TOKEN})"))


def content(words: Column) -> Column:
    """Tokens that carry content: longer than two characters and no stopwords (SCA01)."""
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8) -> DataFrame:
    """(id, pos, sentence) with at least `least` tokens (SCA02).

    Headings, table rows and addresses are dropped; a blank line ends a sentence, and so does . ! or ? before a capital,
    a digit, a quote or a parenthesis.
    """
    bare = F.regexp_replace(F.col(text_col), r"(?m)^[ \t]*#.*$", "")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*\|.*$", "")
    bare = F.regexp_replace(bare, r"https?://\S+", " ")
    blocks = F.posexplode(F.split(bare, r"\n\s*\n"))
    out = docs.select(F.col(id_col).alias("id"), blocks.alias("block", "body"))
    folded = F.trim(F.regexp_replace("body", r"\s+", " "))
    out = out.select("id", "block", F.posexplode(F.split(folded, r"(?<=[.!?]) (?=[A-Z0-9\"'(])")).alias("pos", "sentence"))
    return out.where(F.size(tokens(F.col("sentence"))) >= least)


def keyphrase(words: Column, most: int = 12) -> Column:
    """The distinct content tokens, longest first, then in order of appearance (TOP01)."""
    distinct = F.array_distinct(content(words))
    ranked = F.transform(distinct, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda s: s["w"])


def number_key(value: Column) -> Column:
    """The form in which numbers are compared: integers exactly, others to six significant digits (JOIN02)."""
    return F.when(value == F.floor(value), F.concat(F.lit("i"), value.cast("decimal(38,0)").cast("string"))).otherwise(F.concat(F.lit("f"), F.format_string("%.6e", value)))


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles (SCA06)."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(\d),(\d{3})", "$1$2"), F.lit(r"(-?\d+(?:\.\d+)?)")), lambda x: x.cast("double"))


def doi_key(value: Column) -> Column:
    """A DOI without address, prefix and closing punctuation, in lower case; null if there is none (SCA10)."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    bare = F.regexp_replace(bare, r"[.,;]+$", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def title_key(value: Column) -> Column:
    """A title as lower-case letters and digits with single spaces (SCA10)."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " "))


def identifier_kind(value: Column) -> Column:
    """doi, arxiv, pmid, pmcid or title (SCA09)."""
    v = F.trim(value)
    return (
        F.when(doi_key(v).isNotNull(), "doi")
        .when(v.rlike(r"(?i)^(arxiv:\s*|https?://arxiv\.org/abs/)?\d{4}\.\d{4,5}(v\d+)?$"), "arxiv")
        .when(v.rlike(r"(?i)^pmc\d+$"), "pmcid")
        .when(v.rlike(r"(?i)^(pmid:\s*)?\d{1,8}$"), "pmid")
        .otherwise("title")
    )


def find_dois(text: Column) -> Column:
    """Distinct DOIs of a text in order of appearance (SCA09, SRC11)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(10\.\d{4,9}/[^\s\"<>]+)")), lambda x: F.regexp_replace(x, r"[.,;:)\]]+$", "")))


def is_placeholder(value: Column) -> Column:
    """Cells that say nothing (SCA16)."""
    return F.coalesce(F.lower(F.trim(value)).isin("", "na", "n/a", "none", "null", "tbd", "todo", "unknown", "-", "?", "xxx"), F.lit(True))


def query_terms(query: str, stop: bool = True) -> list[str]:
    """Distinct lower-case words of a query; stopwords go unless nothing else is left (SCA12)."""
    import re

    words = list(dict.fromkeys(re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)*", query.lower())))
    kept = [w for w in words if w not in STOPWORDS]
    return kept if stop and kept else words


def variants(term: str) -> list[str]:
    """Singular and plural of a term (SCA13)."""
    out = [term]
    if term.endswith("ies") and len(term) > 4:
        out.append(term[:-3] + "y")
    elif term.endswith("ses") or term.endswith("xes"):
        out.append(term[:-2])
    elif term.endswith("s") and not term.endswith("ss"):
        out.append(term[:-1])
    elif term.endswith("y") and term[-2:-1] not in "aeiou":
        out.append(term[:-1] + "ies")
    else:
        out.append(term + "s")
    return out


def html_text(html: Column) -> Column:
    """Prose of a page: no comments, scripts, tables or markup; block tags end paragraphs (SRC05)."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style|noscript|svg|math|head)\b.*?</(script|style|noscript|svg|math|head)\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<table\b.*?</table\s*>", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|section|article|li|ul|ol|h[1-6]|br|tr|blockquote|header|footer|nav|main)\b[^>]*>", "\n\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t\r\x0B\f]+", " "), r" ?\n[\n ]*", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, r"^[\n ]+|[\n ]+$", ""), r" ([.,;:!?])", "$1")


def host(url: Column) -> Column:
    """The host without user, www. and port (SRC19)."""
    x = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(x, r"^www\.", ""), F.lit(""))


# Words whose point ends no sentence.
ABBREVIATIONS = "dr mr mrs ms prof st vs etc fig figs eq ref refs no vol al approx e.g i.e cf".split()


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, sentence) with sentence = text[start:end] (SCA03).

    A sentence ends after . ! ? or their full-width forms, with closing quotes and brackets, before white space and anything
    but a lower-case letter; not after an abbreviation, a single initial or within a number. A blank line is a hard end.
    The parts that are found tile the whole text, so offsets are sums of lengths.
    """
    spared = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    end = rf"(?:(?<!\b(?i:{spared}))(?<!(?:^|[\s(])[A-Z])\.|[!?])[!?.]*[\"'”’)\]]*(?=\s+[^\sa-z])|[。！？]+[”’」』]*|\n[ \t]*\n\s*"
    parts = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"(?s)(.+?(?:{end}|$))"))
    rows = docs.select(F.col(id_col).alias("id"), F.filter(parts, lambda p: p != "").alias("p"))
    rows = rows.select("id", "p", F.posexplode("p").alias("i", "part"))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^\s+", ""))
    rows = rows.select("id", (before + lead).alias("start"), strip(F.col("part")).alias("sentence")).where("sentence <> ''")
    return rows.select("id", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


#: Wordy phrases and what they say, in order (FLT13).
REWRITES = [
    (r"(?i)\bin order to\b", "to"), (r"(?i)\bdue to the fact that\b", "because"), (r"(?i)\ba large number of\b", "many"), (r"(?i)\bat this point in time\b", "now"), (r"(?i)\bin the event that\b", "if"),
    (r"(?i)\bwith regard to\b", "about"), (r"(?i)\bprior to\b", "before"), (r"(?i)\bsubsequent to\b", "after"), (r"(?i)\butili[sz]e\b", "use"),
]


def plainer(text: Column, spare: Column | None = None) -> Column:
    """The text with wordy phrases replaced, unless `spare` holds: what an overlap report has flagged stays as it is (FLT13)."""
    out = text
    for pattern, by in REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return out if spare is None else F.when(spare, text).otherwise(out)


def front_matter(text: Column) -> Column:
    """The key: value lines between the first two lines of --- as a map; null where there are none (FLT15)."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.when(block != "", F.map_from_entries(pairs))

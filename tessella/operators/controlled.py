"""Controlled English by line: rules, with marks that suppress a rule on the line after them (FLT12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What begins an instruction, and what looks like it (FLT12).
VERBS = """
add append apply ask assert audit build calculate call check choose cite classify clear collect combine compare compile complete
confirm connect convert copy count create decide declare define delete describe detect determine disable display do document download
draft drop emit enable ensure enter estimate exclude execute exit expand export extract fail fetch filter find flag fix follow format
gather generate give group handle identify import include inspect install keep label list load locate log look make map mark match
measure merge move name normalize note number open order output parse pass perform pick place plan populate post prepare print process
produce provide publish pull push query rank rate read re-check re-run rebuild recompute record reduce refetch refresh regenerate
reject reload remove rename render reorder repeat replace report request require reset resolve restart restore resume return review
rewrite round run save scan score search select send separate set show skip sort split start state stop store strip submit subtract
summarize supply switch take test tokenize trace track transform trim truncate try turn uninstall unwrap update upload use validate
verify view wait warn wrap write yield
""".split()
NO_INSTRUCTIONS = "see note notes example examples caution warning important tip source sources".split()
# Participles that name a state.
STATES = """
required needed used allowed expected based limited defined given taken hidden written read set closed open done known unknown present
absent available unavailable enabled disabled supported unsupported affected selected
""".split()
# Capitals that are words, and abbreviations that need no definition.
CAPITALS = """
WHAT WHEN WHERE WHY HOW NOTE NOTES STEP STEPS MUST SHOULD SHALL DO DOES NOT AND OR THE PASS FAIL OK ERROR ERRORS WARNING WARNINGS RULE
RULES GATE GATES STATUS INPUT OUTPUT FILE FILES TABLE TABLES LIST LISTS TEST TESTS ALL ANY TRUE FALSE READY DONE NEXT FIRST LAST ONLY
NOW THEN WITH FROM INTO OVER MORE LESS NULL NONE EMPTY YES RUN USE ADD SET GET PUT POST NEW OLD TOP BOTTOM LEFT RIGHT START END OPEN
CLOSED HERE THERE THIS THAT THESE THOSE ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN EVERY EACH SOME BOTH SAME OTHER
""".split()
ACRONYMS = """
OK NA ID PDF HTML JSON YAML MCP API URL DOI PMID PMC CSV TXT MD AI LLM CLI OS PC STE ORI XML HTTP HTTPS SQL UTF DOCX XLSX PPTX GB MB
KB MS UTC GMT IEEE ACM APA MLA NLM ISO ORCID
""".split()
# Terms of the glossary and what stands for them.
GLOSSARY = {
    "utilize": "use",
    "utilise": "use",
    "leverage": "use",
    "in order to": "to",
    "prior to": "before",
    "subsequent to": "after",
    "ascertain": "find",
    "commence": "start",
    "approximately": "about",
    "a number of": "some",
    "in the event that": "if",
    "for the purpose of": "to",
}
# Periods that end no sentence, forms of "to be", contractions, and the mark.
PERIODS = "e[.]g|i[.]e|vs|etc|no|fig|eq|al|approx|cf|resp|pp|dr|st|mr|ms|inc|ltd"
BE = "is|are|was|were|be|been|being"
NOT = "don|doesn|isn|aren|wasn|weren|can|won|couldn|shouldn|wouldn|hasn|haven|hadn|mustn|ain|shan"
WHO = "it|that|there|here|they|we|you|he|she|who|what|let|this|these|those"
MARK = "ste-allow"

#: A character of a word, in every regex dialect alike; what bounds a word; white space.
_IN = r"A-Za-z0-9_\x80-\x{10FFFF}"
_B, _E, _S = rf"(?:^|[^{_IN}])", rf"(?:[^{_IN}]|$)", r"[\x20\x09-\x0D]"
LINE_END = r"\r\n|\n|\r"
TABLE_ROW = rf"^{_S}*\|.*\|{_S}*$"
COMMENT = rf"^{_S}*<!--.*-->{_S}*$"
BULLET = rf"^{_S}*(?:[-*+]|[0-9]+[.)]){_S}+"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9'’/_.-]*"
RUN = rf"[{_IN}]+"
ORDERED = rf"{_B}(?:MUST|SHALL|DO NOT|NEVER){_E}"
SEQUENCE = rf"(?i);|{_B}then{_E}|,{_S}*[A-Za-z0-9_]+{_S}+(?:and{_S}+)?[A-Za-z0-9_]+(?:ing|ed){_E}"
# The separators are doubled before these are looked for, so that two matches never share one.
CONTRACTION = rf"(?i){_B}(?:(?:{NOT})(?:''|’’)t|(?:{WHO})(?:''|’’)(?:s|re|ve|ll|d)){_E}"
PROGRESSIVE = rf"(?i){_B}(?:{BE}){_S}+([a-z]+ing){_E}"
PASSIVE = rf"(?i){_B}(?:{BE}){_S}+(?:[a-z]+ly{_S}+)?([a-z]+(?:ed|en)){_E}"
ABBREVIATION = "^[A-Z][A-Z0-9]{1,5}$"
DEFINED = (r"\(([A-Z][A-Z0-9]{1,5})\)", rf"(?:^|[^{_IN}])([A-Z][A-Z0-9]{{1,5}}){_S}+\([A-Za-z][^)]{{5,90}}\)")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_S}+|{_S}+$", "")


def prose_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """(id, line_no, line, allows): the prose of every line, and the rules that a mark on the lines of marks before it allows.

    Front matter, fenced code, table rows and comments become empty lines, inline code the word "code", so line numbers stay. A
    mark holds for the one line after it, even where that line is empty or no prose.
    """
    by, upto = W.partitionBy("id"), W.partitionBy("id").orderBy("line_no")
    raw = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_END)).alias("p", "raw")).select("id", (F.col("p") + 1).alias("line_no"), "raw", trimmed(F.col("raw")).alias("bare"))
    opens = F.max((F.col("line_no") == 1) & (F.col("bare") == "---")).over(by)
    closes = F.min(F.when((F.col("line_no") > 1) & (F.col("bare") == "---"), F.col("line_no"))).over(by)
    meta = raw.withColumn("meta", opens & (F.col("line_no") <= F.coalesce(closes, F.lit(1))))
    fence = ~F.col("meta") & F.col("bare").startswith("```")
    is_mark = F.col("bare").startswith("<!--")
    told = F.filter(F.transform(F.split(F.array_join(F.regexp_extract_all("raw", F.lit(rf"{mark}{_S}+([A-Z0-9, ]+):"), 1), ","), ","), trimmed), lambda r: r != "")
    state = meta.select("id", "line_no", "raw", "meta", is_mark.alias("is_mark"), fence.alias("fence"), F.when(is_mark, told).alias("told"), (F.sum(F.when(fence, 1).otherwise(0)).over(upto) % 2 == 1).alias("fenced"), (F.sum(F.when(is_mark, 0).otherwise(1)).over(upto) + F.when(is_mark, 1).otherwise(0)).alias("target"))
    gone = F.col("meta") | F.col("fence") | F.col("fenced") | F.col("raw").rlike(TABLE_ROW) | F.regexp_replace("raw", "`[^`]*`", "code").rlike(COMMENT)
    line = F.when(gone, "").otherwise(F.regexp_replace(F.regexp_replace("raw", "`[^`]*`", "code"), "<!--.*?-->", ""))
    allows = F.array_distinct(F.flatten(F.collect_list("told").over(W.partitionBy("id", "target"))))
    return state.select("id", "line_no", line.alias("line"), F.when(~F.col("is_mark"), allows).otherwise(F.array().cast("array<string>")).alias("allows"))


def prose_sentences(lines: DataFrame) -> DataFrame:
    """(id, block, start, at, line_no, sentence, n_in_block): sentences of each run of lines that aren't empty, headings left out; start is the first line of the run, line_no the one a sentence begins on."""
    blank = trimmed(F.col("line")) == ""
    numbered = lines.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(W.partitionBy("id").orderBy("line_no"))).where(~blank)
    blocks = numbered.groupBy("id", "block").agg(F.min("line_no").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", BULLET, "").alias("l")))), lambda x: x["l"]), "\n").alias("whole"))
    held = F.regexp_replace("whole", rf"(?i)({_B})({PERIODS})[.]", "$1$2\x02")
    pieces = F.split(F.regexp_replace(held, rf"([.!?]{_S}+)", "$1\x01"), "\x01")
    cut = blocks.where(~trimmed(F.col("whole")).startswith("#")).select("id", "block", "start", F.posexplode(pieces).alias("at", "piece"))
    before = F.coalesce(F.sum(F.regexp_count("piece", F.lit("\n"))).over(W.partitionBy("id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    led = F.regexp_count(F.regexp_extract("piece", rf"^{_S}*", 0), F.lit("\n"))
    text = F.regexp_replace(F.translate(trimmed(F.col("piece")), "\x02", "."), "\n", " ")
    full = cut.select("id", "block", "start", "at", (F.col("start") + before + led).cast("int").alias("line_no"), text.alias("sentence")).where("sentence <> ''")
    return full.withColumn("n_in_block", F.count(F.lit(1)).over(W.partitionBy("id", "block")))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", glossary: dict[str, str] | None = None, mark: str = MARK) -> DataFrame:
    """(id, line_no, rule, detail): one row for each violation.

    R1: above 20 words in an instruction, 25 in another sentence (detail: words). R2: two instructions in a sequence. R3: a paragraph of
    more than six sentences, at its first line. R4: contraction. R5: progressive form of a known verb. R6: passive form, one by one,
    but for states. R8: an abbreviation used before its definition, or twice and more without one, at its first use. R9: a term that
    the glossary replaces. R10: three or more instructions not in a sequence. R7, noun clusters, can't be
    decided without parts of speech and is left out. A sentence begins with an instruction if its first word is one of VERBS, or if it has MUST, SHALL, DO NOT
    or NEVER. Ids are unique; null text is empty; other columns are ignored. All work on a document is behind one shuffle by its id,
    but for abbreviations, which are counted by document and word.
    """
    terms = GLOSSARY if glossary is None else glossary
    lines = prose_lines(docs, id_col, text_col, mark)
    s = prose_sentences(lines)
    tokens = F.regexp_extract_all("sentence", F.lit(f"({TOKEN})"), 1)
    doubled = F.regexp_replace("sentence", rf"([^{_IN}])", "$1$1")
    words = F.transform("tokens", F.lower)
    counted = s.select("id", "line_no", "sentence", tokens.alias("tokens"), doubled.alias("doubled"))
    is_verb = lambda w: w.isin(VERBS) & ~w.isin(NO_INSTRUCTIONS)
    heads = F.size(F.filter(words, is_verb))
    told = counted.withColumn("told", (F.size("tokens") > 0) & (F.col("sentence").rlike(ORDERED) | F.coalesce(is_verb(F.lower(F.get("tokens", F.lit(0)))), F.lit(False)))).withColumn("heads", F.when(F.col("told"), heads).otherwise(0))
    hit = lambda cond, rule, detail: F.when(cond, F.array(F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))
    each = lambda found, rule: F.transform(found, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("detail")))
    sequence = F.col("sentence").rlike(SEQUENCE)
    doing = F.lower(F.regexp_extract("doubled", PROGRESSIVE, 1))
    stem = F.substring(doing, F.lit(1), F.length(doing) - 3)
    known = stem.isin(VERBS) | F.concat(stem, F.lit("e")).isin(VERBS) | F.substring(stem, F.lit(1), F.length(stem) - 1).isin(VERBS)
    passive = F.filter(F.transform(F.regexp_extract_all("doubled", F.lit(PASSIVE), 1), F.lower), lambda w: ~w.isin(STATES))
    say = lambda t: F.col("doubled").rlike(rf"(?i){_B}{'[ ][ ]'.join(t.split())}{_E}")
    any_term = rf"(?i){_B}(?:{'|'.join('[ ][ ]'.join(t.split()) for t in terms)}){_E}" if terms else "^\x00"
    avoided = F.when(F.col("doubled").rlike(any_term), F.array_compact(F.array(*(F.when(say(t), F.lit(t)) for t in terms)))).otherwise(F.array().cast("array<string>")) if terms else F.array().cast("array<string>")
    found = F.concat(
        hit(F.size("tokens") > F.when(F.col("told"), 20).otherwise(25), "R1", F.size("tokens")),
        hit((F.col("heads") >= 2) & sequence, "R2", F.col("heads")),
        hit((F.col("heads") >= 3) & ~sequence, "R10", F.col("heads")),
        hit(F.col("doubled").rlike(CONTRACTION), "R4", F.lit("")),
        hit((doing != "") & known, "R5", doing),
        each(passive, "R6"),
        each(avoided, "R9"),
    )
    by_line = told.select("id", "line_no", F.explode(found).alias("f")).select("id", "line_no", "f.*")
    long_ = s.where("n_in_block > 6").groupBy("id", "block").agg(F.min("start").alias("line_no"), F.max("n_in_block").cast("string").alias("detail")).select("id", "line_no", F.lit("R3").alias("rule"), "detail")
    allows = lines.where(F.size("allows") > 0).select("id", "line_no", F.explode("allows").alias("rule"))
    plain = by_line.unionByName(long_).join(allows, ["id", "line_no", "rule"], "left_anti")
    return plain.select("id", "line_no", "rule", "detail").unionByName(_abbreviations(lines, s, allows))


def _abbreviations(lines: DataFrame, sentences: DataFrame, allows: DataFrame) -> DataFrame:
    """R8: the first use of each abbreviation is judged, a use that a mark allows included."""
    apart = lambda c: F.filter(F.regexp_extract_all(c, F.lit(f"({RUN})"), 1), lambda w: w.rlike(ABBREVIATION) & ~w.isin(CAPITALS) & ~w.isin(ACRONYMS))
    used = sentences.select("id", "line_no", F.explode(F.array_distinct(apart("sentence"))).alias("detail")).groupBy("id", "detail").agg(F.min("line_no").alias("line_no"))
    n = lines.select("id", F.explode(apart("line")).alias("detail")).where(~F.col("detail").rlike("[0-9]")).groupBy("id", "detail").agg(F.count(F.lit(1)).alias("n"))
    given = lines.select("id", "line_no", F.explode(F.concat(*(F.regexp_extract_all("line", F.lit(p), 1) for p in DEFINED))).alias("detail")).groupBy("id", "detail").agg(F.min("line_no").alias("given"))
    judged = used.join(n, ["id", "detail"], "left").join(given, ["id", "detail"], "left")
    wrong = judged.where(F.when(F.col("given").isNotNull(), F.col("line_no") < F.col("given")).otherwise(F.coalesce("n", F.lit(0)) >= 2))
    return wrong.select("id", "line_no", F.lit("R8").alias("rule"), "detail").join(allows, ["id", "line_no", "rule"], "left_anti").select("id", "line_no", "rule", "detail")

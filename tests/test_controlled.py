"""Controlled English by line: cases by hand, and lines and marks against a loop."""

from __future__ import annotations

import random
import re

from tessella.operators import controlled as C


def _check(spark, cases, **more):
    """Each text alone gives these (line_no, rule, detail)."""
    docs = spark.createDataFrame([(i, text, "x") for i, (text, _) in enumerate(cases)], "doc_id long, text string, line string")
    got = {}
    for r in C.line_rules(docs, **more).collect():
        got.setdefault(r.id, []).append((r.line_no, r.rule, r.detail))
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [want for _, want in cases]


def test_rules_by_hand(spark):
    words = " ".join(["tea"] * 21)
    cases = [
        (f"Run {words}.\n\nThe {words}.", [(1, "R1", "22")]),
        ("Run it, then check it.", [(1, "R2", "2")]),
        ("Build check and run all.", [(1, "R10", "3")]),
        ("One. Two. Three. Four. Five. Six.\n\nA. B. C.\nD. E. F. G.", [(3, "R3", "7")]),
        ("Tea.\nIt's old; we don’t know.", [(2, "R4", "")]),
        ("It is running. It is missing.", [(1, "R5", "running")]),
        ("It was added was quickly found was given.\nIt is required.", [(1, "R6", "added")]),
        ("It was added was removed.", [(1, "R6", "added"), (1, "R6", "removed")]),
        ("We use it prior to tea, in order\nto utilize it.", [(1, "R9", "in order to"), (1, "R9", "prior to"), (1, "R9", "utilize")]),
    ]
    _check(spark, cases)
    _check(spark, [("We sip tea.", [(1, "R9", "tea")])], glossary={"tea": "chai", "coffee": ""})
    _check(spark, [("We utilize tea.", [])], glossary={})


def test_abbreviations(spark):
    cases = [
        ("The XQZ is one.", []),
        ("The XQZ is\none. So is XQZ. So is PDF, and PDF.", [(1, "R8", "XQZ")]),
        ("The XQZ.\nThe plain query (XQZ).", [(1, "R8", "XQZ")]),
        ("XQZ (a plain query) is one.\nXQZ again.", []),
        ("A1 and A1 are labels. MUST MUST.", []),
        ("# XQZ\n\nThe XQZ here.", [(3, "R8", "XQZ")]),
        ("<!-- ste-allow R8: name -->\nThe XQZ.\nXQZ again.", []),
    ]
    _check(spark, cases)


def test_marks_hold_for_the_next_line_only(spark):
    cases = [
        ("<!-- ste-allow R4: a quote -->\nIt's old.\nIt's new.", [(3, "R4", "")]),
        ("<!-- ste-allow R4: lost on the empty line -->\n\nIt's old.", [(3, "R4", "")]),
        ("<!-- ste-allow R4: lost on the row -->\n| row |\nIt's old.", [(3, "R4", "")]),
        ("<!-- ste-allow R4: a -->\n<!-- ste-allow R6, R9: b -->\nIt's added and was added to utilize.", []),
        ("<!-- ste-allow R6: another rule -->\nIt's old.", [(2, "R4", "")]),
    ]
    _check(spark, cases)


def test_what_is_no_prose(spark):
    cases = [
        ("---\nname: it's\n---\nIt's.", [(4, "R4", "")]),
        ("---\nIt's.", [(2, "R4", "")]),
        ("```\nIt's\n```\nTea `it's` tea. <!-- it's -->\n| it's |\n<!-- it's -->\nIt's.\n```\nit's", [(7, "R4", "")]),
        ("# It's a heading\n\n- It's an item", [(3, "R4", "")]),
        ("Tea vs. it's one sentence, e.g. this. It's two.\r\nIt's three.", [(1, "R4", ""), (1, "R4", ""), (2, "R4", "")]),
    ]
    _check(spark, cases)


def test_odd_rows(spark):
    _check(spark, [(text, []) for text in (None, "", "\n\n", "```", "---", "<!-- ste-allow R4: at the end -->")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.line_rules(empty).count() == 0
    long_ = "It's one. " * 20_000
    one = spark.createDataFrame([(1, long_)], "doc_id long, text string")
    assert C.line_rules(one).count() == 20_001


def test_lines_and_marks_equal_a_loop(spark):
    rng = random.Random(3)
    parts = ["tea", "", "```", "---", "| a |", "<!-- c -->", "<!-- ste-allow R1: x -->", "<!-- ste-allow R2, R3: x -->", "  ```py", "a `b` <!-- d --> e"]
    texts = {i: "\n".join(rng.choices(parts, k=rng.randrange(1, 12))) for i in range(300)}
    want = set()
    for i, text in texts.items():
        lines, out = text.split("\n"), []
        close = next((n for n, x in enumerate(lines) if n and x == "---"), 0) if lines[0] == "---" else -1
        fenced, held = False, set()
        for n, x in enumerate(lines):
            body = x
            if n <= close:
                body = ""
            elif x.strip().startswith("```"):
                fenced, body = not fenced, ""
            elif fenced or x.startswith(("| ", "<!--")):
                body = ""
            body = re.sub("<!--.*?-->", "", re.sub("`[^`]*`", "code", body))
            if x.startswith("<!--"):
                held |= {r.strip() for r in "".join(re.findall("ste-allow ([^:]*):", x)).split(",")} - {""}
                out.append((body, ()))
            else:
                out.append((body, tuple(sorted(held))))
                held = set()
        want |= {(i, n + 1, *o) for n, o in enumerate(out)}
    got = C.prose_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.id, r.line_no, r.line, tuple(sorted(r.allows))) for r in got} == want

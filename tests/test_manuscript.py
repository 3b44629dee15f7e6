"""Lines of manuscripts: wording and numbers by hand."""

from __future__ import annotations

from tessella.operators import manuscript as M


def _check(spark, run, cases, columns):
    docs = spark.createDataFrame([(i, text, "x") for i, (text, _) in enumerate(cases)], "doc_id long, text string, line string")
    got = {}
    for r in run(docs).collect():
        got.setdefault(r.id, []).append(tuple(r[c] for c in columns))
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [sorted(want) for _, want in cases]


def test_line_issues(spark):
    cause, absolute, over = "CAUSAL_CLAIM_WITHOUT_HEDGE", "ABSOLUTE_LANGUAGE", "OVERCLAIMING_LANGUAGE"
    cases = [
        ("Tea causes sleep.\nTea may cause sleep.", [(1, cause)]),
        ("Causes of sleep. Causing of causing of tea.", []),
        ("Causes of causes are old.", [(1, cause)]),
        ("The cause was found; it causes sleep.", []),
        ("It led to tea.\nIt results in tea.\nIt did not lead to tea.\nBecause of the treatment it slept.", [(1, cause), (2, cause), (4, cause)]),
        ("It causesé sleep. Becaused.", []),
        ("It always works; it is unprecedented.", [(1, absolute), (1, over)]),
        ("Allways. Game-changing. Cures the disease, no side effects.", [(1, over)]),
        ("```\nTea causes sleep.\n```\nTea causes sleep.", [(4, cause)]),
        ("a.b@c.org, 555-123-4567, (555) 123-4567, MRN", [(1, "POSSIBLE_PHI_EMAIL"), (1, "POSSIBLE_PHI_PHONE"), (1, "POSSIBLE_PHI_MRN")]),
        ("5555-123-45678 a@b", []),
        ("Dr. B saw Mr Lee, patient AB12, born on Monday.", [(1, "POSSIBLE_PHI_PATIENT_INITIALS"), (1, "POSSIBLE_PHI_NAMED_PATIENT"), (1, "POSSIBLE_PHI_DOB")]),
        ("tea " * 55 + "\n" + "tea " * 56 + "\n" + "tea " * 40 + "ends. " + "tea " * 40, [(2, "VERY_LONG_SENTENCE")]),
        ("one\r\nTea causes sleep.\rTea causes sleep.", [(2, cause), (3, cause)]),
        (None, []),
        ("", []),
    ]
    _check(spark, M.line_issues, cases, ("line_no", "code"))


def test_number_issues(spark):
    drift, several = "effect differs within claim", "several percentages in claim"
    cases = [
        ("5/40 (12.5%), 5 / 40 (12%), 12.5% (5/40), 1,000/2,000 (50%)", []),
        ("7/40 (12%) and 51% (2/4)", [(1, "percent differs", "7/40 (12%"), (1, "percent differs", "51% (2/4)")]),
        ("9/4 (10%)\n7/0 (5%)", [(1, "numerator above denominator", "9/4 (10%"), (2, "zero denominator", "7/0 (5%")]),
        ("120% of 100% and 100.1%", [(1, "above 100 percent", "120"), (1, "above 100 percent", "100.1")]),
        ("HR 0.80 (95% CI 0.70 to 0.91); -1.5 (90% CI -2 to -1)", []),
        ("0.80 (95% CI 0.91 to 0.70)\n2.0 (95% CI: 0.7–0.9)", [(1, "bounds inverted", "0.80 (95% CI 0.91 to 0.70)"), (2, "estimate outside", "2.0 (95% CI: 0.7–0.9)")]),
        ("1.5, 95% CI 1.9 to 2.1", [(1, "estimate outside", "1.5, 95% CI 1.9 to 2.1")]),
        ("# 7/0 (5%)\n| 7/0 (5%) |\n```\n7/0 (5%)\n```", []),
        ("90 MG/DL\nand 5 mmol/L", [(0, "mixed units", "mg/dL and mmol/L")]),
        ("HR 0.8 [claim:C001]\nhazard ratio of 0.9 [claim:C001]\nOR 2 [claim:C001]", [(0, drift, "C001 hr")]),
        ("HR 0.8 [claim:C001] [claim:C002]\naHR 0.8 [claim:C002]\nHR 0.7 [claim:C001]", []),
        ("12% [claim:C001]\n13 % [claim:C001], 13% [claim:C001]", [(0, several, "C001")]),
        (None, []),
        ("", []),
    ]
    _check(spark, M.number_issues, cases, ("line_no", "code", "detail"))
    docs = spark.createDataFrame([(1, "| 7/0 (5%) |")], "doc_id long, text string")
    assert M.number_issues(docs, headings=True).count() == 1
    assert M.number_issues(docs.limit(0)).count() == 0 and M.line_issues(docs.limit(0)).count() == 0

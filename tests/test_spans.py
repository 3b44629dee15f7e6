"""Span ownership and overlaps against plain definitions."""

from __future__ import annotations

import random

import pytest

from tessella.operators import spans as S

#: (text, [(kind, raw, values)]): what a reader would say.
CASES = [
    ("HR 0.49 (95% CI 0.30 to 0.71), p = 0.03", [("measure", "HR 0.49", 0.49, None), ("confidence_interval", "95% CI", None, None), ("number", "0.30", 0.3, None), ("number", "0.71", 0.71, None), ("p_value", "p = 0.03", 0.03, None)]),
    ("We included 45/120 (37.5%) of records.", [("fraction", "45/120", 45, 120), ("percent", "37.5%", 37.5, None)]),
    ("9-90% of them", [("range", "9-90%", 9, 90)]),
    ("ICD-11 and DSM-5, see Figure 2 and phase 3.", []),
    ("Treatment continued for 6 or 12 weeks", [("number", "6", 6, None), ("duration", "12 weeks", 12, None)]),
    ("Variables OR 95% CI", [("confidence_interval", "95% CI", None, None)]),
    ("Fort Detrick MD 21702", [("number", "21702", 21702, None)]),
    ("risk ratio (RR) 1.42 and relative risk 2,5", [("measure", "RR) 1.42", 1.42, None), ("measure", "relative risk 2,5", 2.5, None)]),
    ("beta = −0.22; MD -0.4", [("measure", "beta = −0.22", -0.22, None), ("measure", "MD -0.4", -0.4, None)]),
    ("n = 1,730 in 2019 took 5 mg", [("count", "n = 1,730", 1730, None), ("year", "2019", 2019, None), ("unit", "5 mg", 5, None)]),
    ("p<0.05%", [("p_value", "p<0.05", 0.05, None)]),
    ("1.2.3 and x5 and .5", [("number", "1.2", 1.2, None)]),
    ("", []),
]


def test_cases(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)] + [(None, None), (99, "no digit")]
    got = {}
    for r in S.quantity_spans(spark.createDataFrame(rows, "id int, text string").repartition(3), ["id"]).collect():
        got.setdefault(r.id, []).append(r)
    for i, (text, want) in enumerate(CASES):
        mine = sorted(got.get(i, []), key=lambda r: r.start)
        assert [(r.kind, r.raw, r.low, r.high) for r in mine] == [(k, raw, pytest.approx(a) if a is not None else None, b) for k, raw, a, b in want]
        assert all(text[r.start : r.end] == r.raw for r in mine)
    assert {r.measure for r in got[7]} == {"RR"} and [r.checkable for r in sorted(got[4], key=lambda r: r.start)] == [False, True]


def test_owner_is_the_first_kind_that_comes():
    """Every match of every kind, taken one by one and compared with all that is owned."""
    rng = random.Random(6)
    parts = ["HR 0.4", "or 12", "p = 0.03", "10-20%", "95% CI", "45/120", "n = 30", "5 mg", "6 weeks", "2019", "3.5", "%", " ", ", ", "(", ")", "OR", "MD 21702", "ICD-11", "Table 3", "é7", "1,730", "-"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(25)))
        taken = []
        for kind, pattern, *_ in S._COMPILED:
            for m in pattern.finditer(S.masked(text)):
                raw = m[0]
                if kind == "measure":
                    core = m[1][1:] if m[1][0] in "aA" else m[1]
                    if core.upper() in S.UPPER_CASE_ONLY and core != core.upper() or S.masked(text)[m.end() :][:1] == "%" or abs(S.value_of(m[2])) >= 1000:
                        continue
                if all(m.end() <= a or b <= m.start() for a, b, *_ in taken):
                    taken.append((m.start(), m.end(), kind, raw))
        assert [(r[2], r[3], r[0], r[1]) for r in S.owned_quantities(text)] == sorted(taken)


def test_many_spans_are_taken_in_time():
    import time

    began = time.perf_counter()
    assert len(S.owned_quantities("12 mg, 45/120 " * 20_000)) == 40_000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_overlaps(spark, width):
    rng = random.Random(width)
    sides = [[(rng.choice(["a", "a", "b", None]), s, s + rng.randrange(0, 40), f"{k}{i}") for i in range(60) for s in [rng.randrange(200)]] for k in "lr"]
    left, right = (spark.createDataFrame(x, "k string, start int, end int, name string") for x in sides)
    want = sorted((x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in sides[0] for y in sides[1] if x[0] == y[0] is not None and max(x[1], y[1]) < min(x[2], y[2]))
    got = S.overlaps(left, right, ["k"], width)
    assert got.columns == ["k", "start", "end", "name", "start_right", "end_right", "name_right", "from", "to"]
    assert sorted((r["name"], r["name_right"], r["from"], r["to"]) for r in got.collect()) == want


def test_line_spans(spark):
    texts = ["a\n\nbé\U0001f600\n", "", None, "one"]
    got = S.line_spans(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).collect()
    want = [(0, 0, 0, 1), (0, 1, 2, 2), (0, 2, 3, 6), (0, 3, 7, 7), (1, 0, 0, 0), (3, 0, 0, 3)]
    assert sorted((r.id, r.line, r.start, r.end) for r in got) == want

"""Pairs of reviews by brute force, and without an exchange of pairs before they are counted."""

from __future__ import annotations

import random

from tessella.operators import synthesis as S


def test_pairs_by_brute_force(spark):
    rng = random.Random(3)
    marks = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([*range(12), None])) for _ in range(60)]
    frame = spark.createDataFrame(marks, "review string, study int")
    of = {r: {s for x, s in marks if x == r} for r in "abcde"}
    want = {(a, b): (n, round(n / min(len(of[a]), len(of[b])), 4)) for a in of for b in of if a < b and (n := len((of[a] & of[b]) - {None}))}
    out = S.review_overlap(frame)
    assert {(r.a, r.b): (r.shared, r.share) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(review" in plan and "Join Inner, (study" not in plan

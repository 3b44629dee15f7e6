"""Analyses that SQL can't express, against the same written out."""

from __future__ import annotations

import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import tails as T
from tessella.operators import agreement as A
from tessella.operators import moderators as M


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, study long, c long, yi double, sei double")


def _poisson(x, df):
    """P(X >= x) of even degrees of freedom in 60 decimal digits."""
    with decimal.localcontext(prec=60):
        h = term = total = decimal.Decimal(1)
        h = decimal.Decimal(x) / 2
        for j in range(1, df // 2):
            term = term * h / j
            total += term
        return float(total * (-h).exp())


def test_chi2_tail(spark):
    zs = [i / 9 for i in range(1, 360)] + [38.5, 39.0, 45.0, 160.0, 250.0, 1000.0]
    cases = [(z * z, 1, math.erfc(z / math.sqrt(2))) for z in zs]
    cases += [(x, df, _poisson(x, df)) for df in (2, 4, 10, 64, 1000, 100_000) for x in (1e-9, 0.3 * df, 0.97 * df, 1.0 * df, 1.02 * df, 1.5 * df, 2000.0)]
    cases += [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0.0, 3, 1.0), (-1.0, 3, 1.0), (float("inf"), 3, 0.0)]
    got = spark.createDataFrame([(x, k) for x, k, _ in cases], "x double, k int").coalesce(1).select(T.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([p for *_, p in cases], abs=1e-12)
    # where a tail is small, its digits are right, too
    assert [r.p / p for r, (*_, p) in zip(got, cases, strict=True) if 1e-300 < p < 0.01] == pytest.approx([1.0] * sum(1e-300 < p < 0.01 for *_, p in cases), rel=1e-9)
    assert spark.sql("SELECT cast(null AS double) x, 3 k UNION ALL SELECT 1.0D, 0 UNION ALL SELECT double('NaN'), 2").select(T.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect() == [(None,)] * 3


def test_t_tails_and_quantiles(spark):
    closed = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))}
    cases = [(s * t, df, f(t)) for df, f in closed.items() for t in (0.0, 0.01, 0.5, 1.0, 3.3, 40.0) for s in (1, -1)] + [(1.959963984540054, 10**9, 0.05), (float("inf"), 5, 0.0)]
    frame = spark.createDataFrame(cases, "t double, df long, want double").coalesce(1)
    got = frame.select(T.t_two_sided(F.col("t"), F.col("df")).alias("p"), "want").collect()
    assert [r.p for r in got] == pytest.approx([r.want for r in got], abs=1e-9) and got[0].p == 1.0
    factors = {1: 12.706204736174694, 2: 4.302652729749464, 5: 2.5705818356363146, 12: 2.178812829667228, 100: 1.9839715185235556}
    got = spark.createDataFrame([(k,) for k in factors], "df int").select("df", T.t_quantile(F.lit(0.05), F.col("df")).alias("t")).collect()
    assert {r.df: r.t for r in got} == pytest.approx(factors, rel=1e-10)


def test_strong_evidence_has_a_p_of_nothing(spark):
    rows = [("a", i, i, 25.0 + i % 3 / 10, 0.1) for i in range(40)] + [("one", 1, 1, 0.5, 0.1)] + [("same", i, i, 0.5, 0.1) for i in range(3)]
    frame = _frame(spark, rows)
    assert {r.g: r.p < 1e-5 for r in M.inference(frame, ["g"]).collect()} == {"a": True, "one": True, "same": True}
    got = {r.g: r for r in M.hartung_knapp(frame, ["g"]).collect()}
    assert got["a"].p < 1e-12 and got["a"].low < 25.1 < got["a"].high
    assert (got["one"].se, got["one"].p, got["same"].p, got["same"].low) == (None, None, None, None) and got["one"].estimate == pytest.approx(0.5)


def test_cr2_with_whole_matrices(spark):
    rng = random.Random(3)
    rows = [("a", i, i % 5, rng.gauss(0.3, 0.5), rng.uniform(0.1, 0.5)) for i in range(23)] + [("b", i, i, rng.gauss(0, 1), 0.2) for i in range(4)] + [("one", i, 1, 0.1 * i, 0.2) for i in range(4)]
    got = {r.g: r for r in M.cluster_cr2(_frame(spark, rows), ["g"], "c").collect()}
    assert set(got) == {"a", "b"} and got["a"].clusters == 5 and got["a"].caution
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        y, v, c = (np.array([r[i] for r in own]) for i in (3, 4, 2))
        v = v**2
        w = 1 / v
        mean = (w @ y) / w.sum()
        tau = max(0, (w @ (y - mean) ** 2 - len(y) + 1) / (w.sum() - w @ w / w.sum()))
        phi = np.diag(v + tau)
        w = np.linalg.inv(phi)
        x = np.ones((len(y), 1))
        m = np.linalg.inv(x.T @ w @ x)
        b = m @ x.T @ w @ y
        rest = np.eye(len(y)) - x @ m @ x.T @ w
        vcov, p = np.zeros((1, 1)), []
        for j in sorted(set(c)):
            at = c == j
            d = np.linalg.cholesky(phi[np.ix_(at, at)]).T
            inner = d @ (rest @ phi @ rest.T)[np.ix_(at, at)] @ d.T
            values, vectors = np.linalg.eigh(inner)
            a = d.T @ vectors @ np.diag([1 / math.sqrt(z) if z > 1e-10 else 0 for z in values]) @ vectors.T @ d
            e = m @ x[at].T @ w[np.ix_(at, at)] @ a @ (y - x @ b)[at]
            vcov += np.outer(e, e)
            p.append((m @ x[at].T @ w[np.ix_(at, at)] @ a @ rest[at]).ravel())
        omega = np.array(p) @ phi @ np.array(p).T
        assert got[g].estimate == pytest.approx(b[0], abs=1e-9)
        assert got[g].se == pytest.approx(math.sqrt(vcov[0, 0]), abs=1e-7)
        assert got[g].df == pytest.approx(np.trace(omega) ** 2 / (omega**2).sum(), rel=1e-6)


def test_trim_and_fill(spark):
    even = [("even", i, 0, 0.5 + s * 0.1 * i, 0.05 * i + 0.05) for i in range(1, 9) for s in (1, -1)]
    cut = [("cut", *r[1:]) for r in even if not (r[3] < 0.5 and r[1] > 4)]
    few = [("few", *r[1:]) for r in even[:6]]
    got = {r.g: r for r in M.trim_and_fill(_frame(spark, even + cut + few), ["g"]).collect()}
    assert set(got) == {"even", "cut"}
    assert got["even"].k0 == 0 and got["even"].estimate == pytest.approx(0.5)
    plain = {r.g: r.estimate for r in M.inference(_frame(spark, cut), ["g"]).collect()}
    assert got["cut"].side == "left" and 3 <= got["cut"].k0 <= 5 and abs(got["cut"].estimate - 0.5) < abs(plain["cut"] - 0.5)


def test_bootstrap_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(1.0 if k % 3 else 0.0, 1), k % 3 > 0) for k in range(600)] + [(0.5, True)] * 300
    df = spark.createDataFrame(rows, "s double, p boolean")
    a, b = (A.bootstrap_auc(df.repartition(n), "s", "p").first() for n in (1, 7))
    assert a == b and a.reps == 2000
    pos, neg = (np.array([s for s, x in rows if x is y]) for y in (True, False))
    draw = np.random.default_rng(1)
    own = []
    for _ in range(400):
        x, y = draw.choice(pos, len(pos)), np.sort(draw.choice(neg, len(neg)))
        own.append((np.searchsorted(y, x) + np.searchsorted(y, x, "right")).sum() / 2 / len(x) / len(y))
    assert a.low == pytest.approx(np.percentile(own, 2.5), abs=0.01) and a.high == pytest.approx(np.percentile(own, 97.5), abs=0.01)

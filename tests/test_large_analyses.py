"""Analyses of many studies: refits, clusters and walks that don't take rows squared."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import citations_graph as G
from tessella.operators import moderators as M


def _refit(y, v):
    w = 1 / v
    mean = w @ y / w.sum()
    tau = max(0.0, (w @ (y - mean) ** 2 - len(y) + 1) / (w.sum() - w @ w / w.sum()))
    w = 1 / (v + tau)
    return w @ y / w.sum(), 1 / np.sqrt(w.sum())


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_refits_one_by_one(spark, spread):
    """Analyses of 3 to 3,000 studies, a study that outweighs all others, and variances over twelve orders of magnitude."""
    rng = random.Random(5)
    rows = [(g, i, rng.gauss(0.3, spread + 0.05), s(i)) for g, k, s in (("a", 3000, lambda i: rng.uniform(0.05, 0.5)), ("b", 3, lambda i: 0.2), ("c", 2000, lambda i: 1e-3 if i == 7 else 0.3), ("d", 1500, lambda i: 10 ** rng.uniform(-3, 3))) for i in range(k)]
    got = {(r.g, r.study): r for r in M.refits(spark.createDataFrame(rows, "g string, study long, yi double, sei double"), ["g"], "study").collect()}
    assert len(got) == len(rows)
    for g in "abcd":
        y, s = (np.array([r[j] for r in rows if r[0] == g]) for j in (2, 3))
        for i in {*range(min(len(y), 40)), len(y) - 1, int(np.argmax(y)), int(np.argmin(s))}:
            estimate, se = _refit(np.delete(y, i), np.delete(s, i) ** 2)
            assert (got[g, i].estimate, got[g, i].se) == (pytest.approx(estimate, rel=1e-8, abs=1e-9), pytest.approx(se, rel=1e-8))


def test_refits_of_repeated_and_null_studies(spark):
    rows = [("a", i // 2 if i < 40 else None, 0.1 * (i % 7), 0.2 + 0.01 * i) for i in range(45)] + [("one", 1, 0.1 * i, 0.2) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, study long, yi double, sei double")
    got = {r.study: r for r in M.refits(frame, ["g"], "study").collect()}
    assert set(got) == set(range(20))
    y, v = np.array([r[2] for r in rows if r[0] == "a"]), np.array([r[3] for r in rows if r[0] == "a"]) ** 2
    for study in got:
        n = d = 0.0
        for i in range(45):
            if rows[i][1] == study:
                w = np.delete(1 / v, i)
                q, c = w @ np.delete(y, i) ** 2 - (w @ np.delete(y, i)) ** 2 / w.sum(), w.sum() - w @ w / w.sum()
                x = 1 / (v + max(0.0, (q - 43) / c))
                others = np.array([r[1] is not None and r[1] != study for r in rows[:45]])
                n, d = n + (x * y)[others].sum(), d + x[others].sum()
        assert got[study].estimate == pytest.approx(n / d, rel=1e-9)


def test_fragility_of_many_studies(spark):
    began = time.perf_counter()
    rows = spark.range(60_000).select(F.lit("a").alias("g"), F.col("id").alias("study"), (F.rand(1) - 0.4).alias("yi"), (F.rand(2) / 4 + 0.05).alias("sei"))
    got = M.fragility(rows, ["g"], "study").first()
    assert got.refits == 60_000 and got.flips == 0 and 0.09 < got.least < got.most < 0.11
    assert time.perf_counter() - began < 60


def test_cr2_of_large_clusters(spark):
    """Against the inverse roots of whole matrices."""
    rng = np.random.default_rng(7)
    sizes = [700, 300, 1, 2, 40]
    c = np.repeat(np.arange(5), sizes)
    y, s = rng.normal(0.3, 0.4, len(c)), 10 ** rng.uniform(-2, 1, len(c))
    got = M.cluster_cr2(spark.createDataFrame([("a", int(i), float(a), float(b)) for i, a, b in zip(c, y, s, strict=True)], "g string, c long, yi double, sei double"), ["g"], "c").first()
    v, w = s**2, s**-2
    mean = w @ y / w.sum()
    phi = v + max(0.0, (w @ (y - mean) ** 2 - len(y) + 1) / (w.sum() - w @ w / w.sum()))
    m, mean = 1 / (1 / phi).sum(), (y / phi).sum() / (1 / phi).sum()
    ee, gs = 0.0, []
    for j in range(5):
        at = np.flatnonzero(c == j)
        root = np.sqrt(phi[at])
        values, vectors = np.linalg.eigh(np.diag(phi[at] ** 2) - m * np.outer(root, root))
        weight = m * (vectors @ ((vectors.T @ (1 / root)) / np.sqrt(values))) * root
        ee += (weight @ (y[at] - mean)) ** 2
        whole = -weight.sum() * m / phi
        whole[at] += weight
        gs.append(whole)
    omega = (np.array(gs) * phi) @ np.array(gs).T
    assert (got.estimate, got.se, got.df, got.clusters, got.caution) == (pytest.approx(mean, abs=1e-9), pytest.approx(np.sqrt(ee), rel=1e-8), pytest.approx(np.trace(omega) ** 2 / (omega**2).sum(), rel=1e-6), 5, True)


def test_cr2_of_a_cluster_of_many_rows(spark):
    began = time.perf_counter()
    rows = spark.range(40_000).select(F.lit("a").alias("g"), (F.col("id") % 2).alias("c"), (F.rand(3) - 0.4).alias("yi"), (F.rand(4) / 4 + 0.05).alias("sei"))
    got = M.cluster_cr2(rows, ["g"], "c").first()
    assert got.clusters == 2 and 0.09 < got.estimate < 0.11 and 0 < got.se < 0.1
    assert time.perf_counter() - began < 60


def test_walks_from_a_hub(spark):
    """Walks that all stand at a record of many neighbours, whose ids are texts."""
    began = time.perf_counter()
    n = 30_000
    edges = spark.range(n).select(F.lit("hub").alias("src"), F.concat(F.lit("x"), F.format_string("%05d", "id")).alias("dst"))
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    cited = spark.range(n).select(F.concat(F.lit("x"), F.format_string("%05d", "id")).alias("id"), (F.col("id") % 100).alias("n"))
    seeds = spark.range(20_000).select(F.col("id").alias("walk"), F.lit("hub").alias("id"))
    got = G.walk(edges, cited, seeds, 6)
    kinds = {r.step: (r.id, r.move, r.n) for r in got.groupBy("step", "id", "move").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {0: ("hub", "seed", 20_000)} | {k: (f"x{(k + 1) // 2 * 100 - 1:05d}", "forward", 20_000) if k % 2 else ("hub", "back", 20_000) for k in range(1, 7)}
    assert time.perf_counter() - began < 60

"""Components of links that come in two parts, and how many rounds and queries that takes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import graph, minhash
from tessella.llm.graph import components, merged


def _want(edges):
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return {i: x for i, x in label.items() if x != i}


def _got(df):
    rows = df.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.label for r in rows}


@pytest.fixture
def written(monkeypatch):
    """How many tables are written by the rounds."""
    n = []

    def stored(df, f=graph.stored):
        n.append(1)
        return f(df)

    monkeypatch.setattr(graph, "stored", stored)
    return n


@pytest.mark.parametrize(("edges", "tables"), [([], 1), ([(5, 2), (5, 2), (9, 2), (4, 4), (8, 7)], 1), ([(6, x) for x in (1, 3, 4, 7, 8, 9)], 2)])
def test_no_round_changes_nothing(spark, written, edges, tables):
    assert _got(components(spark.createDataFrame(edges, "a long, b long"))) == _want(edges)
    assert len(written) == tables


@pytest.mark.parametrize("seed", range(3))
def test_links_between_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    more = [(rng.randrange(120), rng.randrange(120)) for _ in range(25 * seed)]
    known = components(spark.createDataFrame(edges, "a long, b long"))
    label = _got(known)
    between = [(label.get(a, a), label.get(b, b)) for a, b in more]
    assert _got(merged(known, components(spark.createDataFrame(between, "a long, b long")))) == _want(edges + more)


def test_links_that_only_the_second_search_finds(spark, monkeypatch):
    """Their components get the labels of the first ones'; every pair is confirmed once and one way."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(14):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(100)] = word()
        texts += [" ".join(w), " ".join([*w[:97], word()]), " ".join(w[8:])]
    confirmed, searched = [], []

    def confirm(near, *rest, f=minhash._confirmed):
        confirmed.extend((r.a, r.b) for r in near.collect())
        out = f(near, *rest)
        searched.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_confirmed", confirm)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.minhash_dedup(docs, shingle_words=2).select("doc_id", F.col("component_id")).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == {i: i for i in range(len(texts))} | _want(edges)
    assert len(set(confirmed)) == len(confirmed) and all(a < b for a, b in confirmed)

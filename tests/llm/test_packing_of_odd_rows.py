"""No bin above capacity and no token lost, whatever rows repeat."""

from __future__ import annotations

from collections import Counter

import pytest

from tessella.llm import packing


def _checked(got, rows, capacity=packing.CAPACITY):
    bins, total = {}, Counter()
    for r in got:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
        total[r.doc_id] += r.n_tokens
    for pieces in bins.values():
        end = 0
        for at, n in sorted(pieces):
            assert at >= end
            end = at + n
        assert end <= capacity
    want = Counter()
    for i, n in rows:
        want[i] += max(n or 1, 1)
    assert total == want
    return bins


@pytest.mark.parametrize("shard", [3, 4096])
def test_repeated_and_null_ids(spark, shard):
    rows = [(1, 5000)] * 2 + [(None, 5000)] * 3 + [(None, 100)] * 40 + [(7, None), (8, 0), (9, 2048), (9, 4096), (10, 2049)] + [(1, 5000)]
    df = spark.createDataFrame([(i, n, "a", "one text", 5, "x") for i, n in rows], "doc_id long, n_tokens long, source string, cluster string, whole long, tie string").repartition(4)
    got = packing.pack(df, shard=shard).collect()
    bins = _checked(got, rows)
    whole = sorted(b for b in bins if b < 0)
    assert whole == list(range(-len(whole), 0)) and len(whole) == 2 * 6 + 1 + 1
    # all rows are of one source and one cluster, so no two remainders share a bin
    assert all(len(b) == 1 for b in bins.values())


@pytest.mark.parametrize("kind", ["string", "long", "struct<a:int>", "array<int>", "binary"])
def test_clusters_of_any_type(spark, kind):
    value = {"string": lambda k: f"c{k}", "long": lambda k: k, "struct<a:int>": lambda k: (k,), "array<int>": lambda k: [k, k], "binary": lambda k: bytes([k])}[kind]
    rows = [(i, 10 + i % 7, None, None if i % 5 == 0 else value(i % 3)) for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, f"doc_id long, n_tokens long, source string, cluster {kind}")).collect()
    _checked(got, [r[:2] for r in rows])
    inside = {}
    for r in got:
        inside.setdefault(r.bin_id, []).append(rows[r.doc_id][3])
    for clusters in inside.values():
        named = [str(c) for c in clusters if c is not None]
        assert len(named) == len(set(named))
    assert len(inside) == 24  # as many bins as the commonest cluster has rows


def test_empty_and_long(spark):
    schema = "doc_id long, n_tokens long, source string, cluster binary"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, 2048 * 300 + i) for i in range(5)]
    bins = _checked(packing.pack(spark.createDataFrame([(i, n, None, None) for i, n in rows], schema)).collect(), rows)
    assert sum(b < 0 for b in bins) == 1500 - 1  # document 0 has no remainder of its own: its last piece is a full one

"""Bounded walks against a walker that goes step by step."""

from __future__ import annotations

import random

import pytest

from conftest import SMALL
from tessella.operators import citations_graph as G
from tessella.plans import synthesis


def _by_hand(edges, nodes, seed, steps, most, direction, bias, depth_limit, floor):
    """edges: set of (src, dst); nodes: {id: (n, keep, words)}."""
    look = lambda i: nodes.get(i, (0, True, []))
    order = {"top_cited": lambda i: (-look(i)[0], i), "bottom_cited": lambda i: (look(i)[0], i)}[bias]

    def found(here, way):
        all_of = {d for s, d in edges if s == here != d} if way == "backward" else {s for s, d in edges if d == here != s}
        return sorted(sorted(all_of, key=lambda i: (-look(i)[0], i))[:most], key=order)

    def back():
        while stack:
            at, rest = stack.pop()
            if rest:
                if rest[1:]:
                    stack.append((at, rest[1:]))
                path.append(rest[0])
                return rest[0]
        return None

    here, path, seen, stack, went, asked = seed, [seed], [seed], [], [], set()
    count = dict.fromkeys(G.STATS, 0)
    for step in range(steps):
        way = {"forward": "forward", "backward": "backward", "alternating": ["backward", "forward"][step % 2], "parity": ["forward", "backward"][(sum(map(ord, here)) + step) % 2]}[direction]
        asked.add((here, way))
        some = found(here, way)
        kind = "cites" if way == "backward" else "cited_by"
        crossed = [i for i in some if i in seen]
        went += [(here, i, kind, True) for i in crossed]
        count["cross_edges"] += len(crossed)
        fresh = [i for i in some if i not in seen]
        kept = [i for i in fresh if look(i)[1]]
        count["pruned"] += len(fresh) - len(kept)
        own = set(look(seed)[2])
        near = [i for i in kept if floor is None or not own or len(own & set(look(i)[2])) >= floor * len(own | set(look(i)[2]))]
        if not near:
            count["dead_ends"] += 1
            to = back()
            if to is None:
                break
            here = to
            count["backtracks"] += 1
            continue
        went.append((here, near[0], kind, False))
        stack.append((here, near[1:]))
        depth = len(stack)
        here = near[0]
        seen.append(here)
        path.append(here)
        count["steps_completed"] += 1
        if depth_limit is not None and depth >= depth_limit and (to := back()) is not None:
            here = to
            count["backtracks"] += 1
    count |= {"unique_visited": len(set(seen)), "calls": 1 + len(asked)}
    return path, went, count


@pytest.mark.parametrize(("direction", "bias", "depth_limit", "floor", "most"), [("parity", "top_cited", None, None, 100), ("alternating", "bottom_cited", 2, None, 3), ("backward", "top_cited", 3, 0.3, 5), ("forward", "top_cited", 1, None, 2), ("parity", "bottom_cited", 4, 0.2, 4)])
def test_walks_by_hand(spark, direction, bias, depth_limit, floor, most):
    rng = random.Random(most)
    ids = [f"n{i}" for i in range(25)]
    edges = {(rng.choice(ids), rng.choice(ids + ["n0"] * 12)) for _ in range(70)}
    nodes = {i: (rng.randrange(5), rng.random() < 0.8, rng.sample("tea sleep study water".split(), rng.randrange(4))) for i in ids[:-3]}
    frame = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id string, n long, keep boolean, words array<string>")
    seeds = spark.createDataFrame([(k, i) for k, i in enumerate([*ids, "nowhere"])], "walk int, id string")
    both = spark.createDataFrame([*edges, *list(edges)[:9]], "src string, dst string")
    got = {r.walk: r for r in G.explore(both, frame, seeds, 7, most, direction, bias, depth_limit, floor).collect()}
    assert len(got) == 26
    for k, i in enumerate([*ids, "nowhere"]):
        path, went, count = _by_hand(edges, nodes, i, 7, most, direction, bias, depth_limit, floor)
        assert got[k].path == path and [tuple(e) for e in got[k].edges] == went
        assert {n: got[k][n] for n in G.STATS} == count


def test_a_hub_costs_its_candidates(spark):
    edges = spark.range(3000).selectExpr("concat('p', id) AS src", "if(id % 3 = 0, 'hub', concat('s', id % 50)) AS dst")
    nodes = spark.createDataFrame([("hub", 5, True, ["a"])], "id string, n long, keep boolean, words array<string>")
    index = G.candidate_index(edges, nodes, 10)
    assert index.where("here = 'hub'").selectExpr("direction", "size(found) AS n").collect() == [("forward", 10)]
    assert "WindowGroupLimit" in index._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="direction"):
        G.explore(edges, nodes, spark.createDataFrame([], "walk int, id string"), direction="up")


def test_the_queries_agree(spark):
    walks, edges = synthesis.citation_explorations(spark, SMALL).toPandas(), synthesis.citation_exploration_edges(spark, SMALL).toPandas()
    assert (walks.steps_completed > 0).mean() > 0.3 and edges[~edges.crossed].groupby("walk").size().sum() == walks.steps_completed.sum() and edges.crossed.sum() == walks.cross_edges.sum()

"""Citation graphs: neighbours within k steps, related records, bounded walks, vocabulary expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.storage import stored


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(id, depth): what is reached from seeds (id) within k steps along edges (src, dst), with the least depth (GRA01).

    Breadth first: each step joins the last frontier with the edges and drops what is known by an anti-join. Each frontier
    is a table in the shared folder, so a step computes nothing twice.
    """
    seen = frontier = stored(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, k + 1):
        frontier = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(frontier)
        seen = seen.unionByName(frontier)
    return seen


def related(edges: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, total): the best-scored neighbours of each, without itself and repeats; total counts them all (GRA02)."""
    one = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("score").alias("score"))
    by = W.partitionBy("src")
    return one.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("score"), "dst"))).where(F.col("k") <= most).select("src", "dst", "total")


def walk(edges: DataFrame, citations: DataFrame, seeds: DataFrame, steps: int = 30, depth_limit: int | None = None) -> DataFrame:
    """(walk, step, id, move): bounded walks from many seeds (walk, id) at once (GRA01).

    At each step a walk goes to the most cited neighbour (edges src, dst; citations id, n) that it hasn't visited; without one, or
    at the depth limit, back a step; at the seed it ends. move is seed, forward or back. A walk has visited no more ids than it has
    taken steps, and its seed, so of each record's neighbours as many, and one more, in order, are all that it can come to: they are ranked
    once and stored. A step of all walks is one join of their places with these; places, stacks and what was visited are a table in the
    shared folder. A walk's own state has as many ids as it takes steps.
    """
    first = seeds.select("walk", F.col("id").alias("here"), F.array("id").alias("stack"), F.array("id").alias("seen"), F.lit("seed").alias("move"), F.lit(0).alias("step"))
    state = stored(first)
    out = [state.select("walk", "step", F.col("here").alias("id"), "move")]
    known = edges.where("dst IS NOT NULL").select("src", "dst").distinct().join(citations.select(F.col("id").alias("dst"), "n"), "dst", "left").select(F.col("src").alias("here"), F.col("dst").alias("to"), F.coalesce("n", F.lit(0)).alias("n"))
    ranked = known.withColumn("k", F.row_number().over(W.partitionBy("here").orderBy(F.desc("n"), "to"))).where(F.col("k") <= steps + 1)
    ranked = stored(ranked.groupBy("here").agg(F.sort_array(F.collect_list(F.struct("k", "to")))["to"].alias("found")))
    for step in range(1, steps + 1):
        free = F.lit(True) if depth_limit is None else F.size("stack") <= depth_limit
        to = F.when(free, F.try_element_at(F.filter("found", lambda x: ~F.array_contains("seen", x)), F.lit(1)))
        both = state.join(ranked, "here", "left").withColumn("to", to)
        forward, back = F.col("to").isNotNull(), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0)))
        stack = F.when(forward, F.concat("stack", F.array("to"))).otherwise(back)
        new = both.select("walk", stack.alias("stack"), F.when(forward, F.concat("seen", F.array("to"))).otherwise(F.col("seen")).alias("seen"), F.when(forward, "forward").otherwise("back").alias("move"), F.lit(step).alias("step"))
        state = stored(new.where("size(stack) > 0").select("walk", F.element_at("stack", -1).alias("here"), "stack", "seen", "move", "step"))
        out.append(state.select("walk", "step", F.col("here").alias("id"), "move"))
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def walk_stats(path: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk, steps, forward, backtracks, visited, cross_edges) of walk()'s rows: cross edges join two visited ids without being walked forward (GRA01)."""
    place = W.partitionBy("walk").orderBy("step")
    moves = path.withColumn("src", F.lag("id").over(place))
    counts = moves.groupBy("walk").agg((F.count(F.lit(1)) - 1).alias("steps"), F.count_if(F.col("move") == "forward").alias("forward"), F.count_if(F.col("move") == "back").alias("backtracks"), F.count_distinct("id").alias("visited"))
    seen = path.select("walk", "id").distinct()
    inner = seen.select("walk", F.col("id").alias("src")).join(edges.select("src", "dst").distinct(), "src").join(seen.select("walk", F.col("id").alias("dst")), ["walk", "dst"])
    crossed = inner.join(moves.where("move = 'forward'").select("walk", "src", F.col("id").alias("dst")), ["walk", "src", "dst"], "left_anti").where("src <> dst").groupBy("walk").agg(F.count(F.lit(1)).alias("cross_edges"))
    return counts.join(crossed, "walk", "left").withColumn("cross_edges", F.coalesce("cross_edges", F.lit(0).cast("long")))


#: Rules of direction: forward is to what cites a record, backward to what it cites.
DIRECTIONS = ("forward", "backward", "alternating", "parity")
#: Orders in which candidates are taken.
BIASES = ("top_cited", "bottom_cited", "hashed")
STATS = ["steps_completed", "unique_visited", "backtracks", "dead_ends", "cross_edges", "pruned", "calls"]


def candidate_index(edges: DataFrame, nodes: DataFrame, most: int = 100, bias: str = "top_cited") -> DataFrame:
    """(here, direction, found): for each record and direction its `most` best cited neighbours, in the order in which a walk takes them (GRA01).

    edges (src, dst): src cites dst; nodes (id, n, keep, words): citations, whether filters let it pass, words of its title. The limit is
    applied before the exchange, task by task, and after it; so a hub of a third of all edges comes down to its candidates. Ids
    that nodes lack have no citations and no words and pass.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    both = e.select(F.col("src").alias("here"), F.lit("backward").alias("direction"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("here"), F.lit("forward").alias("direction"), F.col("src").alias("id")))
    both = both.join(nodes.select("id", "n", "keep", "words"), "id", "left").select("here", "direction", "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("keep", F.lit(True)).alias("keep"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    best = both.withColumn("_k", F.row_number().over(W.partitionBy("here", "direction").orderBy(F.desc("n"), "id"))).where(F.col("_k") <= most)
    first = {"top_cited": -F.col("n"), "bottom_cited": F.col("n"), "hashed": F.xxhash64("id")}[bias]
    listed = F.sort_array(F.collect_list(F.struct(first.alias("first"), "id", "keep", "words")))
    return best.groupBy("here", "direction").agg(listed.alias("found"))


def explore(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, steps: int = 30, most: int = 100, direction: str = "parity", bias: str = "top_cited", depth_limit: int | None = None, floor: float | None = None) -> DataFrame:
    """(walk, path, edges, STATS...): a bounded walk from each seed (walk, id), all at once (GRA01).

    A step looks the record's candidates up in one direction: alternating begins backward; parity goes forward if the sum of the id's
    characters and the step is even. Candidates visited before give cross edges; of the others those that filters let pass and whose
    words' Jaccard similarity with the seed's reaches `floor` (where both are given) remain, and the first in the order of `bias` is
    next. Without one, or at the depth limit, the walk goes back to the last record with candidates left and takes the next of these,
    which is on the path but not among the visited; with none left it ends. calls counts look-ups of a record in a direction, each once,
    and the seed's.

    A step is one join of the walks' places with candidate_index; the state of a walk is a row of a table in the shared folder and
    holds up to `steps` times `most` candidates and edges. Walks of a null id have no candidates.
    """
    if direction not in DIRECTIONS or bias not in BIASES:
        raise ValueError(f"direction is one of {DIRECTIONS}, bias one of {BIASES}")
    index = stored(candidate_index(edges, nodes, most, bias))
    kind, entry = dict(index.dtypes)["here"], dict(index.dtypes)["found"]
    told = nodes.select(F.col("id").alias("_seed"), F.col("words").alias("seed_words"))
    edge = f"array<struct<source:{kind},target:{kind},kind:string,crossed:boolean>>"
    state = seeds.select("walk", F.col("id").cast(kind).alias("here")).join(told, F.col("here") == F.col("_seed"), "left").select(
        "walk", "here", F.coalesce("seed_words", F.array().cast("array<string>")).alias("seed_words"), F.array("here").alias("visited"), F.array("here").alias("path"), F.array().cast(f"array<struct<id:{kind},rest:{entry}>>").alias("stack"),
        F.array().cast("array<string>").alias("asked"), F.array().cast(edge).alias("edges"), F.lit(False).alias("done"), *(F.lit(int(c == "calls")).alias(c) for c in STATS if c != "unique_visited"),
    )
    state = stored(state)
    c = F.col
    for step in range(steps):
        characters = F.aggregate(F.transform(F.split(c("here").cast("string"), ""), lambda x: F.ascii(x)), F.lit(0), lambda t, x: t + x)
        way = {"forward": F.lit("forward"), "backward": F.lit("backward"), "alternating": F.lit("forward" if step % 2 else "backward"), "parity": F.when((characters + step) % 2 == 0, "forward").otherwise("backward")}[direction]
        live = state.where("NOT done").withColumn("direction", way).join(index, ["here", "direction"], "left")
        key = F.concat_ws(":", "direction", c("here").cast("string"))
        label = F.when(c("direction") == "backward", "cites").otherwise("cited_by")

        def edge_to(target, crossed):
            return F.struct(c("here").alias("source"), target.alias("target"), c("label").alias("kind"), F.lit(crossed).alias("crossed"))

        live = live.withColumns({"found": F.coalesce("found", F.array().cast(entry)), "label": label, "calls": c("calls") + F.when(F.array_contains("asked", key), 0).otherwise(1), "asked": F.array_union("asked", F.array(key))})
        live = live.withColumns({"met": F.filter("found", lambda x: F.array_contains("visited", x["id"])), "fresh": F.filter("found", lambda x: ~F.array_contains("visited", x["id"]))})
        live = live.withColumn("kept", F.filter("fresh", lambda x: x["keep"]))
        near = c("kept") if floor is None else F.filter("kept", lambda x: (F.size("seed_words") == 0) | (F.size(F.array_intersect(x["words"], "seed_words")) >= floor * F.size(F.array_union(x["words"], "seed_words"))))
        live = live.withColumns({"near": near, "pruned": c("pruned") + F.size("fresh") - F.size("kept"), "cross_edges": c("cross_edges") + F.size("met"), "edges": F.concat("edges", F.transform("met", lambda x: edge_to(x["id"], True)))})
        on = F.size("near") > 0
        live = live.withColumns({"on": on, "next": F.try_element_at("near", F.lit(1))["id"], "forced": on & F.lit(depth_limit is not None) & (F.size("stack") + 1 >= (depth_limit or 0))})
        live = live.withColumn("pushed", F.when(c("on"), F.concat("stack", F.array(F.struct(c("here").alias("id"), F.slice("near", F.lit(2), F.greatest(F.size("near"), F.lit(1))).alias("rest"))))).otherwise(c("stack")))
        last = F.coalesce(F.array_max(F.transform("pushed", lambda x, i: F.when(F.size(x["rest"]) > 0, i + 1).otherwise(0))), F.lit(0))
        live = live.withColumn("last", last)
        live = live.withColumns({"turn": ~c("on") | c("forced"), "from": F.try_element_at("pushed", F.nullif("last", F.lit(0)))})
        live = live.withColumns({"back": c("turn") & (c("last") > 0), "rest": F.slice(c("from.rest"), F.lit(2), F.greatest(F.size("from.rest"), F.lit(1)))})
        before = F.slice("pushed", F.lit(1), F.greatest(c("last") - 1, F.lit(0)))
        returned = F.when(F.size("rest") > 0, F.concat(before, F.array(F.struct(c("from.id").alias("id"), c("rest").alias("rest"))))).otherwise(before)
        back_to = F.try_element_at("from.rest", F.lit(1))["id"]
        new = live.select(
            "walk", F.when(c("back"), back_to).when(c("on"), c("next")).otherwise(c("here")).alias("here"), "seed_words", F.when(c("on"), F.concat("visited", F.array("next"))).otherwise(c("visited")).alias("visited"),
            F.concat("path", F.when(c("on"), F.array("next")).otherwise(F.array().cast(f"array<{kind}>")), F.when(c("back"), F.array(back_to)).otherwise(F.array().cast(f"array<{kind}>"))).alias("path"),
            F.when(~c("turn"), c("pushed")).when(c("back"), returned).otherwise(F.slice("pushed", 1, 0)).alias("stack"), "asked", F.when(c("on"), F.concat("edges", F.array(edge_to(c("next"), False)))).otherwise(c("edges")).cast(edge).alias("edges"), (~c("on") & ~c("back")).alias("done"),
            (c("steps_completed") + c("on").cast("int")).alias("steps_completed"), (c("backtracks") + c("back").cast("int")).alias("backtracks"), (c("dead_ends") + (~c("on")).cast("int")).alias("dead_ends"), "cross_edges", "pruned", "calls",
        )
        state = stored(new.unionByName(state.where("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("walk", "path", "edges", *(F.size(F.array_distinct("visited")).alias(n) if n == "unique_visited" else c(n) for n in STATS))


def expand_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, term): each term with all synonyms of its concept (GRA03)."""
    concept = terms.join(synonyms, F.lower(terms.term) == F.lower(synonyms.synonym)).select("query_id", "concept")
    return concept.join(synonyms, "concept").select("query_id", F.lower("synonym").alias("term")).unionByName(terms.select("query_id", F.lower("term").alias("term"))).distinct()

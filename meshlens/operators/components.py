"""Strongly connected components of a table of directed pairs, and elementary cycles within them.

Nodes are proven to be of one component by what they reach and are reached by within some steps: by pairs of near
nodes while those are few, else by forward and backward colours, which need a row a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import weighed as cut

#: Rounds of one plan before it is cut.
STEPS = 2
#: Pairs of near nodes that are made at most, in times of the edges; where there are more, colours are spread.
PAIRS = 64
#: Rounds in which nodes without a way in or out are left out before chains of nodes are drawn together.
TRIMS = 3


def reaches() -> Iterator[int]:
    """How far colours go in each attempt: 2, 4, then 2, 4, 8, then 2, 4, 8, 16 and so on, so that near ones are tried often and far ones in the end."""
    last = 2
    while True:
        last += 1
        yield from (1 << k for k in range(1, last))


def _inner(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have one in and one out."""
    ends = edges.select(F.col("src").alias("n")).intersect(edges.select(F.col("dst").alias("n"))).hint("merge")
    return edges.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with their ends replaced by names (node, name), where they have one."""
    for end in ("src", "dst"):
        edges = edges.join(names.select(F.col("node").alias(end), F.col("name").alias("_name")), end, "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    return edges.select("src", "dst").distinct()


def _ends_of_chains(edges: DataFrame) -> DataFrame:
    """(node, name): nodes with one way out, and where the chain of such nodes leads; those whose chain runs in a circle are left out.

    Pointer jumping: the chain that is left halves each time, and a circle is what is left after as many jumps as the nodes' number has digits.
    """
    hooks = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("name")).filter("n = 1 AND name <> src").select(F.col("src").alias("node"), "name"))
    for _ in range(-(-max(1, hooks.count()).bit_length() // STEPS) + 1):
        for _ in range(STEPS):
            further = hooks.select(F.col("node").alias("name"), F.col("name").alias("_to"))
            hooks = hooks.join(further, "name", "left").select("node", F.coalesce("_to", "name").alias("name"))
        hooks = cut(hooks)
    return hooks.join(hooks.select(F.col("node").alias("name")), "name", "left_anti").select("node", "name")


def _on_cycles(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle; none are left of a graph without cycles, however deep, if its nodes fall into few chains.

    A node that has one way out is drawn into where it leads, which makes no cycle and ends none but to a loop;
    nodes without a way in or out go.  What was drawn into a node that went can't be on a cycle.
    """
    small, drawn = edges, edges.select(F.col("src").alias("node"), F.col("src").alias("name")).limit(0)
    before = -1
    while (now := small.count()) != before and now:
        before = now
        small = cut(_inner(small))
        chains = cut(_ends_of_chains(small))
        loops = small.join(chains.select(F.col("node").alias("src")), "src", "left_anti")  # a drawn node's one way out is what it was drawn along
        small = cut(_renamed(loops, chains))
        drawn = cut(drawn.join(chains.select(F.col("node").alias("name"), F.col("name").alias("_to")), "name", "left").select("node", F.coalesce("_to", "name").alias("name")).union(chains.select("node", "name")))
    alive = small.select(F.col("src").alias("name")).union(small.select(F.col("dst").alias("name"))).distinct().hint("merge")
    held = cut(alive.select(F.col("name").alias("node")).union(drawn.join(alive, "name", "left_semi").select("node")))
    return cut(edges.join(held.withColumnRenamed("node", "src"), "src", "left_semi").join(held.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))


def _same_colours(edges: DataFrame, reach: int, attempt: int) -> DataFrame:
    """(node, name): nodes that the same node reaches and is reached by, within `reach` steps: the one of the largest colour of all near ones on both ways.

    Colours are hashes of nodes, new in each attempt.  Each such pair is of one component, whatever else there is.
    """
    colour: Column = F.struct(F.xxhash64(F.col("node"), F.lit(attempt)).alias("h"), F.col("node").alias("of"))
    ways = cut(edges.select("src", "dst", F.lit(True).alias("forward")).union(edges.select(F.col("dst"), F.col("src"), F.lit(False))))
    seen = ways.select(F.col("src").alias("node"), "forward").union(ways.select(F.col("dst"), "forward")).distinct().withColumn("colour", colour)
    for step in range(reach):
        on = seen.withColumnRenamed("node", "src").join(ways, ["src", "forward"]).select(F.col("dst").alias("node"), "forward", "colour")
        seen = seen.unionByName(on).groupBy("node", "forward").agg(F.max("colour").alias("colour"))
        if step % STEPS == STEPS - 1:
            seen = cut(seen)
    both = seen.filter("forward").select("node", "colour").join(seen.filter("NOT forward").select("node", "colour"), ["node", "colour"])
    return both.select("node", F.col("colour.of").alias("name")).filter("node <> name")


def _mutual(edges: DataFrame, doublings: int) -> DataFrame | None:
    """(node, name): nodes that lesser ones reach and are reached by within 2**doublings steps, with the least; None if that takes too many pairs."""
    near, most = edges, PAIRS * edges.count()
    for _ in range(doublings):
        out = near.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("o"))
        into = near.groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("i")).hint("merge")
        if (out.join(into, "n").agg(F.sum(F.col("o") * F.col("i"))).first()[0] or 0) > most:
            return None
        on = near.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        near = cut(near.union(on).distinct())
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.join(back, ["src", "dst"], "left_semi").filter("dst < src").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("name"))


def _rooted(merged: DataFrame) -> DataFrame:
    """(node, name) with names that are no node's own: names lead to lesser ones, so they end."""
    while True:
        further = merged.select(F.col("node").alias("name"), F.col("name").alias("_to"))
        merged = cut(merged.join(further, "name", "left").select("node", F.coalesce("_to", "name").alias("name"), F.col("_to").isNotNull().alias("went")))
        if merged.filter("went").isEmpty():
            return merged.select("node", "name")
        merged = merged.select("node", "name")


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of all nodes in pairs (src, dst): component is the least node of those that reach each other.

    Attempts look ever farther, contract the nodes that are proven to be of one component, and end when what is left has
    no cycle.  So the rounds are of the order of the deepest component and not of the graph.  Loops, repeated pairs and
    empty tables are fine; pairs with a null end are left out.
    """
    pairs = cut(pairs.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    names = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct().withColumn("name", F.col("node"))
    edges, colours, attempt, stuck = pairs.filter("src <> dst"), reaches(), 0, False
    while True:
        n = edges.count()
        for _ in range(TRIMS if n else 0):
            edges, before = cut(_inner(edges)), n
            n = edges.count()
            if n in (0, before):
                break
        if n and stuck:
            edges = _on_cycles(edges)
            n = edges.count()
        if not n:
            break
        attempt += 1
        merged = _mutual(edges, attempt)
        merged = cut(_same_colours(edges, next(colours), attempt)) if merged is None else _rooted(merged)
        stuck = merged.isEmpty()
        names = cut(names.join(merged.select(F.col("node").alias("name"), F.col("name").alias("_to")), "name", "left").select("node", F.coalesce("_to", "name").alias("name")))
        edges = cut(_renamed(edges, merged).filter("src <> dst"))
    least = names.groupBy("name").agg(F.min("node").alias("component")).hint("merge")
    return names.join(least, "name").select("node", "component")


def elementary_cycles(pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """(path, length) of all elementary cycles of pairs (src, dst) without loops: closed paths from their least node on.

    Paths are walked inside components only, through nodes from which the start can still be reached without a lesser node:
    what can't come home is never walked.  A path never meets a node twice, which ends the rounds; their number is the
    longest cycle's.  The number of cycles is exponential by nature; `longest` bounds their length where that is wanted.
    """
    of = cut(strong_components(pairs))
    owner = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    inside = cut(pairs.select("src", "dst").distinct().filter("src <> dst").join(owner("src"), "src").join(owner("dst"), "dst").filter("_src = _dst").select("src", "dst"))
    front = cut(inside.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("node")))
    homes = [front]  # (start, node): node leads to start through nodes above it
    while not front.isEmpty():
        before = inside.select(F.col("src").alias("_node"), F.col("dst").alias("node")).join(front, "node").filter("_node > start").select("start", F.col("_node").alias("node")).distinct()
        front = cut(before.join(reduce(DataFrame.union, homes).hint("merge"), ["start", "node"], "left_anti"))
        homes.append(front)
    home = cut(reduce(DataFrame.union, homes))
    ways = home.select("start", F.col("node").alias("dst")).join(inside, "dst").select("start", F.col("src").alias("cur"), "dst")
    ways = cut(ways.filter("cur >= start").union(inside.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("cur"), "dst")))
    walk = ways.filter("cur = start").select("start", F.col("dst").alias("cur"), F.array("start", "dst").alias("path"))
    found, length = [], 1
    while (longest is None or length < longest) and not walk.isEmpty():
        length += 1
        on = walk.join(ways, ["start", "cur"]).filter((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst")))
        on = cut(on.select("start", F.col("dst").alias("cur"), F.array_append("path", F.col("dst")).alias("path")))
        found.append(on.filter("cur = start").select("path", F.lit(length).alias("length")))
        walk = on.filter("cur <> start")
    return reduce(DataFrame.union, found) if found else walk.select("path", F.lit(0).alias("length")).limit(0)

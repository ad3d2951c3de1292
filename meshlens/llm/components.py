"""Connected components of a table of links, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b: bigint): component is the least node that links reach.

    A round hooks every node of the contracted graph to its least neighbour, follows these pointers
    to their roots and replaces the ends of links by them; links within a root go.  The graph at
    least halves each round, and a star takes one.  Links of a node with itself, repeated links and
    an empty table are fine: nodes without another have no row.  Each round's tables go to the shared
    checkpoint folder; what the nodes of one round become in the next is composed at the end.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    found = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        while True:  # pointers lead to ever lesser nodes, so they end
            upper = parents.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            jumped = cut(parents.join(upper, F.col("up") == F.col("_a")).select("a", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved")))
            parents = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        root = parents.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
        if first:
            found, first = root.toDF("node", "component"), False
        else:
            found = found.join(root, F.col("component") == F.col("_a"), "left").select("node", F.coalesce("_up", "component").alias("component"))
        half = edges.join(root, F.col("a") == F.col("_a")).select(F.col("_up").alias("a"), "b")
        whole = half.join(root, F.col("b") == F.col("_a")).select("a", F.col("_up").alias("b"))
        edges = cut(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    return found

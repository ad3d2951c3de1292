"""Repository-level dependency cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import repo_of
from ..plans.fixpoint import cut
from .components import elementary_cycles


def repo_edges(members: DataFrame) -> DataFrame:
    """src, dst, channel, kind, verb: a link's producing repositories to its consuming ones, without loops.

    Repositories of a side are made distinct before the sides meet, so that a channel costs as many
    rows as it has pairs of repositories and not of members.
    """
    sides = members.select("channel", "kind", "verb", "side", repo_of(F.col("id")).alias("repo")).distinct()
    side = lambda name, to: sides.filter(F.col("side") == name).select("channel", "kind", "verb", F.col("repo").alias(to))
    return side("producer", "src").join(side("consumer", "dst"), ["channel", "kind", "verb"]).filter(F.col("src") != F.col("dst"))


def find_cycles(members: DataFrame, longest: int | None = None) -> DataFrame:
    """All elementary cycles of the repository graph: repos (closed path from the least), length, channels along it; `longest` bounds their length."""
    edges = cut(repo_edges(members).select("src", "dst", "channel").distinct())
    found = elementary_cycles(edges.select("src", "dst").distinct(), longest)
    steps = found.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("length")))).select("path", "length", F.element_at("path", F.col("_k")).alias("src"), F.element_at("path", F.col("_k") + 1).alias("dst"))
    channels = steps.join(edges, ["src", "dst"]).groupBy("path", "length").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return channels.select(F.array_join("path", ">").alias("repos"), "length", "channels")


def cycle_summary(members: DataFrame, longest: int | None = None) -> DataFrame:
    """One row: cycle_count and the repositories that are in a cycle."""
    cycles = find_cycles(members, longest)
    return cycles.agg(F.count("*").alias("cycle_count"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("repos", ">"))))), ",").alias("repos_in_cycles"))

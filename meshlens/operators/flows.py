"""Flow analytics without paths: what a flow reaches and which hops it takes, found by fixpoints on (flow, entry).

detect_flows() (views.py) writes out every simple path, whose number is exponential where flows run in circles.  Which
entries a flow has, in which least depth, and which hops some simple path takes can be told without them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from .tools import sorted_set
from .views import SYNC_KINDS


def flow_entries(origins: DataFrame, hops: DataFrame) -> DataFrame:
    """(flow_id, entry_id, repo, depth) of all entries of each flow; depth is the least number of hops from its origin.

    origins (flow_id, id, repo), hops as of views.flow_hops().  Semi-naive: a round joins what the last one found.
    """
    ways = cut(hops.select(F.col("src").alias("entry_id"), "dst", "dst_repo").distinct())
    front = cut(origins.select("flow_id", F.col("id").alias("entry_id"), "repo", F.lit(0).alias("depth")).distinct())
    found = [front]
    while not front.isEmpty():
        on = front.join(ways, "entry_id").select("flow_id", F.col("dst").alias("entry_id"), F.col("dst_repo").alias("repo"), (F.col("depth") + 1).alias("depth")).distinct()
        front = cut(on.join(reduce(DataFrame.union, found).select("flow_id", "entry_id"), ["flow_id", "entry_id"], "left_anti"))
        found.append(front)
    return reduce(DataFrame.union, found)


def hops_taken(entries: DataFrame, hops: DataFrame) -> DataFrame:
    """(flow_id, src, dst, src_repo, dst_repo, channel, kind, verb, response_type): hops that some branch of a flow takes; a branch meets no entry twice.

    A branch takes the hop from u to v if it can come to u without v.  It can if v isn't nearer to the origin than u, as the shortest
    way to u holds nearer entries only; and it can't if v is the origin.  Only other ways back are searched for, by a fixpoint on
    (flow, entry to avoid, entry) which starts from all that are no farther than the avoided one.
    """
    entries, hops = cut(entries), cut(hops)
    depth = lambda end: entries.select("flow_id", F.col("entry_id").alias(end), F.col("depth").alias(f"_{end}"))
    met = cut(hops.join(depth("src"), "src").join(depth("dst"), ["flow_id", "dst"]).filter("src <> dst AND _dst > 0"))
    back = cut(met.filter("_dst < _src").select("flow_id", F.col("dst").alias("avoid"), F.col("_dst").alias("_avoid"), "src").distinct())
    ways = cut(met.select("flow_id", "src", "dst").distinct())
    front = back.select("flow_id", "avoid", "_avoid").distinct().join(entries.select("flow_id", "entry_id", "depth"), "flow_id").filter("depth <= _avoid AND entry_id <> avoid").select("flow_id", "avoid", "entry_id")
    front = cut(front)
    found = [front]
    while not front.isEmpty():
        on = front.join(ways.withColumnRenamed("src", "entry_id"), ["flow_id", "entry_id"]).filter("dst <> avoid").select("flow_id", "avoid", F.col("dst").alias("entry_id")).distinct()
        front = cut(on.join(reduce(DataFrame.union, found), ["flow_id", "avoid", "entry_id"], "left_anti"))
        found.append(front)
    round_about = back.join(reduce(DataFrame.union, found).withColumnRenamed("entry_id", "src"), ["flow_id", "avoid", "src"], "left_semi").select("flow_id", "src", F.col("avoid").alias("dst"))
    onward = met.filter("_dst >= _src").select("flow_id", "src", "dst").distinct()
    return hops.join(onward.union(round_about), ["src", "dst"]).select("flow_id", "src", "dst", "src_repo", "dst_repo", "channel", "kind", "verb", "response_type")


def reach_metrics(entries: DataFrame, taken: DataFrame) -> DataFrame:
    """flow_id, repos, repo_count, n_entries, has_cross_repo, has_sync of each flow; how long its longest branch is needs paths."""
    sync = taken.filter(F.col("kind").isin(*SYNC_KINDS)).select("flow_id").distinct().withColumn("_sync", F.lit(True))
    sums = entries.groupBy("flow_id").agg(sorted_set(F.col("repo")).alias("repos"), F.countDistinct("repo").alias("repo_count"), F.countDistinct("entry_id").alias("n_entries"))
    return sums.join(sync, "flow_id", "left").select("flow_id", "repos", "repo_count", "n_entries", (F.col("repo_count") > 1).alias("has_cross_repo"), F.coalesce("_sync", F.lit(False)).alias("has_sync"))


def repo_nodes(entries: DataFrame) -> DataFrame:
    """flow_id, repo, its least depth and how many entries it has."""
    return entries.groupBy("flow_id", "repo").agg(F.min("depth").alias("depth"), F.countDistinct("entry_id").alias("n_entries"))


def repo_edges(taken: DataFrame) -> DataFrame:
    """Distinct edges of a flow between repositories (flow_id, src, dst, channel, kind); a call with a known answer also goes back."""
    there = taken.select("flow_id", F.col("src_repo").alias("src"), F.col("dst_repo").alias("dst"), "channel", "kind")
    back = taken.filter("kind = 'http' AND response_type <> ''").select("flow_id", F.col("dst_repo").alias("src"), F.col("src_repo").alias("dst"), "channel", F.lit("http-response").alias("kind"))
    return there.union(back).distinct()


def downstream(taken: DataFrame, repo: str) -> DataFrame:
    """Where a repository hands flows on: flow_id, channel, kind, target repository."""
    return taken.filter(F.col("src_repo") == repo).select("flow_id", "channel", "kind", F.col("dst_repo").alias("target_repo")).distinct()

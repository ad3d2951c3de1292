"""Cross-repository links: producers joined with consumers by channel, path or service method.

Links are given as members, one row for each producer or consumer of a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LINKED_CONSUMERS, channel_verb, normalize_http_path

_MEMBER = ("channel", "kind", "verb", "side", "id", "repo", "ord")


def link_message(entry_points: DataFrame, producers: DataFrame) -> DataFrame:
    """Members of message links: equal channels with both a consumer and a producer.

    If every consuming repository of a channel also produces on it, the channel is a closed loop:
    then only producers of other repositories remain, and the link goes if none do.
    """
    consumers = entry_points.filter(F.col("type").isin(*LINKED_CONSUMERS) & ~F.col("channel").isin("", "unknown", "unknown-event")).select("channel", "id", "repo", "ord")
    made = producers.filter((F.col("type") != "http-call") & ~F.col("channel").isin("", "unknown")).select("channel", "id", "repo", "ord")
    ends = consumers.withColumn("side", F.lit("consumer")).unionByName(made.withColumn("side", F.lit("producer")))
    # what a channel's link is, its repositories tell: ends are dealt once, to meet them
    heard, nowhere, at = F.col("side") == "consumer", F.col("repo").isNull(), Window.partitionBy("channel")
    sides = ends.groupBy("channel", "repo").agg(F.max(heard).alias("_in"), F.max(~heard).alias("_out"))
    sides = sides.withColumns({"_heard": F.max("_in").over(at), "_open": F.max(F.col("_in") & (~F.col("_out") | nowhere)).over(at)})
    sides = sides.withColumn("_sends", F.col("_out") & F.col("_heard") & (F.col("_open") | ~F.col("_in") | nowhere))
    linked = sides.withColumn("_linked", F.max("_sends").over(at)).filter("_linked").select(F.col("channel").alias("_channel"), F.col("repo").alias("_repo"), "_sends")
    both = ends.hint("merge").join(linked, (F.col("channel") == F.col("_channel")) & F.col("repo").eqNullSafe(F.col("_repo"))).filter(heard | F.col("_sends"))
    return both.withColumns({"kind": F.lit("message"), "verb": F.lit("")}).select(*_MEMBER)


def link_http(entry_points: DataFrame, producers: DataFrame) -> DataFrame:
    """Members of HTTP links: calls joined with REST endpoints of other repositories on the normalised path.

    A link is a path and, where the caller's verb is also in the endpoint's channel text, the verb.
    Its channel and verb are those of its first caller.
    """
    rest = entry_points.filter((F.col("type") == "rest-endpoint") & ~F.col("channel").isin("", "unknown"))
    rest = rest.select(normalize_http_path(F.col("channel")).alias("norm"), channel_verb(F.col("channel")).alias("e_verb"), F.col("id").alias("e_id"), F.col("repo").alias("e_repo"), F.col("ord").alias("e_ord"))
    calls = producers.filter((F.col("type") == "http-call") & ~F.col("channel").isin("", "unknown"))
    calls = calls.select(normalize_http_path(F.col("channel")).alias("norm"), F.upper("message_type").alias("p_verb"), F.col("channel").alias("raw"), F.col("id").alias("p_id"), F.col("repo").alias("p_repo"), F.col("ord").alias("p_ord"))
    # The endpoints of a path are described by their verbs and repositories before calls meet them: a popular path isn't multiplied.
    sides = rest.groupBy("norm", "e_verb", "e_repo").agg(F.min("e_ord").alias("e_first"))
    met = calls.join(sides, "norm").filter(F.col("e_repo") != F.col("p_repo"))
    same = (F.col("p_verb") != "") & (F.col("p_verb") == F.col("e_verb"))
    met = met.withColumn("key", F.when(same, F.col("p_verb")).otherwise(F.lit("")))
    verb = F.when(F.col("p_verb") != "", F.col("p_verb")).otherwise(F.col("e_verb"))
    named = met.groupBy("norm", "key").agg(F.min(F.struct("p_ord", "e_first", F.col("raw").alias("channel"), verb.alias("verb"))).alias("first")).select("norm", "key", "first.channel", "first.verb")
    callers = met.groupBy("norm", "key", F.col("p_id").alias("id"), F.col("p_repo").alias("repo")).agg(F.min("p_ord").alias("ord")).withColumn("side", F.lit("producer"))
    reached = met.select("norm", "key", "e_verb", "e_repo").distinct()
    called = rest.join(reached, ["norm", "e_verb", "e_repo"]).groupBy("norm", "key", F.col("e_id").alias("id"), F.col("e_repo").alias("repo")).agg(F.min("e_ord").alias("ord")).withColumn("side", F.lit("consumer"))
    return callers.unionByName(called).join(named, ["norm", "key"]).withColumn("kind", F.lit("http")).select(*_MEMBER, "norm")


def link_grpc(entry_points: DataFrame, producers: DataFrame) -> DataFrame:
    """Members of gRPC links: stub calls and service methods of other repositories with the same /Service/method."""
    served = entry_points.filter((F.col("type") == "grpc-service") & (F.col("channel") != "")).select("channel", "id", "repo", "ord")
    called = producers.filter((F.col("type") == "grpc-call") & (F.col("channel") != "")).select("channel", "id", "repo", "ord")

    def meets_other(mine: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of a channel where some other repository is on the other side."""
        span = others.groupBy("channel").agg(F.min("repo").alias("_least"), F.max("repo").alias("_most"))
        kept = mine.join(span, "channel").filter((F.col("_least") != F.col("repo")) | (F.col("_most") != F.col("repo")))
        return kept.groupBy("channel", "id", "repo").agg(F.min("ord").alias("ord"))

    both = meets_other(called, served).withColumn("side", F.lit("producer")).unionByName(meets_other(served, called).withColumn("side", F.lit("consumer")))
    return both.withColumns({"kind": F.lit("grpc"), "verb": F.lit("GRPC")}).select(*_MEMBER)


def all_links(entry_points: DataFrame, producers: DataFrame) -> DataFrame:
    """Members of message, HTTP and gRPC links, ordered in this order of kinds."""
    parts = [link_message(entry_points, producers), link_http(entry_points, producers).drop("norm"), link_grpc(entry_points, producers)]
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("ord", F.concat(F.lit(f"{k}."), "ord"))
        out = part if out is None else out.unionByName(part)
    return out


def repos_involved(members: DataFrame, entry_points: DataFrame, producers: DataFrame) -> DataFrame:
    """Repositories of linked ids: the entry point's, else the producer's, else what the id begins with."""
    lookup = entry_points.groupBy("id").agg(F.max_by("repo", "ord").alias("e_repo")).join(producers.groupBy("id").agg(F.max_by("repo", "ord").alias("p_repo")), "id", "full_outer")
    fallback = F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1)).otherwise(F.lit("unknown"))
    return members.select("id").distinct().join(lookup, "id", "left").select(F.coalesce("e_repo", "p_repo", fallback).alias("repo")).distinct()

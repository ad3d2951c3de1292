"""Repositories of Java sources to a graph: scan, index, detect, call trees, links, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect_entry_points, detect_producers, entry_rules
from ..operators.links import all_links
from ..operators.reach import reachable_methods, unreachable_methods
from ..operators.resolve import call_edges, calls_of, resolve_calls
from ..operators.tree import call_tree, tree_metrics
from ..sources.extract import JavaIndex, index, java_types
from ..sources.files import load_config, scan_config_files, scan_source_files
from .fixpoint import cut
from .relations import GraphRelations

_CONFIG = "key string, value string, first struct<repo:string,path:string,ord:int>"


def analyze_files(files: DataFrame, config: DataFrame | None = None) -> GraphRelations:
    """The graph of Java files (repo, path, content) and configuration (key, value, first)."""
    return analyze_types(java_types(files), files.select("repo"), config)


def analyze_types(types: DataFrame, repos: DataFrame, config: DataFrame | None = None) -> GraphRelations:
    """The graph of types as java_types() reads them, of repositories (repo, a row each or more)."""
    spark = types.sparkSession
    config = cut(config) if config is not None else spark.createDataFrame([], _CONFIG)
    idx = index(types)
    entries = cut(detect_entry_points(idx, config))
    producers = cut(detect_producers(idx, config))
    calls = calls_of(idx)
    every = cut(resolve_calls(idx, calls))
    edges = cut(call_edges(idx, every))
    known = cut(_rooted(idx, entries).withColumn("ep", F.concat_ws("#", "id", "ord", "type", "channel")))
    roots = known.select(F.col("ep").alias("ep_id"), F.col("root").alias("key"), F.concat_ws(".", "class_name", "method").alias("method"), "class_name", "file", "line").dropDuplicates(["ep_id"])
    nodes = cut(call_tree(roots, edges))
    busy = edges.hint("merge").join(_useful(edges), ["caller", "ord"], "left_semi").select(F.col("caller").alias("root")).distinct().withColumn("_busy", F.lit(True))
    metrics = tree_metrics(nodes).withColumnRenamed("ep_id", "ep")
    thin = F.when(F.col("d").isNull(), F.lit(False)).otherwise(~F.col("d.has_body") | F.col("_busy").isNull())
    final = known.hint("merge").join(metrics, "ep", "left").hint("merge").join(busy, "root", "left").withColumn("thin", thin)
    entry_points = cut(final.select("ord", "id", "repo", "type", "channel", "class_name", "method", "file", "line", "message_type", "method_type", *[F.col(c).cast("int").alias(c) for c in ("depth", "total_nodes", "unique_files", "branch_count")], "thin"))
    named = nodes.hint("merge").join(known.select(F.col("ep").alias("ep_id"), "id").distinct(), "ep_id").drop("ep_id").withColumnRenamed("id", "ep_id")
    unreachable = _unreached(idx, known, calls, every)
    repos = repos.groupBy("repo").agg(F.min("repo").alias("ord")).select("ord", "repo")
    total = idx.methods.filter("has_body").count()
    return GraphRelations(entry_points, producers, cut(all_links(entry_points, producers)), named, unreachable, repos, total)


def unreachable_of(files: DataFrame) -> DataFrame:
    """analyze_files().unreachable alone, of calls and the places of entry points: channels, producers, links and call trees tell nothing of it and aren't made."""
    idx = index(java_types(files))
    calls = calls_of(idx)
    entries = entry_rules(idx).select("repo", "file", F.col("simple_name").alias("class_name"), "method", "line").distinct()
    return _unreached(idx, _rooted(idx, entries), calls, cut(resolve_calls(idx, calls)))


def _rooted(idx: JavaIndex, entries: DataFrame) -> DataFrame:
    """entries with their method: d, the indexed one of its class and name in its file, if any, and its key (root)."""
    own = idx.methods.groupBy("repo", "file", F.col("class_simple").alias("class_name"), F.col("name").alias("method")).agg(F.min_by(F.struct("method_key", "line", "has_body"), "ord").alias("d"))
    named = F.concat(F.concat_ws(".", "class_name", "method"), F.lit("@"), "file", F.lit(":"), F.col("line").cast("string"))
    return entries.hint("merge").join(own, ["repo", "file", "class_name", "method"], "left").withColumn("root", F.coalesce("d.method_key", named))


def _unreached(idx: JavaIndex, known: DataFrame, calls: DataFrame, every: DataFrame) -> DataFrame:
    """The methods that no entry point (known: root) comes to by calls, whose candidates are every."""
    display = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "method")).otherwise(F.col("method"))
    spoken = calls.select("method_key", F.col("ord").cast("int").alias("ord"), display.alias("display"), "arity")
    reached = reachable_methods(known.select(F.col("root").alias("node")), every.hint("merge").join(spoken, ["method_key", "ord"]).select(F.col("method_key").alias("caller"), "callee", "display", "arity"))
    methods = idx.methods.select(F.col("method_key").alias("key"), "name", "has_body", "repo", F.col("class_simple").alias("class_name"), "file", "line").dropDuplicates(["key"])
    dead = unreachable_methods(methods, reached)
    return dead.select(F.concat(F.col("repo"), F.lit(":"), F.concat_ws(".", "class_name", "name")).alias("id"), "repo", "class_name", F.col("name").alias("method"), "file", "line")


def _useful(edges: DataFrame) -> DataFrame:
    from ..functions.scalars import is_trivial_call

    return edges.filter(~is_trivial_call(F.col("display"), F.col("arity"))).select("caller", "ord")


def analyze(spark: SparkSession, roots: dict[str, str]) -> GraphRelations:
    """The graph of repositories {name: folder}."""
    return analyze_files(scan_source_files(spark, roots), load_config(scan_config_files(spark, roots)))

"""Reachability over the whole call graph: what no entry point can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_trivial_call, is_trivial_definition
from ..plans.fixpoint import reachable


def reachable_methods(roots: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, round) that calls (caller, callee, display, arity) reach, at any depth and over every candidate, from roots (node)."""
    edges = calls.filter(F.col("callee").isNotNull() & ~is_trivial_call(F.col("display"), F.col("arity")))
    return reachable(roots, edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct())


def unreachable_methods(methods: DataFrame, reached: DataFrame) -> DataFrame:
    """methods (key, name, has_body, ...) with a body that nothing reaches, but for accessors and the like."""
    return methods.filter(F.col("has_body") & ~is_trivial_definition(F.col("name"))).hint("merge").join(reached.select(F.col("node").alias("key")), "key", "left_anti")


def methods_total(methods: DataFrame) -> DataFrame:
    return methods.agg(F.count(F.when(F.col("has_body"), 1)).alias("methods_total"))


def thin_entries(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """ep_id and thin: whether the entry's method (key) makes no call that says something."""
    busy = calls.filter(~is_trivial_call(F.col("display"), F.col("arity"))).select(F.col("caller").alias("key")).distinct().withColumn("_busy", F.lit(True))
    return entries.hint("merge").join(busy, "key", "left").select("ep_id", F.col("_busy").isNull().alias("thin"))

"""Loops to a fixpoint over DataFrames, cut at each round by reliable checkpoints."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds whose tables reachable() keeps apart before it writes them as one.
COMPACT = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context's own checkpoint folder; without either a cluster has none to share."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if (spark.sparkContext.master or "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile  # one machine and one process: its folder is shared

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshlens-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: lineage ends there.

    Spark takes the result's size from what was read at first, before rows were parsed, exploded or joined.  So a join
    with it is one that shuffles, and nothing is sent to the driver but what is asked for by F.broadcast.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True).hint("merge")


def weighed(df: DataFrame) -> DataFrame:
    """As cut(), by files that are read back, so that Spark knows the result's size: for loops that join what they have made with itself.

    The size that cut() hands on is Spark's guess, and that of a join is its sides' product.  A table that meets itself in
    each round so doubles the digits of its guess, to millions, and soon Spark spends longer on these than on all rows.
    """
    folder = f"{shared_folder(df.sparkSession)}/weighed-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).hint("merge")


def reachable(roots: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, round) of all nodes that edges (src, dst) reach from roots (node); round 0 are the roots.

    Semi-naive: each round joins only the nodes that the last one found, so every edge is followed
    once.  Edges are made once, dealt by their source.  Rounds are written apart, so a round costs
    what it finds and not what has been found; now and then they are written as one.
    """
    edges = cut(edges.select("src", "dst").repartition("src"))
    front = cut(roots.select("node").distinct().withColumn("round", F.lit(0)))
    seen, k = [front], 0
    while not front.isEmpty() and (max_rounds is None or k < max_rounds):
        k += 1
        following = edges.hint("merge").join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.union, [part.select("node") for part in seen])
        front = cut(following.hint("merge").join(known, "node", "left_anti").withColumn("round", F.lit(k)))
        seen.append(front)
        if len(seen) > COMPACT:
            seen = [cut(reduce(DataFrame.union, seen))]
    return reduce(DataFrame.union, seen)

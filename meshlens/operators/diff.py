"""What changed between two graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from ..plans.relations import GraphRelations


#: A column that all nodes of a tree and its entry point share in every snapshot, where they are dealt by it already.
DEAL = "_deal"


def last_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """The last row of each key that isn't blank."""
    columns = [c for c in df.columns if c != key]
    return df.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max(F.struct("ord", *[c for c in columns if c != "ord"])).alias("r")).select(key, "r.*")


def _status(old: DataFrame, new: DataFrame, key: str, *told: str) -> DataFrame:
    """key, status of rows (key, _sig) of either side, one a key or the last by ord: added, removed, changed or same.  Both sides meet in one grouping.

    told: further columns, as the new side has them, or the old one for removed rows.  Where both sides have DEAL, they meet there.
    """
    deal = [DEAL] if DEAL in old.columns and DEAL in new.columns else []
    last = ["ord"] if "ord" in old.columns else []
    both = old.select(key, *deal, *last, "_sig", *told, F.lit(False).alias("_new")).unionByName(new.select(key, *deal, *last, "_sig", *told, F.lit(True).alias("_new")))
    side = lambda s: F.max(F.when(F.col("_new") == s, F.struct(F.lit(1).alias("is"), *last, "_sig", *told)))
    met = both.groupBy(key, *deal).agg(side(False).alias("a"), side(True).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a._sig").eqNullSafe(F.col("b._sig")), "changed").otherwise("same")
    return met.select(key, status.alias("status"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in told])


def node_digest(nodes: DataFrame) -> DataFrame:
    """ep_id and a fingerprint of the set of (method, file, line) in its tree, without gathering it: one deal by tree, or none if nodes are dealt by DEAL."""
    deal = [DEAL] if DEAL in nodes.columns else []
    keys = nodes.select("ep_id", *deal, F.xxhash64("method", "file", "line").alias("h"))
    keys = (keys if deal else keys.repartition("ep_id")).distinct()
    return keys.groupBy("ep_id", *deal).agg(F.xxhash64(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).alias("tree"))


def diff_entries(old: GraphRelations, new: GraphRelations, *told: str) -> DataFrame:
    """id, status of all entry points: changed if depth, nodes or files of the tree or its set of nodes differ; told: further columns of theirs."""
    sizes = ("depth", "total_nodes", "unique_files")

    def signed(g: GraphRelations) -> DataFrame:
        entries, trees = g.entry_points.filter(F.coalesce("id", F.lit("")) != ""), node_digest(g.nodes).withColumnRenamed("ep_id", "id")
        if DEAL in entries.columns and DEAL in trees.columns:  # both meet where they are
            mine = entries.select("id", DEAL, F.struct("ord", *sizes, *told).alias("r"), F.lit(None).cast("bigint").alias("tree"))
            rows = mine.unionByName(trees, allowMissingColumns=True).groupBy("id", DEAL).agg(F.max("r").alias("r"), F.max("tree").alias("tree")).filter("r IS NOT NULL").select("id", DEAL, "r.*", "tree")
        else:
            rows = last_by_id(entries.select("id", "ord", *sizes, *told)).join(trees.select("id", "tree"), "id", "left")
        return rows.select("id", *[c for c in rows.columns if c == DEAL], F.xxhash64(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in sizes], F.coalesce(F.col("tree").cast("string"), F.lit("")))).alias("_sig"), *told)

    return _status(signed(old), signed(new), "id", *told)


def diff_producers(old: GraphRelations, new: GraphRelations) -> DataFrame:
    """id, status of all producers: changed if any field differs."""

    def signed(g: GraphRelations) -> DataFrame:
        """A fingerprint of each row, so that no other field is dealt."""
        rows = g.producers.filter(F.coalesce("id", F.lit("")) != "")
        return rows.select("id", "ord", F.xxhash64(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in ("id", "ord"))))).alias("_sig"))

    return _status(signed(old), signed(new), "id")


def link_signature(members: DataFrame) -> DataFrame:
    """channel and a fingerprint of its link: kind, verb and both sets of members, without gathering them."""
    parts = members.filter("channel <> ''").select("channel", F.xxhash64("kind", "verb", "side", "id").alias("h")).repartition("channel").distinct()  # one deal for both
    return parts.groupBy("channel").agg(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor("h").cast("string"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).alias("_sig"))


def diff_links(old: GraphRelations, new: GraphRelations) -> DataFrame:
    """channel, status: added, removed, changed (its link differs) or same."""
    return _status(link_signature(old.members), link_signature(new.members), "channel")


def statuses(old: GraphRelations, new: GraphRelations) -> DataFrame:
    """kind (entry_points, producers, links), key, status of all that either graph has."""
    parts = {"entry_points": diff_entries(old, new), "producers": diff_producers(old, new), "links": diff_links(old, new)}
    return reduce(DataFrame.union, [df.toDF("key", "status").select(F.lit(kind).alias("kind"), "key", "status") for kind, df in parts.items()])


def _counts(found: DataFrame) -> DataFrame:
    n = lambda kind, s: F.count(F.when((F.col("kind") == kind) & (F.col("status") == s), 1)).alias(f"{kind}_{s}")
    three = ("added", "removed", "changed")
    return found.agg(*[n("entry_points", s) for s in three], *[n("producers", s) for s in three], *[n("links", s) for s in three[:2]])


def diff_summary(old: GraphRelations, new: GraphRelations) -> DataFrame:
    """One row of eight counts; links have no "changed" here."""
    return _counts(statuses(old, new))


def diff_graphs(old: GraphRelations, new: GraphRelations) -> dict[str, DataFrame]:
    """What was added, removed and changed, in order, and diff_summary()."""
    found = cut(statuses(old, new))
    listed = lambda kind, s: found.filter((F.col("kind") == kind) & (F.col("status") == s)).select("key").orderBy("key")
    names = [(k, s) for k in ("entry_points", "producers", "links") for s in ("added", "removed", "changed") if (k, s) != ("links", "changed")]
    return {f"{k}_{s}": listed(k, s) for k, s in names} | {"summary": _counts(found)}


def has_changes(summary: DataFrame) -> Column:
    """Whether any count of diff_summary() is over 0."""
    return F.greatest(*summary.columns) > 0


def diff_repo_counts(old: GraphRelations, new: GraphRelations) -> DataFrame:
    """repo, added, removed, changed: entry points of each repository (removed ones by the old graph)."""
    rows = diff_entries(old, new, "repo").filter("status <> 'same'")
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return rows.groupBy("repo").agg(n("added"), n("removed"), n("changed")).filter("repo <> ''")


def _count_text(sign: str, column: str, noun: str) -> Column:
    plural = F.when(F.col(column) > 1, "s").otherwise("")
    return F.when(F.col(column) > 0, F.concat(F.lit(sign), F.col(column).cast("string"), F.lit(f" {noun}"), plural if noun not in ("changed", "removed") else F.lit("")))


def diff_summary_text(summary: DataFrame) -> DataFrame:
    """The counts of diff_summary() as one line of text, and whether there is any change."""
    text = F.concat_ws(
        " · ", _count_text("+", "entry_points_added", "entry point"), _count_text("~", "entry_points_changed", "changed"), _count_text("−", "entry_points_removed", "removed"),
        _count_text("+", "links_added", "channel"), _count_text("−", "links_removed", "channel"),
    )
    return summary.select(text.alias("text"), has_changes(summary).alias("has_changes"))


def node_diff(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """New trees' nodes with whether the same entry point's old tree has their (method, file, line).  Both trees of an entry point meet where they are dealt, once."""
    key = ["ep_id", "method", "file", "line"]
    old = old_nodes.select(*key).withColumns({"path": F.lit(None).cast("array<int>"), "_old": F.lit(True)})
    both = new_nodes.select(*key, "path", F.lit(False).alias("_old")).unionByName(old).repartition("ep_id")
    met = both.withColumn("_known", F.max("_old").over(Window.partitionBy(*key))).filter("NOT _old")
    return met.select("ep_id", "path", "method", "file", "line", (~F.col("_known") | reduce(Column.__or__, [F.col(k).isNull() for k in key])).alias("is_new"))

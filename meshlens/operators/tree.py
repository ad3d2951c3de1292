"""Call trees as node tables (ep_id, path, depth, ...), and the questions asked of them.

A node's path has the positions of its ancestors and itself among their siblings; sorted paths are
pre-order.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import is_trivial_call
from ..plans.fixpoint import cut, weighed

MAX_DEPTH = 4
MAX_NODES = 50
#: Of a method's calls, so many different targets can matter: a tree takes 49 at most, and skips 49 that it has.
MAX_TARGETS = 2 * MAX_NODES
#: What stands before a node's name in a tree's text, and what marks a node that sends.
ARROW = "→ "
SENDS = " [⚡ PRODUCER]"


def layered_tree(roots: DataFrame, edges: DataFrame | Sequence[DataFrame], max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """(ep_id, node, path, depth, rank) of the trees that edges (caller, callee, pos) span from roots (ep_id, node).

    For call graphs in layers, where a node can't be met at two depths.  There the first depth-first visit of a node is its
    least path, and the node cap is a cap of the pre-order rank.  So what is below a node is the same in every tree but for
    nodes that the tree has already, and of a node's own tree no more than max_nodes can matter: those are made once a node,
    from the deepest layer up, and a root's tree is put together of its callees'.  edges may be a table for each level.

    Of a root's callees only the first ones are needed, until the tree is full; how far can be told by sizes, so trees are
    joined with those only.  A tree that its first callee fills isn't dealt again.
    """
    layers = [edges] * max_depth if isinstance(edges, DataFrame) else list(edges)[:max_depth]
    below = None
    for layer in reversed(layers[1:]):
        below = _own_trees(_first_calls(layer, max_nodes), below, ["caller"], max_nodes)
    nothing = F.array().cast(OWN_TREE)
    trees = roots.select("ep_id", "node", nothing.alias("tree"))
    if layers and max_nodes > 1:
        calls = _needed_calls(_first_calls(layers[0], max_nodes), below, max_nodes)
        asked = roots.select("ep_id", "node").join(calls.hint("merge"), F.col("node") == F.col("caller"), "left").drop("caller")
        whole = lambda rows: _own_trees(rows, below, ["ep_id", "node"], max_nodes)
        one = _with_trees(asked.filter("n_calls = 1"), below).select("ep_id", "node", F.slice(_placed("pos", "callee", "tree"), 1, max_nodes - 1).alias("tree"))
        several = whole(asked.filter("n_calls > 1"))
        trees = asked.filter("n_calls IS NULL").select("ep_id", "node", nothing.alias("tree")).unionByName(one).unionByName(several)
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("node").cast("string").alias("node")))
    out = trees.select("ep_id", F.posexplode(F.concat(root, "tree")).alias("_k", "_n"))
    return out.select("ep_id", "_n.node", "_n.path", F.size("_n.path").alias("depth"), (F.col("_k") + 1).alias("rank"))


#: What is below a node, in pre-order: each node with its path from there.
OWN_TREE = "array<struct<path:array<int>,node:string>>"


def _first_calls(edges: DataFrame, max_nodes: int) -> DataFrame:
    """(caller, callee, pos, k): the first call of each callee, by its place k; as each is a node, those from max_nodes on are none of a tree."""
    once = edges.select("caller", "callee", F.col("pos").cast("int").alias("pos")).filter("caller IS NOT NULL").repartition("caller").groupBy("caller", "callee").agg(F.min("pos").alias("pos"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("caller").orderBy("pos", "callee"))).filter(F.col("k") < max_nodes)


def _needed_calls(calls: DataFrame, below: DataFrame | None, max_nodes: int) -> DataFrame:
    """calls that a tree can come to before it is full, with their number by caller (n_calls): all calls before are nodes, and so is all that is below one of them."""
    sized = calls.withColumn("_size", F.lit(0))
    if below is not None:
        sizes = below.select(F.col("caller").alias("callee"), F.size("tree").alias("_below"))
        sized = calls.join(sizes.hint("merge"), "callee", "left").withColumn("_size", F.coalesce("_below", F.lit(0)))
    before = Window.partitionBy("caller").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    kept = sized.repartition("caller").withColumn("_most", F.coalesce(F.max("_size").over(before), F.lit(0))).filter(F.col("k") + F.col("_most") < max_nodes)
    return kept.select("caller", "callee", "pos", "k", F.count("*").over(Window.partitionBy("caller")).alias("n_calls"))


def _with_trees(calls: DataFrame, below: DataFrame | None) -> DataFrame:
    """calls with what is below their callees (tree, null if nothing is)."""
    if below is None:
        return calls.withColumn("tree", F.lit(None).cast(OWN_TREE))
    return calls.join(below.select(F.col("caller").alias("callee"), "tree").hint("merge"), "callee", "left")


def _placed(pos: str, callee: str, tree: str) -> Column:
    """A callee and what is below it, seen from its caller."""
    own = F.struct(F.array(F.col(pos)).alias("path"), F.col(callee).alias("node"))
    deeper = F.transform(F.coalesce(F.col(tree), F.array().cast(OWN_TREE)), lambda x: F.struct(F.concat(F.array(F.col(pos)), x["path"]).alias("path"), x["node"].alias("node")))
    return F.concat(F.array(own), deeper)


def _own_trees(calls: DataFrame, below: DataFrame | None, keys: list[str], max_nodes: int) -> DataFrame:
    """keys and tree (OWN_TREE): the first max_nodes - 1 nodes below each, of its calls (callee, pos, k: under max_nodes a caller) and the trees below those.

    Of a node that is met again the first place counts.  As many nodes of each tree as the whole may have are enough:
    what is skipped of it is there already.
    """
    placed = _with_trees(calls, below).select(*keys, "k", _placed("pos", "callee", "tree").alias("tree"))
    met = placed.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "tree"))), lambda c: c["tree"])).alias("_met"))  # under max_nodes trees of under max_nodes nodes
    named = met.withColumn("_names", F.transform("_met", lambda x: F.coalesce(x["node"], F.lit("\0"))))  # a null is a name, too
    first = F.slice(F.array_distinct("_names"), 1, max_nodes - 1)
    return named.select(*keys, F.transform(first, lambda name: F.get(F.col("_met"), (F.array_position(F.col("_names"), name) - 1).cast("int"))).alias("tree"))


NODES = "ep_id string, path array<int>, depth int, method string, class_name string, file string, line int, confidence string"


#: What is below a root's callee in its own tree, the callee first: depth is that in the root's tree, mark the confidence but for caps, at a node's place in it and up that of its caller.
_SEEN = "struct<path:array<int>,depth:int,name:string,method:string,class_name:string,file:string,line:int,mark:string,at:int,up:int>"


def call_tree(entries: DataFrame, calls: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """ranked_call_tree() without ranks: nodes of NODES."""
    return ranked_call_tree(entries, calls, max_depth, max_nodes).drop("rank")


def ranked_call_tree(entries: DataFrame, calls: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """Call trees of any call graph, as nodes of NODES with their rank (from 1, in pre-order), as they are made in that order.

    entries: ep_id, key (of the entry's method), method, class_name, file, line.
    calls: caller, ord, display, arity, callee (null if unresolved), callee_class, callee_file, callee_line, ambiguous.

    Depth-first in call order; a target is visited once a tree.  Calls that say nothing are skipped,
    unresolved ones are leaves marked INFERRED, targets of several classes are AMBIGUOUS.  A node at
    max_depth isn't expanded and is EXTRACTED again; a node met when the tree is full is TRUNCATED.

    Methods that roots call get a tree of their own once, for all roots.  A root takes those of its callees in turn until it
    is full, which is its tree if what it has already comes with all that is below it there (_joined()); the calls near a root
    are fetched only for roots where that isn't so.
    """
    useful = calls.filter(~is_trivial_call(F.col("display"), F.col("arity"))).repartition("caller")  # one deal for both rankings
    target = F.coalesce("callee", "display")
    useful = useful.withColumn("_nth", F.row_number().over(Window.partitionBy("caller", target).orderBy("ord"))).filter("_nth = 1")
    useful = useful.withColumn("_k", F.row_number().over(Window.partitionBy("caller").orderBy("ord"))).filter(F.col("_k") <= MAX_TARGETS).drop("_nth", "_k")
    useful = weighed(useful)
    whole = lambda some: _streamed(_near(some, useful, max_depth), max_depth, max_nodes)
    if max_depth < 2 or max_nodes < 2:
        return whole(entries)
    root = ["ep_id", "key", "method", "class_name", "file", "line"]
    called = entries.select(*root).join(useful.withColumnRenamed("caller", "key"), "key", "left")
    kids = entries.select("key").distinct().join(useful.filter("callee IS NOT NULL").select(F.col("caller").alias("key"), "callee"), "key").select(F.col("callee").alias("ep_id")).distinct()
    own = kids.select("ep_id", F.col("ep_id").alias("key"), *[F.lit("").alias(c) for c in ("method", "class_name", "file")], F.lit(0).alias("line"))
    trees = weighed(_own_calls(_near(own, useful, max_depth - 1), max_depth, max_nodes))
    order = Window.partitionBy("ep_id").orderBy("ord")
    sized = called.join(trees.select(F.col("key").alias("callee"), F.size("below").alias("_size")).hint("merge"), "callee", "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    known = F.col("display").isNotNull()  # false for a root without calls
    sized = sized.repartition("ep_id").withColumns({"_k": F.row_number().over(order), "_most": F.coalesce(F.max("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.count(F.when(known, 1)).over(Window.partitionBy("ep_id"))})
    first = sized.filter((F.col("_k") == 1) | (F.col("_k") + F.col("_most") <= max_nodes)).withColumn("_n", F.count("*").over(Window.partitionBy("ep_id")))  # a tree is full behind these, or is looked at again
    first = weighed(first)
    # a tree that its first call fills, without the root in it, is that: it isn't dealt again
    alone, several = (F.col("_n") == 1) & (F.col("_size") >= max_nodes - 1), (F.col("_n") > 1) | (F.col("_size") < max_nodes - 1)
    loops = F.exists("own", lambda x: x["name"] == F.col("key"))
    grown = lambda rows, below, own: rows.join(trees.select(F.col("key").alias("callee"), below.alias("below")).hint("merge"), "callee", "left").withColumn("own", own).drop("below")
    slim = F.arrays_zip("below.name", "below.at", "below.up")
    parted = _joined(grown(first.filter(several), slim, _own_nodes("name", "at", "up")).unionByName(grown(first.filter(alone), slim, _own_nodes("name", "at", "up")).filter(loops)), max_nodes).filter("NOT told")
    again = cut(parted.select("ep_id"))
    whole_rows, alone_rows = grown(first.filter(several), F.col("below"), _own_nodes()), grown(first.filter(alone), F.col("below"), _own_nodes())
    joined = _joined(whole_rows.unionByName(alone_rows.filter(loops)), max_nodes, *root[1:]).filter("told")
    out = _filled(alone_rows.filter(~loops), max_depth, max_nodes).unionByName(_told(joined, max_depth, max_nodes))
    return out if again.isEmpty() else out.unionByName(whole(entries.join(again, "ep_id", "left_semi")))


_CALL = ("ep_id", "caller", "ord", "display", "arity", "callee", "callee_class", "callee_file", "callee_line", "ambiguous")


def _near(entries: DataFrame, useful: DataFrame, max_depth: int) -> DataFrame:
    """The calls that a tree of max_depth can come to, by ep_id (columns _CALL), and a row for each root as a call of its own."""
    front = entries.select("ep_id", F.col("key").alias("caller")).distinct()
    near = front
    for _ in range(max_depth - 1):
        front = front.join(useful.filter("callee is not null"), "caller").select("ep_id", F.col("callee").alias("caller"))
        near = near.union(front).distinct()
    rows = near.join(useful, "caller").select("ep_id", *useful.columns)
    roots = entries.select("ep_id", F.lit(None).cast("string").alias("caller"), F.lit(-1).cast("bigint").alias("ord"), F.col("method").alias("display"), F.lit(0).alias("arity"), F.col("key").alias("callee"), F.col("class_name").alias("callee_class"), F.col("file").alias("callee_file"), F.col("line").alias("callee_line"), F.lit(False).alias("ambiguous"))
    return rows.select(*_CALL).unionByName(roots).repartition("ep_id").sortWithinPartitions("ep_id", "ord")


def _groups(batches):
    """Rows of Arrow batches that are sorted by their first column, as lists of those that share it."""
    values = lambda c: c.to_pylist() if c.null_count and not pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False).tolist()
    rows = (row for batch in batches for row in zip(*map(values, batch.columns), strict=True))
    return (list(group) for _, group in groupby(rows, key=itemgetter(0)))


def _mapped(df: DataFrame, rows, ddl: str, size: int = 10_000) -> DataFrame:
    """The rows (of ddl) that are made of each group of df's rows."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _arrow((row for group in _groups(batches) for row in rows(group)), schema, size), ddl)


def _arrow(rows, schema: pa.Schema, size: int):
    """Rows as Arrow batches of a schema."""
    held: list[tuple] = []
    pack = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _streamed(near: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """NODES and rank of the trees of _near()."""
    return _mapped(near, lambda group: [(*n, k) for k, n in enumerate(_expanded(group, max_depth, max_nodes), 1)], f"{NODES}, rank int")


def _own_calls(near: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """key, below (array of _SEEN): the first max_nodes nodes of the tree of each method of near, if roots call it."""

    def told(group: list[tuple]) -> list[tuple]:
        nodes = _walked(group, max_depth - 1, max_nodes)
        place = {tuple(n[1]): at for at, n in enumerate(nodes)}
        return [(n[1], n[2] + 1, n[8], n[3], *n[4:8], at, place[tuple(n[1][:-1])] if at else -1) for at, n in enumerate(nodes)]

    return _mapped(near, lambda group: ((group[0][0], told(group)),), f"key string, below array<{_SEEN}>", 500)


def _walked(group: list[tuple], max_depth: int, max_nodes: int) -> list[list]:
    """Nodes of one tree (as NODES, and what tells a node from others), from its root's row and the calls near it in their order: MAX_TARGETS a method at most."""
    ep_id, _, _, method, _, key, owner, file, line, _ = group[0]
    by_caller: dict[str, list[tuple]] = {}
    for row in group[1:]:
        by_caller.setdefault(row[1], []).append(row)
    nodes: list[list] = [[ep_id, [], 0, method, owner, file, line, "EXTRACTED", key]]
    visited = {key}

    def visit(caller: str, node: list) -> None:
        if node[2] >= max_depth:
            return
        children = 0
        for _, _, _, display, _, callee, its_class, its_file, its_line, ambiguous in by_caller.get(caller, ()):
            if len(nodes) >= max_nodes:
                break
            known = callee is not None
            mark = callee if known else display
            if mark in visited:
                continue
            visited.add(mark)
            place = [ep_id, [*node[1], children], node[2] + 1, display]
            children += 1
            child = [*place, its_class, its_file, its_line, "AMBIGUOUS" if ambiguous else "EXTRACTED", mark] if known else [*place, "", "", 0, "INFERRED", mark]
            nodes.append(child)
            if known:
                visit(callee, child)

    visit(key, nodes[0])
    return nodes


def _marked(nodes: list[list], max_depth: int, max_nodes: int) -> list[tuple]:
    """NODES with the confidence that caps leave to them: the node that fills a tree isn't expanded, nor is one at max_depth."""
    for k, n in enumerate(nodes):
        if n[7] != "INFERRED":
            n[7] = "EXTRACTED" if n[2] >= max_depth else "TRUNCATED" if k + 1 >= max_nodes else n[7]
    return [tuple(n[:8]) for n in nodes]


def _expanded(group: list[tuple], max_depth: int, max_nodes: int) -> list[tuple]:
    """The nodes of one tree from the calls near its root."""
    return _marked(_walked(group, max_depth, max_nodes), max_depth, max_nodes)


def _own_nodes(*told: str) -> Column:
    """The nodes that a root's call gives, as its callee's own tree (column below) has them, but the callee as this call says it; an unresolved one gives itself.  told: the fields that below has, if not all of _SEEN."""
    said = {
        "path": F.array().cast("array<int>"), "depth": F.lit(1), "name": F.coalesce("callee", "display"), "method": F.col("display"), "class_name": F.when(F.col("callee").isNull(), "").otherwise(F.col("callee_class")),
        "file": F.when(F.col("callee").isNull(), "").otherwise(F.col("callee_file")), "line": F.when(F.col("callee").isNull(), 0).otherwise(F.col("callee_line")).cast("int"),
        "mark": F.when(F.col("callee").isNull(), "INFERRED").when(F.col("ambiguous"), "AMBIGUOUS").otherwise("EXTRACTED"), "at": F.lit(0), "up": F.lit(-1),
    }
    first = F.array(F.struct(*[said[c].alias(c) for c in told or said]))
    deeper = F.when(F.size("below") > 1, F.concat(first, F.slice("below", F.lit(2), F.size("below") - 1)))
    return F.when(F.col("display").isNotNull(), F.coalesce(deeper, first))


def _joined(several: DataFrame, max_nodes: int, *kept: str) -> DataFrame:
    """A row for each root of its first calls (ep_id, key, ord, display, _all, own; kept: further columns): whether they tell its tree (told), its nodes in pre-order and ups (places of their callers among them, 0 for the root).

    A callee's own tree is walked in the same order as the root's.  A node of it that the root's tree has already is skipped with
    all below it, so what is below it there must be had already, too; else the two walks part, and the root isn't told.  That is
    so if some node comes there for the first time, but what calls it doesn't.  Nor is a root told that isn't full while some of its calls were left out.
    """
    calls = F.array_sort(F.collect_list(F.when(F.col("display").isNotNull(), F.struct("ord", "own"))))  # under max_nodes trees of max_nodes nodes at most
    seen = F.flatten(F.transform(calls, lambda c: c["own"]))
    # names are made by the grouping: what lambdas look up there must not be made again for each of their elements
    names = F.concat(F.array(F.coalesce(F.first("key"), F.lit("\0"))), F.transform(seen, lambda x: x["name"]))
    met = several.groupBy("ep_id").agg(*[F.first(c).alias(c) for c in kept], (F.size(calls) >= F.max("_all")).alias("_every"), seen.alias("_met"), names.alias("_names"))
    # places in _names, from 1: that of each node's first sight, and that of what calls it there
    firsts = F.transform(F.slice(F.array_distinct("_names"), 2, max_nodes - 1), lambda name: F.array_position(F.col("_names"), name).cast("int"))
    met = met.withColumn("_firsts", firsts)
    node = lambda p: F.get(F.col("_met"), p - 2)
    above = lambda p: F.when(node(p)["at"] == 0, 1).otherwise(p - node(p)["at"] + node(p)["up"])
    parted = F.exists("_firsts", lambda p: (node(p)["at"] > 0) & (F.array_position(F.col("_names"), F.get(F.col("_names"), above(p) - 1)) != above(p)))
    ups = F.transform("_firsts", lambda p: F.array_position(F.col("_firsts"), above(p)).cast("int"))  # 0 is the root
    return met.select("ep_id", *kept, F.transform("_firsts", node).alias("nodes"), ups.alias("ups"), (~parted & (F.col("_every") | (F.size("_firsts") >= max_nodes - 1))).alias("told"))


def _told(joined: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """NODES and rank of trees that _joined() tells; positions count the nodes that stay."""
    place = F.transform("ups", lambda u, k: F.size(F.filter(F.slice("ups", F.lit(1), k), lambda v: v == u)))
    paths = F.aggregate(F.arrays_zip(F.col("ups").alias("up"), F.col("_place").alias("place")), F.array(F.array().cast("array<int>")), lambda made, x: F.concat(made, F.array(F.concat(F.get(made, x["up"]), F.array(x["place"])))))
    rows = joined.withColumn("_place", place).withColumn("_paths", paths)
    top = F.struct(F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.col("key").alias("name"), "method", "class_name", "file", F.col("line").cast("int").alias("line"), F.lit("EXTRACTED").alias("mark"), F.lit(0).alias("at"), F.lit(-1).alias("up"))
    rows = rows.select("ep_id", "_paths", F.posexplode_outer(F.concat(F.array(top), "nodes")).alias("_k", "x"))  # outer: else the nodes are made twice, to see that there are any
    return _marked_rows(rows, F.get("_paths", F.col("_k")), max_depth, max_nodes)


def _filled(alone: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """NODES and rank of trees that are a root and the first nodes of its first callee's own tree."""
    top = F.struct(F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.col("key").alias("name"), "method", "class_name", "file", F.col("line").cast("int").alias("line"), F.lit("EXTRACTED").alias("mark"), F.lit(0).alias("at"), F.lit(-1).alias("up"))
    rows = alone.select("ep_id", F.posexplode_outer(F.concat(F.array(top), F.slice("own", 1, max_nodes - 1))).alias("_k", "x"))
    return _marked_rows(rows, F.when(F.col("_k") == 0, F.col("x.path")).otherwise(F.concat(F.array(F.lit(0)), "x.path")), max_depth, max_nodes)


def _marked_rows(rows: DataFrame, path: Column, max_depth: int, max_nodes: int) -> DataFrame:
    """NODES and rank of rows (ep_id, _k, x of _SEEN), with the confidence that caps leave to them (as _marked())."""
    cap = F.when(F.col("x.mark") == "INFERRED", "INFERRED").when(F.col("x.depth") >= max_depth, "EXTRACTED").when(F.col("_k") + 1 >= max_nodes, "TRUNCATED").otherwise(F.col("x.mark"))
    return rows.select("ep_id", path.alias("path"), "x.depth", "x.method", "x.class_name", "x.file", "x.line", cap.alias("confidence"), (F.col("_k") + 1).alias("rank"))


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """ep_id, depth, total_nodes, unique_files, branch_count (nodes with more than one child)."""
    sizes = nodes.groupBy("ep_id").agg(F.max("depth").alias("depth"), F.count("*").alias("total_nodes"), F.countDistinct(F.when(F.col("file") != "", F.col("file"))).alias("unique_files"))
    parent = F.when(F.size("path") > 0, F.slice("path", 1, F.size("path") - 1))
    branches = nodes.filter(parent.isNotNull()).groupBy("ep_id", parent.alias("parent")).count().filter("count > 1").groupBy("ep_id").agg(F.count("*").alias("branch_count"))
    return sizes.join(branches, "ep_id", "left").withColumn("branch_count", F.coalesce("branch_count", F.lit(0)))


def display_name() -> Column:
    method, owner = F.coalesce("method", F.lit("")), F.coalesce("class_name", F.lit(""))
    plain = (owner != "") & (method != "") & ~method.contains(".")
    return F.when(plain, F.concat(owner, F.lit("."), method)).when(method != "", method).when(owner != "", owner).otherwise(F.lit("unknown"))


def _ancestors(nodes: DataFrame, own: bool) -> DataFrame:
    """nodes with each ancestor's path as `up` (and their own, if wanted)."""
    last = F.size("path") if own else F.size("path") - 1
    return nodes.filter(F.size("path") >= (0 if own else 1)).withColumn("_n", F.explode(F.sequence(F.lit(0), last))).withColumn("up", F.slice("path", 1, F.col("_n")))


def find_callers(nodes: DataFrame, method_name: str) -> DataFrame:
    """Every node whose method holds the name: ep_id, called_method, call_path.

    The path leads to the first node, in pre-order, of the same method, file and line.
    """
    hit = nodes.filter(F.contains(F.lower("method"), F.lit(method_name.lower()))).select("ep_id", "method", "file", "line", F.col("path").alias("own"))
    first = nodes.groupBy("ep_id", "method", "file", "line").agg(F.min("path").alias("path"))
    found = _ancestors(hit.join(first, ["ep_id", "method", "file", "line"]), own=True)
    names = nodes.select("ep_id", F.col("path").alias("up"), display_name().alias("name"))
    steps = found.join(names, ["ep_id", "up"]).groupBy("ep_id", "method", "own").agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("steps"))  # at most 5
    return steps.select("ep_id", F.col("method").alias("called_method"), F.array_join(F.transform("steps", lambda s: s["name"]), " > ").alias("call_path"))


def trace_path(nodes: DataFrame, from_method: str, to_method: str) -> DataFrame:
    """Chains from nodes that hold one name down to the first node on each branch that holds the other: ep_id, chain, from_path, to_path.

    Trees are dealt once, whole: an end asks each of its ancestors for its name where both are.
    """
    holds = lambda text, name: F.contains(F.lower(name), F.lit(text.lower()))
    size = F.size("path")
    asked = F.explode(F.when(holds(to_method, F.col("method")), F.sequence(F.lit(0), size)).otherwise(F.array(size))).alias("_n")  # ancestors' depths, and its own
    rows = nodes.select("ep_id", "path", "method").filter("ep_id IS NOT NULL").repartition("ep_id").select("*", asked).withColumn("up", F.slice("path", 1, F.col("_n")))
    own = F.col("_n") == size
    named = rows.withColumn("name", F.max(F.when(own, F.col("method"))).over(Window.partitionBy("ep_id", "up"))).filter(~own & F.col("name").isNotNull())
    ends = named.groupBy("ep_id", "path", F.col("method").alias("end")).agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("steps"))  # at most 4
    last = F.coalesce(F.array_max(F.transform(F.filter("steps", lambda s: holds(to_method, s["name"])), lambda s: s["_n"])), F.lit(0))
    starts = ends.withColumn("_last", last).withColumn("_from", F.explode(F.transform(F.filter("steps", lambda s: holds(from_method, s["name"]) & (s["_n"] >= F.col("_last"))), lambda s: s["_n"])))
    chain = F.array_join(F.transform(F.filter("steps", lambda s: s["_n"] >= F.col("_from")), lambda s: s["name"]), " > ")
    return starts.select("ep_id", F.concat_ws(" > ", chain, "end").alias("chain"), F.slice("path", 1, F.col("_from")).alias("from_path"), F.col("path").alias("to_path"))


def node_relations(nodes: DataFrame) -> DataFrame:
    """ep_id, path, method, its parent's method (null for roots), n_calls and n_siblings.

    Trees are dealt once, whole.  A node is two rows there, itself and a child of its parent: a family is told by its parent's place, a node by its own.
    """
    alone = (F.size("path") == 0) | F.col("ep_id").isNull()
    rows = nodes.select("ep_id", "path", "method").repartition("ep_id").select("*", F.explode(F.when(alone, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("own"))
    rows = rows.withColumn("at", F.when(F.col("own"), F.col("path")).otherwise(F.slice("path", 1, F.size("path") - 1)))
    family, node = Window.partitionBy("ep_id", "at"), Window.partitionBy("ep_id", "path")
    told = rows.withColumns({"_head": F.max(F.when(F.col("own"), F.col("method"))).over(family), "_calls": F.count(F.when(~F.col("own"), 1)).over(family)})
    child = lambda c: F.max(F.when(~F.col("own"), c)).over(node)
    told = told.withColumns({"parent": child(F.col("_head")), "_siblings": child(F.col("_calls") - 1)}).filter("own")
    return told.select("ep_id", "path", "method", "parent", F.col("_calls").alias("n_calls"), F.coalesce("_siblings", F.lit(0)).alias("n_siblings"))


def rendered(nodes: DataFrame, sending: DataFrame) -> DataFrame:
    """ep_id, rank (from 1, in pre-order) and line: trees as indented text, a row a node.

    Nodes of `sending` (ep_id, path) are marked as producers; a confidence other than EXTRACTED follows in brackets.
    """
    marked = nodes.join(sending.select("ep_id", "path").distinct().withColumn("_sends", F.lit(True)), ["ep_id", "path"], "left")
    marker = F.when(F.col("_sends"), F.lit(SENDS)).otherwise("")
    confidence = F.when(F.coalesce("confidence", F.lit("")).isin("", "EXTRACTED"), F.lit("")).otherwise(F.concat(F.lit(" ["), "confidence", F.lit("]")))
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit(ARROW), display_name(), marker, confidence)
    return marked.select("ep_id", F.row_number().over(Window.partitionBy("ep_id").orderBy("path")).alias("rank"), line.alias("line"))

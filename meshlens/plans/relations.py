"""The graph as a set of DataFrames, and its JSON document as an exchange format.

Collections are flat tables; links are kept exploded, one row for each member, so that a channel
with millions of members is never one row.  ``ord`` orders the rows of a collection where the rules
say "first" or "last".
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_DDL = (
    "ord string, id string, repo string, type string, channel string, class_name string, method string, file string, line int, "
    "message_type string, method_type string, depth int, total_nodes int, unique_files int, branch_count int, thin boolean"
)
PRODUCER_DDL = "ord string, id string, repo string, type string, channel string, method string, file string, line int, message_type string, response_type string"
MEMBER_DDL = "channel string, kind string, verb string, side string, id string, repo string, ord string"
NODE_DDL = "ep_id string, path array<int>, depth int, method string, class_name string, file string, line int, confidence string"
UNREACHABLE_DDL = "id string, repo string, class_name string, method string, file string, line int"


@dataclass(frozen=True)
class GraphRelations:
    """entry_points, producers, link members, call-tree nodes, unreachable methods and repositories of one graph."""

    entry_points: DataFrame
    producers: DataFrame
    members: DataFrame
    nodes: DataFrame
    unreachable: DataFrame | None
    repos: DataFrame
    methods_total: int = 0

    def register(self, prefix: str = "graph") -> None:
        """Temporary views of all relations, named prefix_relation."""
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, DataFrame):
                value.createOrReplaceTempView(f"{prefix}_{f.name}")

    def with_(self, **changes) -> GraphRelations:
        return replace(self, **changes)


_NODE = "struct<method:string,file:string,line:int,class_name:string,confidence:string,children:{}>"


def _tree_type(levels: int = 5) -> str:
    """A call tree's nested type.  Trees are at most 5 levels deep (root and 4 calls)."""
    out = "string"
    for _ in range(levels):
        out = f"array<{_NODE.format(out)}>"
    return out[6:-1]


DOCUMENT_DDL = (
    "repos array<string>, repo_roots map<string,string>, "
    f"entry_points array<struct<id:string,repo:string,type:string,channel:string,class_name:string,method:string,file:string,line:int,message_type:string,method_type:string,call_tree:{_tree_type()},"
    "metrics:struct<depth:int,total_nodes:int,unique_files:int,branch_count:int,thin:boolean>>>, "
    "producers array<struct<id:string,repo:string,type:string,channel:string,method:string,file:string,line:int,message_type:string,response_type:string>>, "
    "cross_repo_links array<struct<channel:string,producers:array<string>,consumers:array<string>,kind:string,verb:string>>, "
    f"methods_total int, unreachable_methods array<struct<{UNREACHABLE_DDL.replace(' ', ':').replace(',:', ',')}>>, generated_at string, engine_version string"
)


def _filled(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of ddl, with '' for null text and 0 for a null line."""
    out = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        column = F.col(name)
        out.append(F.coalesce(column, F.lit("")).alias(name) if kind == "string" else F.coalesce(column, F.lit(0)).alias(name) if name == "line" else column)
    return df.select(*out)


def from_documents(documents: DataFrame) -> GraphRelations:
    """Relations of graph documents (one row of DOCUMENT_DDL); older documents without newer fields are read too."""
    def exploded(name: str) -> DataFrame:
        return documents.select(F.posexplode(name).alias("pos", "x")).select(F.lpad(F.col("pos").cast("string"), 10, "0").alias("ord"), "x.*")

    entries = exploded("entry_points")
    flat = entries.withColumns({m: F.col(f"metrics.{m}") for m in ("depth", "total_nodes", "unique_files", "branch_count", "thin")})
    level = entries.filter("call_tree is not null").select(F.col("id").alias("ep_id"), F.array().cast("array<int>").alias("path"), F.col("call_tree").alias("n"))
    nodes = None
    for depth in range(5):
        here = level.select("ep_id", "path", F.lit(depth).alias("depth"), *[F.col(f"n.{c}") for c in ("method", "class_name", "file", "line", "confidence")])
        nodes = here if nodes is None else nodes.unionByName(here)
        if depth < 4:
            level = level.select("ep_id", "path", F.posexplode("n.children").alias("k", "n")).select("ep_id", F.concat("path", F.array("k")).alias("path"), "n")
    links = exploded("cross_repo_links").withColumns({"kind": F.coalesce("kind", F.lit("message")), "verb": F.coalesce("verb", F.lit(""))})
    members = None
    for side, column in (("producer", "producers"), ("consumer", "consumers")):
        part = links.select("channel", "kind", "verb", F.lit(side).alias("side"), F.posexplode(column).alias("k", "id"), "ord")
        part = part.select("channel", "kind", "verb", "side", "id", F.substring_index("id", ":", 1).alias("repo"), F.concat("ord", F.lit("."), F.lpad(F.col("k").cast("string"), 10, "0")).alias("ord"))
        members = part if members is None else members.unionByName(part)
    first = documents.select("methods_total", F.col("unreachable_methods").isNotNull().alias("indexed")).first()
    unreachable = documents.select(F.explode("unreachable_methods").alias("x")).select("x.*") if first and first.indexed else None
    repos = documents.select(F.posexplode("repos").alias("pos", "repo")).select(F.lpad(F.col("pos").cast("string"), 10, "0").alias("ord"), "repo")
    return GraphRelations(_filled(flat, ENTRY_DDL), _filled(exploded("producers"), PRODUCER_DDL), members, _filled(nodes, NODE_DDL), unreachable, repos, (first.methods_total or 0) if first else 0)


def read_graph(spark: SparkSession, path: str) -> GraphRelations:
    """Relations of a graph document in a JSON file; a missing file is an error."""
    return from_documents(spark.read.schema(DOCUMENT_DDL).option("multiLine", True).json(path))


def links_document(members: DataFrame) -> DataFrame:
    """Links with their members as arrays, for export: channel, kind, verb, producers, consumers.  A row holds a whole channel."""
    ids = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("ord", "id")))), lambda x: x["id"])
    return members.groupBy("channel", "kind", "verb").agg(ids("producer").alias("producers"), ids("consumer").alias("consumers"))


def write_graph(graph: GraphRelations, path: str, snapshot_ts: int) -> None:
    """The relations and the number of methods as Parquet under path/relation/snapshot_ts=..., replacing that snapshot only."""
    spark = graph.entry_points.sparkSession
    spark.range(1).select(F.lit(graph.methods_total).cast("bigint").alias("methods_total")).write.mode("overwrite").parquet(f"{path}/totals/snapshot_ts={snapshot_ts}")
    for f in fields(graph):
        value = getattr(graph, f.name)
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{path}/{f.name}/snapshot_ts={snapshot_ts}")


def drop_snapshot(spark: SparkSession, path: str, snapshot_ts: int) -> None:
    """Deletes what write_graph() wrote for a time, its list of repositories first: by it a snapshot is known."""
    names = [f.name for f in fields(GraphRelations) if f.name != "methods_total"]
    for name in ["repos", *(n for n in names if n != "repos"), "totals"]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/snapshot_ts={int(snapshot_ts)}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_snapshot(spark: SparkSession, path: str, snapshot_ts: int) -> GraphRelations:
    """The relations that write_graph() wrote for a time; without a total there are no methods."""

    def read(name: str, ddl: str) -> DataFrame:
        return spark.read.schema(ddl).parquet(f"{path}/{name}/snapshot_ts={int(snapshot_ts)}")

    ddl = {"entry_points": ENTRY_DDL, "producers": PRODUCER_DDL, "members": MEMBER_DDL, "nodes": NODE_DDL, "repos": "ord string, repo string"}
    try:
        unreachable = read("unreachable", UNREACHABLE_DDL)
    except AnalysisException:  # a graph without that index
        unreachable = None
    try:
        total = read("totals", "methods_total bigint").first()
    except AnalysisException:  # an older snapshot
        total = None
    return GraphRelations(unreachable=unreachable, methods_total=total.methods_total if total else 0, **{name: read(name, columns) for name, columns in ddl.items()})


def nested_trees(nodes: DataFrame, levels: int = 5) -> DataFrame:
    """ep_id, call_tree: node tables as nested trees, from the leaves up; a tree has 50 nodes at most by its cap."""
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    below = None
    for depth in reversed(range(levels)):
        here = nodes.filter(F.col("depth") == depth)
        if below is None:
            fields = here.withColumn("children", F.lit("").cast("string"))
        else:
            empty = F.array().cast(below.schema["children"].dataType)
            fields = here.join(below, ["ep_id", "path"], "left").withColumn("children", F.coalesce("children", empty))
        node = F.struct("method", "file", "line", "class_name", "confidence", "children")
        if depth == 0:
            return fields.select("ep_id", node.alias("call_tree"))
        grouped = fields.groupBy("ep_id", parent.alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("k"), node.alias("n")))).alias("c"))
        below = grouped.select("ep_id", "path", F.transform("c", lambda x: x["n"]).alias("children"))
    raise ValueError("a tree has a level at least")


def graph_document(graph: GraphRelations, generated_at: str = "", engine_version: str = "", roots: dict[str, str] | None = None) -> DataFrame:
    """The graph as one row of DOCUMENT_DDL's shape, with the folders of repositories (roots): an exchange format, which holds the whole graph in a row."""

    def gathered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("x")))), lambda r: r["x"]).alias(name))

    metrics = F.struct("depth", "total_nodes", "unique_files", "branch_count", "thin").alias("metrics")
    entries = graph.entry_points.join(nested_trees(graph.nodes).withColumnRenamed("ep_id", "id"), "id", "left").withColumn("metrics", metrics)
    links = links_document(graph.members).withColumn("ord", F.concat_ws("|", "kind", "channel", "verb"))
    out = gathered(entries, "entry_points", "id", "repo", "type", "channel", "class_name", "method", "file", "line", "message_type", "method_type", "call_tree", "metrics")
    out = out.join(gathered(graph.producers, "producers", *[p.split(" ")[0] for p in PRODUCER_DDL.split(", ")[1:]])).join(gathered(links, "cross_repo_links", "channel", "producers", "consumers", "kind", "verb"))
    out = out.join(graph.repos.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "repo"))), lambda r: r["repo"]).alias("repos")))  # one row each
    if graph.unreachable is not None:
        out = out.join(graph.unreachable.agg(F.array_sort(F.collect_list(F.struct(*[p.split(" ")[0] for p in UNREACHABLE_DDL.split(", ")]))).alias("unreachable_methods")))
    places = F.create_map(*[F.lit(x) for pair in sorted((roots or {}).items()) for x in pair]).cast("map<string,string>")
    return out.withColumns({"repo_roots": places, "methods_total": F.lit(graph.methods_total), "generated_at": F.lit(generated_at), "engine_version": F.lit(engine_version)})

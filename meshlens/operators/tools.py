"""The query tools: questions about one graph, each a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MESSAGE_CONSUMERS, has_channel, repo_of, strip
from ..plans.fixpoint import cut
from ..plans.relations import UNREACHABLE_DDL, GraphRelations

_PLACE = ("id", "repo", "type", "channel", "method", "file", "line")


def matches(query: str, *columns: str) -> Column:
    """Whether the columns, joined by spaces, hold the query, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def sorted_set(value: Column) -> Column:
    """Distinct values in order, as text; for sets that are small by nature, such as repositories of a channel."""
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def search_entries(graph: GraphRelations, query: str, type: str = "") -> DataFrame:
    found = graph.entry_points.filter(matches(query, "method", "class_name", "channel", "id", "message_type"))
    return (found.filter(F.col("type") == type) if type else found).select("id", "repo", "type", "channel", "method", "class_name", "file", "line")


def search_producers(graph: GraphRelations, query: str) -> DataFrame:
    return graph.producers.filter(matches(query, "method", "channel", "type", "id")).select(*_PLACE)


def search_files(graph: GraphRelations, query: str) -> DataFrame:
    files = graph.entry_points.select("file").union(graph.nodes.select("file")).union(graph.producers.select("file"))
    return files.filter((F.col("file") != "") & F.contains(F.lower("file"), F.lit(query.lower()))).distinct()


def search_code(graph: GraphRelations, query: str, type: str = "", search_type: str = "all") -> DataFrame:
    """kind and text of every hit: entry point and producer ids, files."""
    parts = {"entry_points": search_entries(graph, query, type).select("id"), "producers": search_producers(graph, query).select("id"), "files": search_files(graph, query)}
    out = None
    for kind, part in parts.items():
        if search_type in (kind, "all"):
            part = part.toDF("hit").withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = parts["files"].toDF("hit").withColumn("kind", F.lit("")).limit(0)
    return out


def get_node(graph: GraphRelations, entry_point_id: str) -> DataFrame:
    """The call tree of one entry point in pre-order: rank, method, file, line, confidence, depth; no row if there is none."""
    nodes = graph.nodes.filter(F.col("ep_id") == entry_point_id)
    return nodes.select(F.row_number().over(Window.orderBy("path")).alias("rank"), "method", "file", "line", "confidence", "depth")  # one tree: 50 nodes at most


def get_channel_flow(graph: GraphRelations, channel: str) -> DataFrame:
    """Producers and message consumers of channels that hold a text: side, id, repo, method, type, file, line."""
    hit = F.contains(F.lower("channel"), F.lit(channel.lower()))
    consumers = graph.entry_points.filter(F.col("type").isin(*MESSAGE_CONSUMERS))
    both = [(graph.producers, "producer"), (consumers, "consumer")]
    out = [df.filter(hit).select(F.lit(side).alias("side"), "id", "repo", "method", "type", "file", "line") for df, side in both]
    return out[0].unionByName(out[1])


def channel_flow_summary(graph: GraphRelations, channel: str) -> DataFrame:
    flow = get_channel_flow(graph, channel)
    repo = lambda side: F.when(F.col("side") == side, F.col("repo"))
    return flow.agg(
        F.lit(channel).alias("channel"), sorted_set(repo("producer")).alias("producer_repos"), sorted_set(repo("consumer")).alias("consumer_repos"),
        (F.countDistinct("repo") > 1).alias("is_cross_repo"), F.count(repo("producer")).alias("n_producers"), F.count(repo("consumer")).alias("n_consumers"),
    )


def list_channels(members: DataFrame) -> DataFrame:
    """One row for each channel name: its first link's kind, verb, repositories, counts and whether it crosses repositories."""
    members = cut(members)  # read twice below, and dear to make
    first = members.groupBy("channel").agg(F.min(F.struct("ord", "kind", "verb")).alias("f")).select("channel", F.col("f.kind").alias("kind"), F.col("f.verb").alias("verb"))
    repo = lambda side: F.when((F.col("side") == side) & F.col("id").contains(":"), F.substring_index("id", ":", 1))
    return members.join(first, ["channel", "kind", "verb"], "left_semi").groupBy("channel", "kind", "verb").agg(
        sorted_set(repo("producer")).alias("producer_repos"), sorted_set(repo("consumer")).alias("consumer_repos"),
        F.count(F.when(F.col("side") == "producer", 1)).alias("producer_count"), F.count(F.when(F.col("side") == "consumer", 1)).alias("consumer_count"),
        (F.countDistinct(F.coalesce(repo("producer"), repo("consumer"))) > 1).alias("is_cross_repo"),
    )


def find_orphans(graph: GraphRelations) -> DataFrame:
    """Producers without a consumer and consumers without a producer on the same trimmed channel: side and place.

    HTTP calls have no message channel; gRPC calls are held against message consumers and so always remain.
    """
    consumers = graph.entry_points.filter(F.col("type").isin(*MESSAGE_CONSUMERS)).withColumn("channel", strip(F.col("channel"))).filter(has_channel(F.col("channel")))
    producers = graph.producers.filter(F.col("type") != "http-call").withColumn("channel", strip(F.col("channel"))).filter(has_channel(F.col("channel")))
    lone = producers.join(consumers.select("channel").distinct(), "channel", "left_anti").withColumn("repo", F.when(F.col("repo") == "", repo_of(F.col("id"))).otherwise(F.col("repo")))
    deaf = consumers.join(producers.select("channel").distinct(), "channel", "left_anti")
    return lone.select(F.lit("producer").alias("side"), *_PLACE).unionByName(deaf.select(F.lit("consumer").alias("side"), *_PLACE))


def orphan_channels(graph: GraphRelations) -> DataFrame:
    return find_orphans(graph).select("channel").distinct()


def orphans(graph: GraphRelations) -> dict[str, DataFrame]:
    """find_orphans() as an answer: producers, consumers, their channels in order, and a summary of counts."""
    found = cut(find_orphans(graph))
    side = lambda name: found.filter(F.col("side") == name).drop("side").orderBy("channel", "id")
    n = lambda name: F.count(F.when(F.col("side") == name, 1)).alias(f"orphan_{name}s")
    channels = found.select("channel").distinct().orderBy("channel")
    return {"producers": side("producer"), "consumers": side("consumer"), "channels": channels, "summary": found.agg(n("producer"), n("consumer"), F.countDistinct("channel").alias("orphan_channels"))}


def channel_flow(graph: GraphRelations, channel: str) -> dict[str, DataFrame]:
    """get_channel_flow() as an answer: producers, consumers, and the repositories of both sides."""
    found = get_channel_flow(graph, channel)
    side = lambda name: found.filter(F.col("side") == name).drop("side")
    return {"producers": side("producer"), "consumers": side("consumer"), "summary": channel_flow_summary(graph, channel)}


def thin_handlers(graph: GraphRelations) -> DataFrame:
    """Entry points marked thin; where the mark is missing, those whose tree has one node."""
    thin = F.coalesce(F.col("thin"), F.coalesce(F.col("total_nodes"), F.lit(1)) <= 1)
    return graph.entry_points.filter(thin).select(*_PLACE)


def isolated_repos(graph: GraphRelations) -> DataFrame:
    linked = graph.members.select(repo_of(F.col("id")).alias("repo")).distinct()
    return graph.repos.select("repo").join(linked, "repo", "left_anti")


def dead_code_summary(graph: GraphRelations) -> DataFrame:
    """One row: counts of unreachable methods, thin handlers and isolated repositories."""
    spark = graph.entry_points.sparkSession
    n = lambda df, name: df.agg(F.count("*").alias(name))
    none = spark.range(1).select(F.lit(0).cast("bigint").alias("unreachable_methods"))
    out = n(graph.unreachable, "unreachable_methods") if graph.unreachable is not None else none
    out = out.join(n(thin_handlers(graph), "thin_handlers")).join(n(isolated_repos(graph), "isolated_repos"))  # one row each
    return out.withColumns({"methods_total": F.lit(graph.methods_total), "method_index_available": F.lit(graph.unreachable is not None)})


def overview_types(graph: GraphRelations) -> DataFrame:
    return graph.entry_points.groupBy("type").agg(F.count("*").alias("n"))


def overview_repos(graph: GraphRelations) -> DataFrame:
    """Entry points and producers of each repository that has any."""
    e = graph.entry_points.groupBy("repo").agg(F.count("*").alias("e"))
    p = graph.producers.groupBy("repo").agg(F.count("*").alias("p"))
    return e.join(p, "repo", "full_outer").select("repo", F.coalesce("e", F.lit(0)).alias("entry_points"), F.coalesce("p", F.lit(0)).alias("producers"))


def overview_totals(graph: GraphRelations) -> DataFrame:
    """One row of totals over the whole graph."""
    e = graph.entry_points.agg(F.count("*").alias("total_entry_points"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.coalesce(F.sum("total_nodes"), F.lit(0)).alias("total_call_nodes"))
    p = graph.producers.agg(F.count("*").alias("total_producers"))
    r = graph.repos.agg(F.count("*").alias("total_repos"))
    c = graph.members.select("channel", "kind", "verb").distinct().agg(F.count("*").alias("total_channels"))
    return e.join(p).join(r).join(c)  # one row each


def overview_channels(graph: GraphRelations) -> DataFrame:
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    return graph.members.groupBy("channel", "kind", "verb").agg(n("producer").alias("producers"), n("consumer").alias("consumers"))


def dead_code(graph: GraphRelations) -> dict[str, DataFrame]:
    """The lists behind dead_code_summary(), and that."""
    unreachable = graph.unreachable if graph.unreachable is not None else graph.entry_points.sparkSession.createDataFrame([], UNREACHABLE_DDL)
    return {"unreachable_methods": unreachable, "thin_handlers": thin_handlers(graph), "isolated_repos": isolated_repos(graph), "summary": dead_code_summary(graph)}


def architecture_overview(graph: GraphRelations) -> dict[str, DataFrame]:
    """Totals, entry points by type, repositories and links."""
    return {"totals": overview_totals(graph), "entry_types": overview_types(graph), "repo_summary": overview_repos(graph), "channel_summary": overview_channels(graph)}


def entry_point(graph: GraphRelations, entry_point_id: str) -> dict[str, DataFrame]:
    """One entry point and its call tree; an unknown id is an error."""
    own = graph.entry_points.filter(F.col("id") == entry_point_id)
    if own.isEmpty():
        raise LookupError(f"there is no entry point {entry_point_id!r}")
    return {"entry_point": own, "call_tree_flat": get_node(graph, entry_point_id)}


def callers(graph: GraphRelations, method_name: str) -> DataFrame:
    """find_callers() with the entry point's type, channel and repository."""
    from .tree import find_callers

    place = graph.entry_points.select(F.col("id").alias("ep_id"), "type", "channel", "repo").dropDuplicates(["ep_id"])
    return find_callers(graph.nodes, method_name).join(place, "ep_id", "left").select("ep_id", "type", "channel", "repo", "called_method", "call_path")


def select_project(projects: DataFrame, project: str = "") -> DataFrame:
    """The project of an id, or the newest that is ready; an error if there is none."""
    from .store import default_project

    found = projects.filter(F.col("id").cast("string") == project) if project else default_project(projects)
    if found.isEmpty():
        raise LookupError(f"there is no project {project!r}" if project else "no project is ready")
    return found


def task_complete(status: str = "complete", message: str = "", next_steps: str = "", summary: str = "") -> dict:
    """What a caller reports when it is done; an unknown status counts as complete."""
    return {"type": "task_complete", "status": status if status in ("complete", "incomplete") else "complete", "message": message or summary or "", "next_steps": next_steps or ""}


def run_tool(graph: GraphRelations, name: str, arguments: dict) -> DataFrame | dict:
    """A tool by its name: its rows, lazy, or several such by name.

    Arguments that it doesn't have are dropped.  What fails while the plan is made is returned as
    {"error": ...}; what fails when rows are fetched, fetch() returns so.
    """
    import inspect

    tools = registry()
    if name not in tools:
        return {"error": f"there is no tool {name!r}"}
    tool = tools[name]
    names = [p for p in inspect.signature(tool).parameters if p != "graph"]
    try:
        return tool(graph, **{k: v for k, v in arguments.items() if k in names})
    except Exception as e:  # noqa: BLE001 - what a tool raises is its answer
        return {"error": str(e)}


def fetch(answer: DataFrame | dict, rows: int = 1000) -> dict:
    """A tool's answer as plain values: the first rows of each table, or the error that fetching them met.  "more" says that, or of which tables, there are further rows."""
    try:
        if isinstance(answer, DataFrame):
            found = answer.limit(rows + 1).collect()
            return {"rows": [r.asDict(recursive=True) for r in found[:rows]]} | ({"more": True} if len(found) > rows else {})
        parts = {k: fetch(v, rows) if isinstance(v, DataFrame) else v for k, v in answer.items()}
        more = sorted(k for k, v in parts.items() if isinstance(answer[k], DataFrame) and "more" in v)
        return {k: v["rows"] if isinstance(answer[k], DataFrame) else v for k, v in parts.items()} | ({"more": more} if more else {})
    except Exception as e:  # noqa: BLE001 - what a query raises is its answer
        return {"error": str(e)}


def registry() -> dict[str, Callable]:
    from ..sources.files import resolve_source_path, source_lines
    from .cycles import find_cycles
    from .diff import diff_graphs
    from .store import list_projects
    from .tree import trace_path

    def get_source(graph, files, file_path, start_line=1, end_line=0, highlight_line=0):
        return source_lines(resolve_source_path(files, file_path), start_line, end_line, highlight_line)

    return {
        "search_code": search_code, "get_node": entry_point, "get_channel_flow": channel_flow, "find_orphans": orphans, "get_architecture_overview": architecture_overview,
        "find_callers": callers, "trace_path": lambda graph, from_method, to_method: trace_path(graph.nodes, from_method, to_method),
        "list_channels": lambda graph: list_channels(graph.members), "find_cycles": lambda graph: find_cycles(graph.members), "find_dead_code": dead_code, "get_source": get_source,
        "diff_graphs": lambda graph, old_graph: diff_graphs(old_graph, graph), "list_projects": lambda graph, projects: list_projects(projects), "select_project": lambda graph, projects, project="": select_project(projects, project),
        "task_complete": lambda graph, status="complete", message="", next_steps="", summary="": task_complete(status, message, next_steps, summary),
    }

"""Projects, snapshots, boards, conversations and diagrams as tables."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import auto_title, occurrences, strip
from ..plans.relations import GraphRelations, drop_snapshot, read_snapshot, write_graph

#: Kept snapshots, listed board items, titles that a first message replaces.
KEPT_SNAPSHOTS = 10
LISTED_ITEMS = 50
OVERVIEW_ITEMS = 10
PLACEHOLDER_TITLES = ("", "New conversation", "Default conversation")


# ---------------------------------------------------------------- projects and snapshots


def retained_snapshots(snapshots: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The newest `keep` snapshots (project_id, snapshot_ts) of each project; ids must be digits."""
    good = snapshots.filter(F.col("snapshot_ts").cast("string").rlike("^[0-9]+$"))
    newest = Window.partitionBy("project_id").orderBy(F.col("snapshot_ts").cast("decimal(38,0)").desc())
    return good.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("project_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))


def list_snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Times of the snapshots that write_graph() has put into a folder, newest first; there are as many as are kept."""
    try:
        rows = spark.read.parquet(f"{folder}/repos").select("snapshot_ts").distinct().collect()
    except AnalysisException:  # nothing has been written yet
        return []
    return sorted((int(r[0]) for r in rows), reverse=True)


def save_snapshot(graph: GraphRelations, folder: str, at: int, keep: int = KEPT_SNAPSHOTS) -> list[int]:
    """Writes a graph as the snapshot of a time and deletes all but the newest `keep`; returns the times of those, newest first."""
    spark = graph.entry_points.sparkSession
    write_graph(graph, folder, at)
    known = list_snapshots(spark, folder)
    for old in known[keep:]:
        drop_snapshot(spark, folder, old)
    return known[:keep]


def board_overview(boards: DataFrame, items: DataFrame, shown: int = OVERVIEW_ITEMS, order: str = "ord") -> DataFrame:
    """id, name, items, columns (column and count, by name), first (the first `shown` items by stored order: id, title, status) of every board."""
    columns = board_columns(items).groupBy(F.col("board_id").alias("id")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("column", "n"))).alias("columns"))  # a board's columns are few
    place = F.row_number().over(Window.partitionBy("board_id").orderBy(order))
    top = items.withColumn("_k", place).filter(F.col("_k") <= shown).groupBy(F.col("board_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(F.col("id").cast("string").alias("id"), "title", "status").alias("i")))).alias("f"))
    rows = boards.select("id", "name").join(columns, "id", "left").join(top, "id", "left")
    return rows.select("id", "name", F.coalesce("n", F.lit(0)).alias("items"), "columns", F.transform("f", lambda x: x["i"]).alias("first"))


def project_diff(graph: GraphRelations, folder: str, at: str = "", light: bool = False) -> dict:
    """What changed since a snapshot of a folder, the newest or that of a time; an unknown time is an error.

    diff has diff_graphs(); old_graph and new_graph come along unless light is set.  Without any
    snapshot there is no diff.
    """
    from .diff import diff_graphs

    spark = graph.entry_points.sparkSession
    known = list_snapshots(spark, folder)
    if at and (not at.isdigit() or int(at) not in known):
        raise LookupError(f"there is no snapshot {at!r}")
    if not known:
        return {"diff": None, "snapshots": [], "compared_at": "", "no_baseline": True}
    time = int(at) if at else known[0]
    old = read_snapshot(spark, folder, time)
    out = {"diff": diff_graphs(old, graph), "snapshots": known, "compared_at": time, "no_baseline": False}
    return out if light else out | {"old_graph": old, "new_graph": graph}


def seed_import(projects: DataFrame, documents: DataFrame, now: str) -> DataFrame:
    """projects with those of graph documents (name, text: JSON) that aren't among them: id, name, created_at, updated_at, status, repos, entry_points, producers, links.

    Documents are read as variants, so those of older versions without newer fields, or with fields of other kinds, are read too: what
    isn't an array counts nothing.  A project's id is made of its document's digest: a document that is imported again, or twice at
    once (under the least name), is one project.  Texts that aren't JSON objects are left out.
    """
    v = documents.select("name", "text", F.try_parse_json("text").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    size = lambda field: F.coalesce(F.size(F.try_variant_get("v", f"$.{field}", "array<variant>")), F.lit(0))
    made = F.coalesce(F.nullif(F.try_variant_get("v", "$.generated_at", "string"), F.lit("")), F.lit(now))
    found = v.select(
        F.concat(F.lit("seed-"), F.substring(F.sha2("text", 256), 1, 16)).alias("id"), "name", made.alias("created_at"), F.lit(now).alias("updated_at"), F.lit("ready").alias("status"),
        size("repos").alias("repos"), size("entry_points").alias("entry_points"), size("producers").alias("producers"), size("cross_repo_links").alias("links"),
    )
    once = found.groupBy("id").agg(F.min(F.struct(*[c for c in found.columns if c != "id"])).alias("r")).select("id", "r.*")
    return projects.unionByName(once.join(projects.select("id"), "id", "left_anti"))


def list_projects(projects: DataFrame) -> DataFrame:
    """Projects with their place, newest first."""
    return projects.orderBy(F.col("updated_at").desc(), "id")


def upsert_rows(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows replace those of table with the same key; others are added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def rename_project(projects: DataFrame, project_id: str, name: str) -> DataFrame:
    """A blank name is an error; white space around it goes."""
    if not name.strip():
        raise ValueError("a project's name can't be blank")
    return projects.withColumn("name", F.when(F.col("id") == project_id, F.lit(name.strip())).otherwise(F.col("name")))


def delete_project(projects: DataFrame, project_id: str) -> DataFrame:
    return projects.filter(F.col("id") != project_id)


def default_project(projects: DataFrame) -> DataFrame:
    """The newest project that is ready."""
    return projects.filter("status = 'ready'").orderBy(F.col("updated_at").desc(), "id").limit(1)


def reap_stale(projects: DataFrame, graphs: DataFrame) -> DataFrame:
    """Projects left analyzing become ready if there is a graph of them (graphs: id), else error."""
    known = graphs.select("id").distinct().withColumn("_has", F.lit(True))
    status = F.when(F.col("status") != "analyzing", F.col("status")).when(F.col("_has"), F.lit("ready")).otherwise(F.lit("error"))
    return projects.join(known, "id", "left").withColumn("status", status).drop("_has")


def check_updates(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """repos (name, source, commit) with heads (source, remote_commit): whether they are stale.

    A remote is stale if its head is known and differs; a local repository only if both are known.
    """
    remote, mine = F.coalesce("remote_commit", F.lit("")), F.coalesce("commit", F.lit(""))
    stale = (remote != "") & (remote != mine) & (~F.col("source").startswith("local:") | (mine != ""))
    return repos.join(heads, "source", "left").select("name", "source", "commit", "remote_commit", stale.alias("stale"))


def to_pull(checked: DataFrame | None, repos: DataFrame) -> DataFrame:
    """Repositories to refresh: the stale ones, or all if the check failed (None)."""
    return repos if checked is None else repos.join(checked.filter("stale").select("source"), "source", "left_semi")


def unique_names(repos: DataFrame, order: str = "ord") -> DataFrame:
    """name with -2, -3, ... on later rows of the same name."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return repos.withColumn("_nth", nth).withColumn("unique_name", F.when(F.col("_nth") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("_nth").cast("string")))).drop("_nth")


# ---------------------------------------------------------------- boards


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape(t) if isinstance(t, str) else t)


BOARD_ISSUE = "number long, title string, state string, assignee struct<login:string>, labels array<struct<name:string>>, url string, html_url string, updated_at string, pull_request string"
BOARD_PROJECT_ITEM = (
    "id long, fields array<struct<name:string,value:string>>, updated_at string, content struct<number:long,title:string,assignees:array<string>,labels:array<struct<name:string>>,html_url:string,updated_at:string>"
)


def normalize_issues(pages: DataFrame, scope: str) -> DataFrame:
    """Board items of issue payloads (payload: JSON of an issue); pull requests are dropped."""
    it = pages.select(F.from_json("payload", BOARD_ISSUE).alias("i"), "payload").select("i.*", "payload").filter("pull_request is null")
    number = F.col("number").cast("string")
    return it.select(
        F.concat(F.lit(f"github:{scope}#"), number).alias("id"), F.coalesce(number, F.lit("")).alias("number"), html_unescape(F.coalesce("title", F.lit(""))).alias("title"),
        F.lower(F.coalesce("state", F.lit("open"))).alias("status"), F.coalesce("assignee.login", F.lit("")).alias("assignee"),
        F.filter(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"),
        F.coalesce("url", "html_url", F.lit("")).alias("url"), F.coalesce("updated_at", F.lit("")).alias("updated_at"), F.col("payload").alias("raw"),
    )


def normalize_project_items(pages: DataFrame, scope: str) -> DataFrame:
    """Board items of project-item payloads; the status is the field called Status, an object's name or plain text."""
    it = pages.select(F.from_json("payload", BOARD_PROJECT_ITEM).alias("i"), "payload").select("i.*", "payload")
    field = F.get(F.filter(F.coalesce("fields", F.array().cast("array<struct<name:string,value:string>>")), lambda f: F.lower(F.coalesce(f["name"], F.lit(""))) == "status"), F.lit(0))["value"]
    status = F.coalesce(F.get_json_object(field, "$.name"), F.when(~field.startswith("{"), field), F.lit(""))
    number = F.col("content.number").cast("string")
    return it.select(
        F.concat(F.lit(f"github-project:{scope}#"), F.col("id").cast("string")).alias("id"), F.coalesce(number, F.lit("")).alias("number"), html_unescape(F.coalesce("content.title", F.lit(""))).alias("title"),
        status.alias("status"), F.coalesce(F.get("content.assignees", F.lit(0)), F.lit("")).alias("assignee"),
        F.filter(F.transform(F.coalesce("content.labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "").alias("labels"),
        F.coalesce("content.html_url", F.lit("")).alias("url"), F.coalesce("updated_at", "content.updated_at", F.lit("")).alias("updated_at"), F.col("payload").alias("raw"),
    )


def board_columns(items: DataFrame) -> DataFrame:
    """board_id, column, n: items by status; without one they count as `no status`."""
    status = F.when(F.coalesce("status", F.lit("")) == "", F.lit("no status")).otherwise(F.col("status"))
    return items.groupBy("board_id", status.alias("column")).agg(F.count("*").alias("n"))


def list_boards(boards: DataFrame, items: DataFrame) -> DataFrame:
    sizes = items.groupBy(F.col("board_id").alias("id")).agg(F.count("*").alias("n"))
    return boards.join(sizes, "id", "left").select("id", "name", "kind", F.coalesce("n", F.lit(0)).alias("items"))


def board_items(items: DataFrame, board_id: str, status: str | None = None, order: str = "ord", limit: int = LISTED_ITEMS) -> DataFrame:
    """A board's first items in stored order, of a status (whatever the case) if one is given."""
    mine = items.filter(F.col("board_id") == board_id)
    mine = mine.filter(F.lower("status") == status.lower()) if status else mine
    return mine.orderBy(order).limit(limit)


def sync_board(boards: DataFrame, items: DataFrame, board_id: str, fresh: DataFrame, now: str, title: str = "") -> tuple[DataFrame, DataFrame]:
    """(boards, items) after a pull: the board's items are those of `fresh`, as it has them, and synced_at is `now`.

    A title from the source renames a project's board that has no name of its own (name_override).
    An unknown board is an error; an empty `fresh` leaves the board without items.
    """
    mine = F.col("id") == board_id
    if boards.filter(mine).isEmpty():
        raise LookupError(f"no board {board_id!r}")
    renamed = mine & (F.col("kind") == "project") & ~F.coalesce("name_override", F.lit(False)) & F.lit(bool(title))
    after = boards.withColumn("name", F.when(renamed, F.lit(title)).otherwise(F.col("name"))).withColumn("synced_at", F.when(mine, F.lit(now)).otherwise(F.col("synced_at")))
    kept = items.filter(~F.col("board_id").eqNullSafe(F.lit(board_id)))
    return after, kept.unionByName(fresh.withColumn("board_id", F.lit(board_id)))


#: Columns of requests to boards, in the order of ord, and what can be asked.
REQUEST_DDL = "request_id string, ord bigint, board_id string, action string, item_id string, title string, body string, labels array<string>, status string"
BOARD_ACTIONS = ("move", "comment", "create")


def request_board_writes(items: DataFrame, requests: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, outbox) after requests (REQUEST_DDL) to boards: what a connector has to send, and the items as they will be.

    A move sets an item's status, the last one of an item counting; a comment leaves items alone; a create adds an item
    with its request's id, unless an open item of its board, or an earlier request, has the title (whatever its case
    and white space).  outbox has a row for each request: request_id, board_id, action, item_id, payload (JSON) and
    error, null where it is to be sent.  Requests that `sent` (request_id) has, and all but the first row of a repeated
    one, are left out, so that running again changes nothing.  items have at least board_id, id, title and status.
    """
    columns = [part.split(" ")[0] for part in REQUEST_DDL.split(", ")[1:]]  # ord first
    once = requests.groupBy("request_id").agg(F.min(F.struct(*columns)).alias("r")).select("request_id", "r.*")
    fresh = once.join(sent.select("request_id").distinct(), "request_id", "left_anti")
    title = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    known = items.select("board_id", F.col("id").cast("string").alias("item_id"), F.lit(True).alias("_known")).distinct()
    open_titles = items.filter(F.lower(F.coalesce("status", F.lit(""))) != "closed").select("board_id", title("title").alias("_title")).distinct().withColumn("_open", F.lit(True))
    first = fresh.filter("action = 'create'").groupBy("board_id", title("title").alias("_title")).agg(F.min(F.struct("ord", "request_id")).alias("_first"))
    met = fresh.withColumn("_title", F.when(F.col("action") == "create", title("title")))
    met = met.join(known, ["board_id", "item_id"], "left").join(open_titles, ["board_id", "_title"], "left").join(first, ["board_id", "_title"], "left")
    error = (
        F.when(~F.coalesce(F.col("action").isin(*BOARD_ACTIONS), F.lit(False)), F.concat(F.lit("boards have no such write: "), F.coalesce("action", F.lit(""))))
        .when((F.col("action") == "create") & (F.col("_title") == ""), "a new item needs a title")
        .when((F.col("action") == "create") & (F.col("_open") | (F.col("_first.request_id") != F.col("request_id"))), "an open item has this title")
        .when((F.col("action") != "create") & F.col("_known").isNull(), "the board has no such item")
    )
    payload = F.to_json(F.struct("title", "body", "labels", "status"))
    outbox = met.select("request_id", "ord", "board_id", "action", F.when(F.col("action") == "create", F.col("request_id")).otherwise(F.col("item_id")).alias("item_id"), "title", "labels", "status", payload.alias("payload"), error.alias("error"))
    done = outbox.filter("error IS NULL")
    moved = done.filter("action = 'move'").groupBy("board_id", F.col("item_id").cast(items.schema["id"].dataType).alias("id")).agg(F.max_by("status", F.struct("ord", "request_id")).alias("_status"))
    after = items.join(moved, ["board_id", "id"], "left").withColumn("status", F.coalesce("_status", "status")).select(items.columns)
    made = done.filter("action = 'create'").select("board_id", F.col("item_id").cast(items.schema["id"].dataType).alias("id"), strip(F.col("title")).alias("title"), F.coalesce("status", F.lit("")).alias("status"))
    return after.unionByName(made, allowMissingColumns=True), outbox.select("request_id", "board_id", "action", "item_id", "payload", "error")


def is_duplicate_title(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Of titles (title) those that an open item has already."""
    return titles.join(items.filter("status <> 'closed'").select("title").distinct(), "title", "left_semi")


# ---------------------------------------------------------------- conversations and diagrams


def list_conversations(headers: DataFrame, messages: DataFrame, kind: str | None = None) -> DataFrame:
    """Conversations with their number of messages, newest first; those without a kind are chats."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    rows = headers.withColumn("kind", F.coalesce("kind", F.lit("chat"))).join(n, "conv_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return (rows.filter(F.col("kind") == kind) if kind else rows).orderBy(F.col("updated_at").desc(), "conv_id")


def default_conversation(headers: DataFrame, kind: str = "chat") -> DataFrame:
    return headers.filter(F.coalesce("kind", F.lit("chat")) == kind).orderBy(F.col("updated_at").desc(), "conv_id").limit(1)


def titles(messages: DataFrame) -> DataFrame:
    """conv_id, title: from the first message of a user."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", auto_title(F.coalesce("text", F.lit(""))).alias("title"))


def retitle(headers: DataFrame, messages: DataFrame) -> DataFrame:
    """Placeholder titles replaced by titles()."""
    made = titles(messages).withColumnRenamed("title", "_made")
    title = F.when(F.coalesce("title", F.lit("")).isin(*PLACEHOLDER_TITLES), F.coalesce("_made", "title")).otherwise(F.col("title"))
    return headers.join(made, "conv_id", "left").withColumn("title", title).drop("_made")


def patch_text(df: DataFrame, column: str, edits: list[tuple[str, str]]) -> DataFrame:
    """Find-and-replace edits on a text column, all or nothing a row: the text, `patched` (replacements), `missing` (texts not found)."""
    text = F.coalesce(column, F.lit(""))
    missing = F.filter(F.array(*[F.when(~F.contains(text, F.lit(f)), F.lit(f)) for f, _ in edits]).cast("array<string>"), lambda x: x.isNotNull()) if edits else F.array().cast("array<string>")
    done, total = text, F.lit(0)
    for find, new in edits:
        if find:
            total = total + occurrences(done, F.lit(find))
            done = F.replace(done, F.lit(find), F.lit(new))
    ok = F.size(missing) == 0
    return df.withColumns({column: F.when(ok, done).otherwise(F.col(column)), "patched": F.when(ok, total).otherwise(0), "missing": missing})


#: Columns of diagrams, and of changes to them: one change a conversation, what it doesn't need left null.
DIAGRAM_DDL = "conv_id string, id string, header string, kind string, code string, updated_at string, ord bigint"
CHANGE_DDL = "conv_id string, action string, diagram_id string, header string, code string, kind string, edits array<struct<find:string,replace:string>>, now string, new_id string"
#: What can be done to diagrams, and what they are written in.
DIAGRAM_ACTIONS = ("add", "replace", "append", "patch", "remove", "get", "clear")
DIAGRAM_KINDS = ("mermaid", "html", "markdown")
#: Characters of a text to be replaced that a report shows.
REPORTED_CHARS = 80


def _targets(diagrams: DataFrame, changes: DataFrame) -> DataFrame:
    """changes with their action spelt out, how many diagrams the conversation has, and the one that is meant (t, null if none is).

    That is the diagram of the id, or the only one where no id is given.  Replacing or appending in a
    conversation without diagrams adds one.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked = changes.select("conv_id", F.lower(F.trim(F.when(blank("action") == "", "add").otherwise(F.col("action")))).alias("action"), blank("diagram_id").alias("diagram_id"), blank("header").alias("header"), blank("code").alias("code"),
        F.when(F.col("kind").isin(*DIAGRAM_KINDS), F.col("kind")).otherwise(DIAGRAM_KINDS[0]).alias("kind"), F.filter(F.coalesce("edits", F.array().cast("array<struct<find:string,replace:string>>")), lambda e: e.isNotNull()).alias("edits"), "now", "new_id")
    sizes = diagrams.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.min(F.struct("ord", "id")).alias("first"), F.collect_set("id").alias("ids"))  # a panel is small by nature
    met = asked.join(sizes, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.withColumn("action", F.when(F.col("action").isin("replace", "append") & (F.col("diagram_id") == "") & (F.col("n") == 0), "add").otherwise(F.col("action")))
    known = F.coalesce(F.array_contains("ids", F.col("diagram_id")), F.lit(False))
    t = F.when(known, F.col("diagram_id")).when((F.col("diagram_id") == "") & (F.col("n") == 1), F.col("first.id"))
    return met.withColumns({"t": t, "known": known}).drop("first", "ids")


def change_diagrams(diagrams: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagrams (DIAGRAM_DDL) after changes (CHANGE_DDL), and what became of each: conv_id, action, diagram_id, replaced, applied, error.

    add puts a diagram last; replace and append write the meant one's code; patch makes all its
    find-and-replace edits, in order, or none, and reports how often each replaced (applied: find, cut to REPORTED_CHARS,
    and replacements); remove and clear take away; get changes nothing.  Many conversations change at once, and those
    without a change stay as they are.
    """
    asked = _targets(diagrams, changes)
    action = F.col("action")
    ask = asked.select("conv_id", action.alias("a"), "t", F.col("diagram_id").alias("wanted"), F.col("header").alias("h"), F.col("code").alias("c"), F.col("kind").alias("k"), "edits", "now")
    met = diagrams.join(ask, "conv_id", "left")
    mine = F.coalesce(F.col("id") == F.col("t"), F.lit(False))
    real = F.filter("edits", lambda e: F.coalesce(e["find"], F.lit("")) != "")
    fits = (F.size("edits") > 0) & F.forall("edits", lambda e: F.contains(F.col("code"), F.coalesce(e["find"], F.lit(""))))
    report = lambda acc, e: F.struct(F.substring(e["find"], 1, REPORTED_CHARS).alias("find"), occurrences(acc["text"], e["find"]).cast("int").alias("replacements"))
    start = F.struct(F.col("code").alias("text"), F.array().cast("array<struct<find:string,replacements:int>>").alias("applied"))
    step = lambda acc, e: F.struct(F.replace(acc["text"], e["find"], F.coalesce(e["replace"], F.lit(""))).alias("text"), F.array_append(acc["applied"], report(acc, e)).alias("applied"))
    met = met.withColumns({"mine": mine, "patched": F.when(mine & (F.col("a") == "patch") & fits, F.aggregate(real, start, step))})
    absent = F.transform(F.filter("edits", lambda e: ~F.contains(F.col("code"), F.coalesce(e["find"], F.lit("")))), lambda e: e["find"])
    told = met.filter("mine and a = 'patch'").select("conv_id", F.col("patched.applied").alias("applied"), F.when(F.col("patched").isNull(), F.array_join(absent, ", ")).alias("absent"))
    does = lambda *names: F.col("mine") & F.col("a").isin(*names)
    gone = F.coalesce((F.col("a") == "clear") | (F.col("a") == "remove") & (F.col("id") == F.col("wanted")), F.lit(False))
    code = F.when(does("append"), F.concat("code", "c")).when(does("replace") & (F.col("c") != ""), F.col("c")).otherwise(F.coalesce("patched.text", "code"))
    header = F.when(does("append", "replace") & (F.col("h") != ""), F.trim("h")).otherwise(F.col("header"))
    touched = does("append", "replace") | F.col("patched").isNotNull()
    stay = met.filter(~gone).select("conv_id", "id", header.alias("header"), F.when(does("replace"), F.col("k")).otherwise(F.col("kind")).alias("kind"), code.alias("code"), F.when(touched, F.col("now")).otherwise(F.col("updated_at")).alias("updated_at"), "ord")
    new_id = F.when((F.col("diagram_id") != "") & ~F.col("known"), F.col("diagram_id")).otherwise(F.col("new_id"))
    title = F.trim(F.when(F.col("header") != "", F.col("header")).otherwise("Diagram"))
    added = asked.filter("action = 'add'").select("conv_id", new_id.alias("id"), title.alias("header"), "kind", "code", F.col("now").alias("updated_at"), (F.coalesce("last", F.lit(-1)) + 1).cast("bigint").alias("ord"))
    error = (
        F.when(~action.isin(*DIAGRAM_ACTIONS), F.concat(F.lit("no such change to diagrams: "), action))
        .when(action.isin("replace", "append", "patch") & F.col("t").isNull(), "which diagram is meant isn't known")
        .when((action == "patch") & (F.size("edits") == 0), "a patch needs edits")
        .when(F.col("absent").isNotNull(), F.concat(F.lit("not in the diagram, so nothing was changed: "), "absent"))
    )
    none = F.array().cast("array<struct<find:string,replacements:int>>")
    outcome = asked.join(told, "conv_id", "left").select("conv_id", "action", F.when(action == "add", new_id).otherwise(F.coalesce("t", "diagram_id")).alias("diagram_id"), F.aggregate(F.coalesce("applied", none), F.lit(0), lambda n, x: n + x["replacements"]).alias("replaced"), F.coalesce("applied", none).alias("applied"), error.alias("error"))
    return stay.unionByName(added), outcome


def truncate_json(value: Column, most: int = 900) -> Column:
    """A value as JSON text, cut and marked by an ellipsis beyond `most` characters."""
    text = F.to_json(value)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def strip_reasoning(messages: DataFrame, dropped: tuple[str, ...] = ("reasoning", "reasoning_content")) -> DataFrame:
    """Messages without the columns of a model's private notes."""
    return messages.drop(*dropped)

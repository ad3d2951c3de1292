"""Registered queries over the bundled tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cycles, diff, flows, links, reach, store, tools, tree, views
from ..streaming import progress
from . import adapter
from .adapter import NEW, OLD, graph, linked, relations_sql, supply_graph, supply_sql, table
from .fixpoint import cut, reachable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GRAPH = "WITH RECURSIVE " + relations_sql()
SUPPLY = "WITH RECURSIVE " + supply_sql()
TWO = "WITH RECURSIVE " + relations_sql(OLD, "_old") + ", " + relations_sql(NEW, "_new")
#: What questions about links read more than once.
ENDS = "entry_points producers"
SENTINEL_LIST = "('', 'unknown', 'unknown-event')"
CONSUMER_LIST = "(" + ", ".join(f"'{t}'" for t in S.MESSAGE_CONSUMERS) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def path_text(column: str = "path") -> F.Column:
    return F.array_join(F.transform(column, lambda x: F.lpad(x.cast("string"), 4, "0")), ".")


# ---------------------------------------------------------------- links


@query(GRAPH + " SELECT channel, kind, verb, side, id, repo FROM members WHERE kind = 'message'")
def link_message(spark, d):
    g = graph(spark, d, keep=ENDS)
    return links.link_message(g.entry_points, g.producers).drop("ord")


@query(GRAPH + " SELECT channel, kind, verb, side, id, repo FROM members WHERE kind = 'grpc'")
def link_grpc(spark, d):
    g = graph(spark, d, keep=ENDS)
    return links.link_grpc(g.entry_points, g.producers).drop("ord")


_PATH_SQL = r"""'/' || array_to_string(list_transform(list_filter(string_split({0}, '/'), lambda s: s <> ''), lambda s:
    CASE WHEN contains(s, '{{') OR contains(s, '}}') OR regexp_full_match(s, '[0-9]+') OR (length(s) = 36 AND contains(s, '-')) THEN '{{p}}' ELSE s END), '/')"""
_PLAIN_URL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')"
_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


def _page_graph(spark, d):
    """Pages as a call graph: even pages call, odd ones serve; hosts are repositories."""
    pages = table(spark, d, "pages").filter("url is not null")
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://[^/]*", "")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    number = F.lpad(F.col("page_id").cast("string"), 12, "0")
    rows = pages.select(number.alias("ord"), number.alias("id"), host.alias("repo"), path.alias("channel"), F.lit("").alias("message_type"), "page_id")
    return rows.filter("page_id % 2 = 1").withColumn("type", F.lit("rest-endpoint")), rows.filter("page_id % 2 = 0").withColumn("type", F.lit("http-call"))


@query(
    f"""WITH p AS (SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, {_HOST} AS repo, {_PLAIN_URL} AS raw, page_id FROM pages WHERE url IS NOT NULL),
    n AS (SELECT *, {_PATH_SQL.format("raw")} AS norm FROM p WHERE raw <> ''),
    met AS (SELECT a.norm, a.raw, a.id AS p_id, b.id AS e_id FROM n a JOIN n b ON a.norm = b.norm AND a.repo <> b.repo WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1)
    SELECT norm, arg_min(raw, p_id) AS channel, count(DISTINCT p_id) AS n_callers, count(DISTINCT e_id) AS n_endpoints FROM met GROUP BY norm"""
)
def link_http(spark, d):
    members = links.link_http(*_page_graph(spark, d))
    n = lambda side: F.countDistinct(F.when(F.col("side") == side, F.col("id")))
    return members.groupBy("norm", "channel").agg(n("producer").alias("n_callers"), n("consumer").alias("n_endpoints"))


@query(GRAPH + " SELECT DISTINCT repo FROM members")
def repos_involved(spark, d):
    g = graph(spark, d, keep=ENDS)
    return links.repos_involved(g.members, g.entry_points, g.producers)


# ---------------------------------------------------------------- tools


@query(
    GRAPH
    + f"""SELECT 'producer' AS side, id, repo, type, channel, method, file, line FROM producers p
    WHERE type <> 'http-call' AND trim(channel) NOT IN {SENTINEL_LIST} AND NOT EXISTS (SELECT 1 FROM entry_points e WHERE e.channel = p.channel AND e.type IN {CONSUMER_LIST})
    UNION ALL SELECT 'consumer', id, repo, type, channel, method, file, line FROM entry_points e
    WHERE type IN {CONSUMER_LIST} AND trim(channel) NOT IN {SENTINEL_LIST} AND NOT EXISTS (SELECT 1 FROM producers p WHERE p.channel = e.channel AND p.type <> 'http-call')"""
)
def find_orphans(spark, d):
    return tools.find_orphans(graph(spark, d, keep=ENDS))


@query(ORACLES["find_orphans"].replace("SELECT 'producer' AS side", "SELECT DISTINCT channel FROM (SELECT 'producer' AS side", 1) + ")")
def orphan_channels(spark, d):
    return tools.orphan_channels(graph(spark, d, keep=ENDS))


@query(ORACLES["orphan_channels"].replace("SELECT DISTINCT channel FROM", "SELECT repo, side, count(DISTINCT channel) AS channels FROM") + " GROUP BY repo, side")
def orphans_by_repo(spark, d):
    return views.orphans_by_repo(graph(spark, d, keep=ENDS))


@query(ORACLES["orphan_channels"].replace("SELECT DISTINCT channel FROM", "SELECT count(DISTINCT repo) AS gap_count FROM"))
def gap_count(spark, d):
    return views.gap_count(graph(spark, d, keep=ENDS))


@query(GRAPH + "SELECT id, repo, type, channel, method, class_name, file, line FROM entry_points WHERE contains(lower(concat_ws(' ', method, class_name, channel, id, message_type)), 'part-12')")
def search_entries(spark, d):
    return tools.search_entries(graph(spark, d), "PART-12")


@query(GRAPH + "SELECT id, repo, type, channel, method, file, line FROM producers WHERE contains(lower(concat_ws(' ', method, channel, type, id)), 'kafka')")
def search_producers(spark, d):
    return tools.search_producers(graph(spark, d), "Kafka")


@query(GRAPH + "SELECT DISTINCT file FROM (SELECT file FROM entry_points UNION ALL SELECT file FROM nodes UNION ALL SELECT file FROM producers) WHERE file <> '' AND contains(lower(file), 's1')")
def search_files(spark, d):
    return tools.search_files(graph(spark, d), "S1")


@query(
    f"""{GRAPH} SELECT 'entry_points' AS kind, id AS hit FROM entry_points WHERE contains(lower(concat_ws(' ', method, class_name, channel, id, message_type)), 'c12')
    UNION ALL SELECT 'producers', id FROM producers WHERE contains(lower(concat_ws(' ', method, channel, type, id)), 'c12')
    UNION ALL SELECT 'files', file FROM (SELECT DISTINCT file FROM (SELECT file FROM entry_points UNION ALL SELECT file FROM nodes UNION ALL SELECT file FROM producers)) WHERE contains(lower(file), 'c12')"""
)
def search_code(spark, d):
    return tools.search_code(graph(spark, d), "C12")


@query(GRAPH + "SELECT CAST(rank AS INTEGER) AS rank, method, file, line, 'EXTRACTED' AS confidence, depth FROM (SELECT *, row_number() OVER (ORDER BY path) AS rank FROM nodes WHERE ep_id = (SELECT min(id) FROM entry_points))")
def get_node(spark, d):
    g = graph(spark, d)
    first = g.entry_points.agg(F.min("id")).first()[0] or ""
    return tools.get_node(g, first)


@query(
    GRAPH
    + f"""SELECT 'producer' AS side, id, repo, method, type, file, line FROM producers WHERE contains(lower(channel), 'part-1')
    UNION ALL SELECT 'consumer', id, repo, method, type, file, line FROM entry_points WHERE contains(lower(channel), 'part-1') AND type IN {CONSUMER_LIST}"""
)
def get_channel_flow(spark, d):
    return tools.get_channel_flow(graph(spark, d), "PART-1")


@query(
    ORACLES["get_channel_flow"].replace("SELECT 'producer' AS side", "SELECT 'PART-1' AS channel, coalesce(string_agg(DISTINCT repo, ',' ORDER BY repo) FILTER (WHERE side = 'producer'), '') AS producer_repos, coalesce(string_agg(DISTINCT repo, ',' ORDER BY repo) FILTER (WHERE side = 'consumer'), '') AS consumer_repos, count(DISTINCT repo) > 1 AS is_cross_repo, count(*) FILTER (WHERE side = 'producer') AS n_producers, count(*) FILTER (WHERE side = 'consumer') AS n_consumers FROM (SELECT 'producer' AS side", 1)
    + ")"
)
def channel_flow_summary(spark, d):
    return tools.channel_flow_summary(graph(spark, d), "PART-1")


_FIRST_KIND = "first_kind AS (SELECT channel, arg_min(kind, k) AS kind FROM (SELECT channel, kind, CASE kind WHEN 'message' THEN 0 WHEN 'http' THEN 1 ELSE 2 END AS k FROM members) GROUP BY channel)"


@query(
    GRAPH
    + f""", {_FIRST_KIND} SELECT channel, kind, verb, coalesce(string_agg(DISTINCT repo, ',' ORDER BY repo) FILTER (WHERE side = 'producer'), '') AS producer_repos,
    coalesce(string_agg(DISTINCT repo, ',' ORDER BY repo) FILTER (WHERE side = 'consumer'), '') AS consumer_repos, count(*) FILTER (WHERE side = 'producer') AS producer_count,
    count(*) FILTER (WHERE side = 'consumer') AS consumer_count, count(DISTINCT repo) > 1 AS is_cross_repo
    FROM members JOIN first_kind USING (channel, kind) GROUP BY channel, kind, verb"""
)
def list_channels(spark, d):
    return tools.list_channels(graph(spark, d, keep=ENDS).members)


@query(GRAPH + "SELECT id, repo, type, channel, method, file, line FROM entry_points WHERE coalesce(thin, total_nodes <= 1)")
def thin_handlers(spark, d):
    return tools.thin_handlers(graph(spark, d))


@query(GRAPH + "SELECT repo FROM (SELECT 'R' || r_regionkey AS repo FROM region UNION ALL SELECT 'X-none') WHERE repo NOT IN (SELECT repo FROM members)")
def isolated_repos(spark, d):
    return tools.isolated_repos(graph(spark, d, keep=ENDS))


@query(
    GRAPH
    + """SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS unreachable_methods, (SELECT count(*) FROM entry_points WHERE coalesce(thin, total_nodes <= 1)) AS thin_handlers,
    (SELECT count(*) FROM (SELECT 'R' || r_regionkey AS repo FROM region UNION ALL SELECT 'X-none') WHERE repo NOT IN (SELECT repo FROM members)) AS isolated_repos, (SELECT count(*) FROM customer) AS methods_total, true AS method_index_available"""
)
def find_dead_code(spark, d):
    g = graph(spark, d, keep=ENDS).with_(methods_total=table(spark, d, "customer").count())
    return tools.dead_code_summary(g)


@query(GRAPH + "SELECT type, count(*) AS n FROM entry_points GROUP BY type")
def overview_types(spark, d):
    return tools.overview_types(graph(spark, d))


@query(
    GRAPH
    + "SELECT coalesce(e.repo, p.repo) AS repo, coalesce(e, 0) AS entry_points, coalesce(p, 0) AS producers FROM (SELECT repo, count(*) AS e FROM entry_points GROUP BY repo) e FULL JOIN (SELECT repo, count(*) AS p FROM producers GROUP BY repo) p ON e.repo = p.repo"
)
def overview_repos(spark, d):
    return tools.overview_repos(graph(spark, d))


@query(
    GRAPH
    + """SELECT (SELECT count(*) FROM entry_points) AS total_entry_points, (SELECT max(depth) FROM entry_points) AS max_depth, CAST((SELECT sum(total_nodes) FROM entry_points) AS BIGINT) AS total_call_nodes,
    (SELECT count(*) FROM producers) AS total_producers, (SELECT count(*) + 1 FROM region) AS total_repos, (SELECT count(*) FROM (SELECT DISTINCT channel, kind, verb FROM members)) AS total_channels"""
)
def overview_totals(spark, d):
    return tools.overview_totals(graph(spark, d, keep=ENDS))


@query(GRAPH + "SELECT channel, kind, verb, count(*) FILTER (WHERE side = 'producer') AS producers, count(*) FILTER (WHERE side = 'consumer') AS consumers FROM members GROUP BY channel, kind, verb")
def overview_channels(spark, d):
    return tools.overview_channels(graph(spark, d, keep=ENDS))


# ---------------------------------------------------------------- cycles and edges


_EDGES = """, edges AS (SELECT DISTINCT a.repo AS src, b.repo AS dst, a.channel, a.kind, a.verb FROM members a JOIN members b ON a.channel = b.channel AND a.kind = b.kind WHERE a.side = 'producer' AND b.side = 'consumer' AND a.repo <> b.repo)"""
_CYCLES = (
    _EDGES
    + """, pairs AS (SELECT DISTINCT src, dst FROM edges), walk AS (
    SELECT src AS start, dst AS cur, [src, dst] AS path FROM pairs WHERE dst > src
    UNION ALL SELECT w.start, p.dst, list_append(w.path, p.dst) FROM walk w JOIN pairs p ON p.src = w.cur
    WHERE w.cur <> w.start AND (p.dst = w.start OR p.dst > w.start AND NOT list_contains(w.path, p.dst))
), found AS (SELECT path, len(path) - 1 AS length, unnest(range(1, len(path))) AS k FROM walk WHERE cur = start)"""
)


@query(GRAPH + _CYCLES + " SELECT array_to_string(path, '>') AS repos, CAST(length AS INTEGER) AS length, md5(string_agg(DISTINCT channel, ',' ORDER BY channel)) AS channels, CAST(count(DISTINCT channel) AS INTEGER) AS n_channels FROM found JOIN edges ON src = path[k] AND dst = path[k + 1] GROUP BY path, length")
def find_cycles(spark, d):
    found = cycles.find_cycles(linked(spark, d).members)
    return found.select("repos", "length", F.md5(F.array_join("channels", ",")).alias("channels"), F.size("channels").alias("n_channels"))


@query(GRAPH + _CYCLES + " SELECT (SELECT count(*) FROM walk WHERE cur = start) AS cycle_count, coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT unnest(path) AS r FROM walk WHERE cur = start)), '') AS repos_in_cycles")
def cycle_summary(spark, d):
    return cycles.cycle_summary(linked(spark, d).members)


@query(GRAPH + f", {_FIRST_KIND}" + _EDGES + " SELECT src, dst, channel, kind, verb FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = e.src AND x.dst = e.dst AND x.channel = e.channel AND x.kind < e.kind AND x.kind = 'http' AND e.kind = 'message' AND false) QUALIFY row_number() OVER (PARTITION BY src, dst, channel ORDER BY CASE kind WHEN 'message' THEN 0 WHEN 'http' THEN 1 ELSE 2 END) = 1")
def repo_edges(spark, d):
    return views.edge_items(linked(spark, d).members)


@query(
    GRAPH
    + _EDGES
    + """, one AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY src, dst, channel ORDER BY CASE kind WHEN 'message' THEN 0 WHEN 'http' THEN 1 ELSE 2 END) = 1),
    n AS (SELECT src, dst, count(*) AS n_items, count(*) FILTER (WHERE kind = 'message') AS m, count(*) FILTER (WHERE kind = 'http') AS h, count(*) FILTER (WHERE kind = 'grpc') AS g, min(channel) AS c, min(kind) AS k, min(verb) AS v FROM one GROUP BY src, dst)
    SELECT src, dst, n_items, CASE WHEN n_items = 1 THEN CASE WHEN k = 'grpc' THEN 'gRPC ' || c WHEN k = 'http' AND v <> '' THEN v || ' ' || c ELSE c END
    ELSE concat_ws(' · ', CASE WHEN m > 1 THEN m || ' msgs' WHEN m = 1 THEN '1 msg' END, CASE WHEN h > 0 THEN h || ' HTTP' END, CASE WHEN g > 0 THEN g || ' gRPC' END) END AS label FROM n"""
)
def edge_label(spark, d):
    return views.edge_labels(linked(spark, d).members)


@query(
    GRAPH
    + """, heard AS (SELECT repo, 'msg' AS kind, channel, 'in' AS side, method || '|' || message_type AS m FROM entry_points WHERE type IN ('kafka-consumer', 'event-listener', 'websocket')),
    made AS (SELECT repo, CASE WHEN type IN ('http-call', 'grpc-call') THEN 'http' ELSE 'msg' END AS kind, channel, 'out' AS side, method || '|' || CASE WHEN type IN ('http-call', 'grpc-call') THEN response_type ELSE message_type END AS m FROM producers),
    cards AS (SELECT repo, kind, channel, count(DISTINCT m) FILTER (WHERE side = 'in') AS n_in, count(DISTINCT m) FILTER (WHERE side = 'out') AS n_out FROM (SELECT * FROM heard UNION ALL SELECT * FROM made) GROUP BY repo, kind, channel),
    peers AS (SELECT c.repo, c.channel, string_agg(DISTINCT m.repo, ',' ORDER BY m.repo) FILTER (WHERE side = 'producer') AS up, string_agg(DISTINCT m.repo, ',' ORDER BY m.repo) FILTER (WHERE side = 'consumer') AS down
        FROM (SELECT DISTINCT repo, channel FROM cards) c JOIN members m ON m.channel = c.channel AND m.repo <> c.repo GROUP BY c.repo, c.channel)
    SELECT repo, kind, channel, CASE WHEN n_in > 0 AND n_out > 0 THEN 'both' WHEN n_in = 0 THEN 'out' ELSE 'in' END AS direction, n_in, n_out,
        CASE WHEN n_in > 0 THEN coalesce(up, '') ELSE '' END AS in_peers, CASE WHEN n_out > 0 THEN coalesce(down, '') ELSE '' END AS out_peers,
        CASE WHEN kind = 'http' THEN '1' ELSE '0' END || CASE WHEN n_in > 0 AND n_out > 0 THEN '1' WHEN n_in = 0 THEN '2' ELSE '0' END || ' ' || channel AS rank
    FROM cards LEFT JOIN peers USING (repo, channel)"""
)
def repo_channel_cards(spark, d):
    return views.channel_cards(graph(spark, d, keep=ENDS))


@query(GRAPH + "SELECT repo, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM entry_points GROUP BY repo")
def types_by_repo(spark, d):
    return views.types_by_repo(graph(spark, d).entry_points)


# ---------------------------------------------------------------- call trees


_CALLS_SQL = """
WITH roots AS (SELECT DISTINCT 'O' || o_orderkey AS ep_id FROM orders),
o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_partkey),
e1 AS (SELECT 'O' || l_orderkey AS caller, 'P' || l_partkey AS callee, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) AS pos FROM o),
e2 AS (SELECT 'P' || l_partkey AS caller, 'S' || l_suppkey AS callee, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS pos FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
edges AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 1 FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'G' || n_regionkey, 1 FROM nation),
n0 AS (SELECT ep_id, ep_id AS node, '' AS path FROM roots),
n1 AS (SELECT ep_id, callee AS node, min(path || lpad(CAST(pos AS VARCHAR), 4, '0')) AS path FROM n0 JOIN edges ON caller = node GROUP BY ep_id, callee),
n2 AS (SELECT ep_id, callee AS node, min(path || '.' || lpad(CAST(pos AS VARCHAR), 4, '0')) AS path FROM n1 JOIN edges ON caller = node GROUP BY ep_id, callee),
n3 AS (SELECT ep_id, callee AS node, min(path || '.' || lpad(CAST(pos AS VARCHAR), 4, '0')) AS path FROM n2 JOIN edges ON caller = node GROUP BY ep_id, callee),
n4 AS (SELECT ep_id, callee AS node, min(path || '.' || lpad(CAST(pos AS VARCHAR), 4, '0')) AS path FROM n3 JOIN edges ON caller = node GROUP BY ep_id, callee),
every AS (SELECT *, 0 AS depth FROM n0 UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2 UNION ALL SELECT *, 3 FROM n3 UNION ALL SELECT *, 4 FROM n4),
tree AS (SELECT *, row_number() OVER (PARTITION BY ep_id ORDER BY path) AS rank FROM every QUALIFY rank <= 50)"""


def _call_layers(spark, d):
    """Edges of each level: orders to parts, parts to suppliers, these to nations, those to regions."""
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("order"), F.concat(F.lit("P"), "l_partkey").alias("part"), F.concat(F.lit("S"), "l_suppkey").alias("supplier"), "l_partkey", "l_suppkey", "l_linenumber")
    at = lambda caller, *order: F.row_number().over(Window.partitionBy(caller).orderBy(*order)).alias("pos")
    # edges are dealt by their caller once, for all that is asked of them
    per_order = lines.select("order", "part", "l_partkey", "l_linenumber").repartition("order").groupBy("order", "part", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    e1 = per_order.select(F.col("order").alias("caller"), F.col("part").alias("callee"), at("order", "n", "l_partkey"))
    pairs = lines.select("part", "supplier", "l_suppkey").repartition("part").distinct()
    e2 = pairs.select(F.col("part").alias("caller"), F.col("supplier").alias("callee"), at("part", "l_suppkey"))
    e3 = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("caller"), F.concat(F.lit("N"), "s_nationkey").alias("callee"), F.lit(1).alias("pos"))
    e4 = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("caller"), F.concat(F.lit("G"), "n_regionkey").alias("callee"), F.lit(1).alias("pos"))
    return [e1, e2, e3, e4]


def _call_edges(spark, d):
    return reduce(DataFrame.unionByName, _call_layers(spark, d))


def _order_roots(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("ep_id")).distinct().withColumn("node", F.col("ep_id"))


@query(_CALLS_SQL + " SELECT ep_id, node, path, depth, CAST(rank AS INTEGER) AS rank FROM tree")
def call_tree(spark, d):
    return tree.layered_tree(_order_roots(spark, d), _call_layers(spark, d)).withColumn("path", path_text())


@query(_CALLS_SQL + " SELECT ep_id, node, depth, CAST(rank AS INTEGER) AS rank FROM tree")
def call_tree_general(spark, d):
    """The same trees by the depth-first form for any call graph: equal nodes at equal places in pre-order."""
    entries = _order_roots(spark, d).select("ep_id", F.col("node").alias("key"), F.col("node").alias("method"), F.lit("").alias("class_name"), F.lit("").alias("file"), F.lit(0).alias("line"))
    calls = _call_edges(spark, d).select("caller", F.col("pos").cast("bigint").alias("ord"), F.concat("callee", F.lit("#")).alias("display"), F.lit(1).alias("arity"), "callee", F.lit("").alias("callee_class"), F.lit("").alias("callee_file"), F.lit(0).alias("callee_line"), F.lit(False).alias("ambiguous"))
    return tree.ranked_call_tree(entries, calls).select("ep_id", F.regexp_replace("method", "#$", "").alias("node"), "depth", "rank")


@query(
    GRAPH
    + """SELECT n.ep_id, max(depth) AS depth, count(*) AS total_nodes, count(DISTINCT file) AS unique_files,
    coalesce(any_value(b.branch_count), 0) AS branch_count FROM nodes n LEFT JOIN (SELECT ep_id, count(*) AS branch_count FROM (SELECT ep_id, up FROM nodes WHERE depth > 0 GROUP BY ep_id, up HAVING count(*) > 1) GROUP BY ep_id) b ON b.ep_id = n.ep_id GROUP BY n.ep_id"""
)
def tree_metrics(spark, d):
    return tree.tree_metrics(adapter.tree_nodes(spark, d))


_NAMED = ", named AS (SELECT *, CASE WHEN class_name <> '' AND method <> '' AND NOT contains(method, '.') THEN class_name || '.' || method WHEN method <> '' THEN method ELSE class_name END AS name FROM nodes)"


@query(
    GRAPH
    + _NAMED
    + """, first AS (SELECT ep_id, method, file, line, min(path) AS path FROM nodes GROUP BY ep_id, method, file, line),
    hit AS (SELECT n.ep_id, n.method, n.path AS own, f.path FROM nodes n JOIN first f USING (ep_id, method, file, line) WHERE contains(lower(n.method), 'place1'))
    SELECT h.ep_id, h.method AS called_method, string_agg(a.name, ' > ' ORDER BY a.path) AS call_path
    FROM hit h JOIN named a ON a.ep_id = h.ep_id AND (h.path = a.path OR a.path = '' OR starts_with(h.path, a.path || '.')) GROUP BY h.ep_id, h.method, h.own"""
)
def find_callers(spark, d):
    return tree.find_callers(adapter.tree_nodes(spark, d), "PLACE1")


@query(
    GRAPH
    + """SELECT s.ep_id, s.method || ' > ' || CASE WHEN t.depth = 2 AND s.depth = 0 THEN (SELECT any_value(m.method) FROM nodes m WHERE m.ep_id = t.ep_id AND m.path = t.up) || ' > ' ELSE '' END || t.method AS chain, s.path AS from_path, t.path AS to_path
    FROM nodes s JOIN nodes t ON t.ep_id = s.ep_id AND (s.path = '' AND t.path <> '' OR starts_with(t.path, s.path || '.'))
    WHERE contains(lower(s.method), '.on') AND contains(lower(t.method), 'ship')"""
)
def trace_path(spark, d):
    found = tree.trace_path(adapter.tree_nodes(spark, d), ".on", "SHIP")
    return found.select("ep_id", "chain", path_text("from_path").alias("from_path"), path_text("to_path").alias("to_path"))


@query(
    GRAPH
    + """, c AS (SELECT ep_id, up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ep_id, up)
    SELECT n.ep_id, n.path, n.method, p.method AS parent, coalesce(k.n, 0) AS n_calls, CASE WHEN n.depth > 0 THEN s.n - 1 ELSE 0 END AS n_siblings
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.ep_id = n.ep_id AND p.path = n.up LEFT JOIN c k ON k.ep_id = n.ep_id AND k.up = n.path LEFT JOIN c s ON s.ep_id = n.ep_id AND s.up = n.up"""
)
def node_relations(spark, d):
    return tree.node_relations(adapter.tree_nodes(spark, d)).withColumn("path", path_text())


# ---------------------------------------------------------------- reachability


_REACH_SQL = """
WITH RECURSIVE edges AS (
    SELECT DISTINCT 'O' || o_orderkey AS src, 'C' || o_custkey AS dst FROM orders
    UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem
    UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
    UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
), roots AS (SELECT DISTINCT 'O' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'O'),
reached AS (SELECT node FROM roots UNION SELECT dst FROM reached JOIN edges ON src = node)"""


def _reach_edges(spark, d):
    """Orders call their customer and parts, parts their suppliers, those and customers their nation, nations their suppliers and region."""
    orders, lines, suppliers = (table(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    key = lambda letter, column: F.concat(F.lit(letter), column)
    edge = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    nation = key("N", "s_nationkey"), key("S", "s_suppkey")
    parts = [
        edge(orders, key("O", "o_orderkey"), key("C", "o_custkey")), edge(lines, key("O", "l_orderkey"), key("P", "l_partkey")).distinct(), edge(lines, key("P", "l_partkey"), key("S", "l_suppkey")).distinct(),
        edge(suppliers, nation[1], nation[0]), edge(suppliers, *nation), edge(table(spark, d, "customer"), key("C", "c_custkey"), key("N", "c_nationkey")), edge(table(spark, d, "nation"), key("N", "n_nationkey"), key("R", "n_regionkey")),
    ]
    return reduce(DataFrame.union, parts)


def _reached(spark, d):
    """What open orders reach."""
    roots = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("O"), "o_orderkey").alias("node"))
    return reachable(roots, _reach_edges(spark, d))


@query(_REACH_SQL + " SELECT node FROM reached")
def reachable_methods(spark, d):
    return _reached(spark, d).select("node")


@query(
    _REACH_SQL
    + """ SELECT key, name FROM (SELECT 'C' || c_custkey AS key, c_name AS name, c_acctbal > 0 AS has_body FROM customer UNION ALL SELECT 'P' || p_partkey, p_name, p_size > 10 FROM part)
    WHERE has_body AND NOT regexp_matches(name, '^(get|set).+|^is.+') AND key NOT IN (SELECT node FROM reached)"""
)
def unreachable_methods(spark, d):
    method = lambda t, key, name, body: table(spark, d, t).select(key.alias("key"), F.col(name).alias("name"), body.alias("has_body"))
    customers = method("customer", F.concat(F.lit("C"), "c_custkey"), "c_name", F.col("c_acctbal") > 0)
    parts = method("part", F.concat(F.lit("P"), "p_partkey"), "p_name", F.col("p_size") > 10)
    return reach.unreachable_methods(customers.union(parts), _reached(spark, d)).select("key", "name")


@query("SELECT count(*) AS methods_total FROM part WHERE p_size > 10")
def methods_total(spark, d):
    return reach.methods_total(table(spark, d, "part").select((F.col("p_size") > 10).alias("has_body")))


@query("SELECT o_orderkey AS ep_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag <> 'N' OR l_linenumber > 1)) AS thin FROM orders")
def thin_entry(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("caller"), F.when(F.col("l_returnflag") == "N", "order.getState").otherwise("order.refund").alias("display"), (F.col("l_linenumber") - 1).alias("arity"))
    return reach.thin_entries(table(spark, d, "orders").select(F.col("o_orderkey").alias("ep_id"), F.col("o_orderkey").alias("key")), calls)


# ---------------------------------------------------------------- flows


_FLOWS = (
    """, reached AS (SELECT ep_id, method AS name FROM nodes UNION SELECT ep_id, class_name || '.' || string_split(method, '.')[-1] FROM nodes UNION SELECT id, class_name || '.' || method FROM entry_points),
sent AS (SELECT DISTINCT e.id, e.repo, m.channel, m.kind <> 'message' AS sync FROM reached r JOIN entry_points e ON e.id = r.ep_id JOIN members m ON m.side = 'producer' AND m.repo = e.repo AND string_split(m.id, ':')[2] = r.name),
firsts AS (SELECT repo, channel, arg_min(m.verb, k || m.id) AS verb, arg_min(m.id, k || m.id) AS producer FROM (SELECT *, CASE kind WHEN 'http' THEN '1' ELSE '2' END AS k FROM members WHERE side = 'producer' AND kind <> 'message') m GROUP BY repo, channel),
publishes AS (SELECT s.id, s.repo, s.channel, s.sync, CASE WHEN s.sync THEN coalesce(f.verb, '') ELSE '' END AS verb, CASE WHEN s.sync THEN coalesce(p.response_type, '') ELSE '' END AS response_type
    FROM sent s LEFT JOIN firsts f ON f.repo = s.repo AND f.channel = s.channel LEFT JOIN producers p ON p.id = f.producer),
hops AS (SELECT DISTINCT p.id AS src, e.id AS dst, e.repo AS dst_repo, p.channel, CASE WHEN p.sync THEN 'http' ELSE 'message' END AS kind, p.verb, p.response_type
    FROM publishes p JOIN entry_points e ON e.channel = p.channel AND (e.type IN ('rest-endpoint', 'grpc-service')) = p.sync AND e.repo <> p.repo),
origins AS (SELECT * FROM entry_points WHERE type = 'rest-endpoint' OR channel NOT IN (SELECT channel FROM members)),
steps AS (
    SELECT 'flow:' || id AS flow_id, [id] AS path, 0 AS depth, id AS entry_id, repo, '' AS via_channel, '' AS kind, '' AS verb, '' AS response_type FROM origins
    UNION ALL SELECT s.flow_id, list_append(s.path, h.dst), s.depth + 1, h.dst, h.dst_repo, h.channel, h.kind, h.verb, h.response_type
    FROM steps s JOIN hops h ON h.src = s.entry_id WHERE NOT list_contains(s.path, h.dst))"""
)


@query(SUPPLY + _FLOWS + " SELECT id, repo, channel, sync, verb, response_type FROM publishes")
def publishes(spark, d):
    return views.publishes(supply_graph(spark, d))


def _steps(spark, d):
    g = supply_graph(spark, d)
    hops = views.flow_hops(views.publishes(g), g.entry_points)
    return views.detect_flows(views.flow_origins(g.entry_points, g.members), hops)


@query(SUPPLY + _FLOWS + " SELECT flow_id, array_to_string(path, ' > ') AS path, depth, entry_id, repo, via_channel, kind, verb, response_type FROM steps")
def detect_flows(spark, d):
    return _steps(spark, d).withColumn("path", F.array_join("path", " > "))


@query(SUPPLY + _FLOWS + " SELECT flow_id, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, count(DISTINCT repo) AS repo_count, max(depth) AS hop_count, count(DISTINCT repo) > 1 AS has_cross_repo, bool_or(kind IN ('http', 'grpc')) AS has_sync FROM steps GROUP BY flow_id")
def flow_metrics(spark, d):
    return views.flow_metrics(_steps(spark, d))


_ORIGIN_CASE = lambda part: "CASE type " + " ".join(f"WHEN '{k}' THEN '{v[part]}'" for k, v in views.ORIGINS.items())


@query(
    SUPPLY
    + _FLOWS
    + f""" SELECT 'flow:' || id AS flow_id, id, repo, CASE WHEN type = 'rest-endpoint' THEN 'rest' ELSE 'external' END AS origin_type, CASE WHEN type = 'rest-endpoint' THEN 'REST' ELSE {_ORIGIN_CASE(0)} ELSE 'EXTERNAL' END END AS tag,
    CASE WHEN type = 'rest-endpoint' THEN 'REST endpoint' ELSE {_ORIGIN_CASE(1)} ELSE 'external event' END END AS noun, CASE WHEN type = 'rest-endpoint' THEN 'On' ELSE channel END AS name,
    CASE WHEN type = 'rest-endpoint' THEN CASE WHEN method_type <> '' THEN method_type ELSE 'POST' END || ' ' || channel ELSE channel END AS label, channel FROM origins"""
)
def flow_origin(spark, d):
    g = supply_graph(spark, d)
    return views.flow_origins(g.entry_points, g.members)


@query(ORACLES["flow_origin"].replace("SELECT 'flow:' || id AS flow_id, id,", "SELECT flow_id FROM (SELECT 'flow:' || id AS flow_id, id,") + ") o JOIN (SELECT flow_id, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM steps GROUP BY flow_id) m USING (flow_id) WHERE tag <> 'KAFKA' AND (contains(lower(name), 'r1') OR contains(lower(label), 'r1') OR contains(lower(tag), 'r1') OR contains(lower(channel), 'r1') OR len(list_filter(string_split(repos, ','), lambda x: contains(lower(x), 'r1'))) > 0)")
def flow_search(spark, d):
    g = supply_graph(spark, d)
    return views.flow_search(views.flow_origins(g.entry_points, g.members), views.flow_metrics(_steps(spark, d)), "R1", hidden=("KAFKA",)).select("flow_id")


@query(SUPPLY + _FLOWS + " SELECT flow_id, repo, min(depth) AS depth, count(*) AS n_steps FROM steps GROUP BY flow_id, repo")
def flow_repo_nodes(spark, d):
    return views.flow_repo_nodes(_steps(spark, d))


_FLOW_EDGES = """, met AS (SELECT c.flow_id, p.repo AS src, c.repo AS dst, c.via_channel AS channel, c.kind, c.response_type FROM steps c JOIN steps p ON p.flow_id = c.flow_id AND p.path = c.path[:len(c.path) - 1] WHERE c.depth > 0)"""


def _taken(spark, d):
    g = supply_graph(spark, d)
    hops = cut(views.flow_hops(views.publishes(g), g.entry_points))
    return flows.hops_taken(flows.flow_entries(views.flow_origins(g.entry_points, g.members), hops), hops)


@query(SUPPLY + _FLOWS + _FLOW_EDGES + " SELECT DISTINCT flow_id, src, dst, channel, kind FROM met UNION SELECT flow_id, dst, src, channel, 'http-response' FROM met WHERE kind = 'http' AND response_type <> ''")
def flow_repo_edges(spark, d):
    return flows.repo_edges(_taken(spark, d))


@query(SUPPLY + _FLOWS + _FLOW_EDGES + " SELECT DISTINCT flow_id, channel, kind, dst AS target_repo FROM met WHERE src = 'R1'")
def flow_downstream(spark, d):
    return flows.downstream(_taken(spark, d), "R1")


@query(SUPPLY + _FLOWS + " SELECT c.flow_id, c.entry_id, c.depth, CASE WHEN c.kind = 'http' AND c.verb <> '' THEN c.verb || ' ' || c.via_channel ELSE c.via_channel END AS via, p.repo AS from_repo FROM steps c LEFT JOIN steps p ON c.depth > 0 AND p.flow_id = c.flow_id AND p.path = c.path[:len(c.path) - 1] WHERE c.repo = 'R1'")
def flow_trace_repo(spark, d):
    return views.flow_trace_repo(_steps(spark, d), "R1")


@query(GRAPH + """, first_kind AS (SELECT channel, arg_min(kind, CASE kind WHEN 'message' THEN 0 WHEN 'http' THEN 1 ELSE 2 END) AS kind FROM members GROUP BY channel), heard AS (SELECT channel, count(DISTINCT repo) AS n FROM members JOIN first_kind USING (channel, kind) WHERE side = 'consumer' GROUP BY channel)
    SELECT DISTINCT e.id, p.channel, coalesce(n, 0) AS n_consumer_repos FROM (SELECT 'R' || n_regionkey || ':S' || s_suppkey AS id, 'R' || n_regionkey AS repo, 'S' || s_suppkey || '.ship' AS method FROM supplier JOIN nation ON s_nationkey = n_nationkey) e
    JOIN producers p ON p.repo = e.repo AND (p.method = e.method OR ends_with(p.method, '.' || e.method)) LEFT JOIN heard h ON h.channel = p.channel""")
def outbound_channels(spark, d):
    g = graph(spark, d)
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    repo = F.concat(F.lit("R"), "n_regionkey")
    entries = suppliers.select(F.concat(repo, F.lit(":S"), "s_suppkey").alias("id"), repo.alias("repo"), F.concat(F.lit("S"), "s_suppkey", F.lit(".ship")).alias("method"))
    return views.outbound_channels(g.with_(entry_points=entries))


# ---------------------------------------------------------------- snapshots and changes


def _two(spark, d, keep=""):
    """An older and a newer snapshot of the whole order graph: each leaves out some lines by their quantity."""
    return graph(spark, d, OLD, keep), graph(spark, d, NEW, keep)


_SIGNED = lambda s: f"(SELECT e.id, any_value(e.repo) AS repo, any_value(concat_ws('|', depth, total_nodes, unique_files)) || '|' || any_value(t.tree) AS sig FROM entry_points{s} e LEFT JOIN (SELECT ep_id, md5(string_agg(DISTINCT concat_ws('|', method, file, line), ',' ORDER BY concat_ws('|', method, file, line))) AS tree FROM nodes{s} GROUP BY ep_id) t ON t.ep_id = e.id GROUP BY e.id)"
_STATUS = lambda key, a, b: f"SELECT coalesce(b.{key}, a.{key}) AS {key}, CASE WHEN a.{key} IS NULL THEN 'added' WHEN b.{key} IS NULL THEN 'removed' WHEN a.sig IS DISTINCT FROM b.sig THEN 'changed' ELSE 'same' END AS status FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key}"
_PSIG = lambda s: f"(SELECT id, concat_ws('|', repo, type, channel, method, file, line, message_type, response_type) AS sig FROM producers{s})"
_LSIG = lambda s: f"(SELECT channel, md5(string_agg(DISTINCT concat_ws('|', kind, verb, side, id), ',' ORDER BY concat_ws('|', kind, verb, side, id))) AS sig FROM members{s} GROUP BY channel)"


@query(TWO + " " + _STATUS("id", _SIGNED("_old"), _SIGNED("_new")))
def diff_entries(spark, d):
    return diff.diff_entries(*_two(spark, d))


@query(TWO + " " + _STATUS("id", _PSIG("_old"), _PSIG("_new")))
def diff_producers(spark, d):
    return diff.diff_producers(*_two(spark, d))


@query(TWO + " " + _STATUS("channel", _LSIG("_old"), _LSIG("_new")))
def diff_links(spark, d):
    return diff.diff_links(linked(spark, d, OLD), linked(spark, d, NEW))


_SUMMARY = f"""{TWO}, e AS ({_STATUS("id", _SIGNED("_old"), _SIGNED("_new"))}), p AS ({_STATUS("id", _PSIG("_old"), _PSIG("_new"))}), l AS ({_STATUS("channel", _LSIG("_old"), _LSIG("_new"))}),
counts AS (SELECT (SELECT count(*) FROM e WHERE status = 'added') AS entry_points_added, (SELECT count(*) FROM e WHERE status = 'removed') AS entry_points_removed, (SELECT count(*) FROM e WHERE status = 'changed') AS entry_points_changed,
(SELECT count(*) FROM p WHERE status = 'added') AS producers_added, (SELECT count(*) FROM p WHERE status = 'removed') AS producers_removed, (SELECT count(*) FROM p WHERE status = 'changed') AS producers_changed,
(SELECT count(*) FROM l WHERE status = 'added') AS links_added, (SELECT count(*) FROM l WHERE status = 'removed') AS links_removed)"""


@query(_SUMMARY + " SELECT * FROM counts")
def diff_summary(spark, d):
    return diff.diff_summary(adapter.changing(spark, d, OLD), adapter.changing(spark, d, NEW))


@query(
    _SUMMARY
    + """ SELECT concat_ws(' · ', CASE WHEN entry_points_added > 0 THEN '+' || entry_points_added || ' entry point' || CASE WHEN entry_points_added > 1 THEN 's' ELSE '' END END,
    CASE WHEN entry_points_changed > 0 THEN '~' || entry_points_changed || ' changed' END, CASE WHEN entry_points_removed > 0 THEN '−' || entry_points_removed || ' removed' END,
    CASE WHEN links_added > 0 THEN '+' || links_added || ' channel' || CASE WHEN links_added > 1 THEN 's' ELSE '' END END, CASE WHEN links_removed > 0 THEN '−' || links_removed || ' channel' || CASE WHEN links_removed > 1 THEN 's' ELSE '' END END) AS text,
    greatest(entry_points_added, entry_points_removed, entry_points_changed, producers_added, producers_removed, producers_changed, links_added, links_removed) > 0 AS has_changes FROM counts"""
)
def diff_summary_text(spark, d):
    return diff.diff_summary_text(diff.diff_summary(adapter.changing(spark, d, OLD), adapter.changing(spark, d, NEW)))


@query(
    f"""{TWO}, e AS ({_STATUS("id", _SIGNED("_old"), _SIGNED("_new"))}), r AS (SELECT e.id, status, coalesce(n.repo, o.repo) AS repo FROM e LEFT JOIN (SELECT DISTINCT id, repo FROM entry_points_new) n ON n.id = e.id LEFT JOIN (SELECT DISTINCT id, repo FROM entry_points_old) o ON o.id = e.id WHERE status <> 'same')
    SELECT repo, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'changed') AS changed FROM r GROUP BY repo"""
)
def diff_status(spark, d):
    return diff.diff_repo_counts(*_two(spark, d))


@query(TWO + " SELECT n.ep_id, n.path, n.method, n.file, n.line, NOT EXISTS (SELECT 1 FROM nodes_old o WHERE o.ep_id = n.ep_id AND o.method = n.method AND o.file = n.file AND o.line = n.line) AS is_new FROM nodes_new n")
def node_diff(spark, d):
    return diff.node_diff(adapter.tree_nodes(spark, d, OLD), adapter.tree_nodes(spark, d, NEW)).withColumn("path", path_text())


@query("SELECT project_id, snapshot_ts FROM (SELECT DISTINCT o_orderpriority AS project_id, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS snapshot_ts FROM orders) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY snapshot_ts DESC) <= 10")
def snapshot_retention(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderpriority").alias("project_id"), F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias("snapshot_ts")).distinct()
    return store.retained_snapshots(days)


@query("SELECT o_orderpriority AS project_id, max(CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT)) AS snapshot_ts FROM orders GROUP BY 1")
def snapshot_latest(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderpriority").alias("project_id"), F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias("snapshot_ts"))
    return store.latest_snapshot(days)


# ---------------------------------------------------------------- scalars


@query(f"SELECT DISTINCT url, {_PATH_SQL.format('url')} AS norm FROM pages WHERE url IS NOT NULL")
def normalize_http_path(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("url", S.normalize_http_path(F.col("url")).alias("norm")).distinct()


@query("SELECT DISTINCT url, CASE WHEN regexp_matches(url, '^https?://') THEN CASE WHEN regexp_replace(url, '^https?://[^/]*', '') = '' THEN '/' ELSE regexp_replace(url, '^https?://[^/]*', '') END ELSE url END AS path FROM pages WHERE url IS NOT NULL")
def strip_http_origin(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("url", S.strip_http_origin(F.col("url")).alias("path")).distinct()


@query("SELECT DISTINCT p_brand, p_type, CASE WHEN p_type = 'unknown' THEN p_brand WHEN starts_with(p_type, '/') THEN p_brand || p_type ELSE p_brand || '/' || p_type END AS path FROM part")
def join_rest_path(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type", S.join_rest_path(F.col("p_brand"), F.col("p_type")).alias("path")).distinct()


@query("SELECT p_partkey, CASE WHEN trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '-') = '' THEN 'project' ELSE trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '-') END AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"))


@query("SELECT DISTINCT url, CASE WHEN string_split(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', ''), '/')[-1] = '' THEN 'repo' ELSE string_split(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', ''), '/')[-1] END AS repo FROM pages WHERE url IS NOT NULL")
def repo_name_from_url(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("url", S.repo_name_from_url(F.col("url")).alias("repo")).distinct()


@query("SELECT DISTINCT url, CASE WHEN starts_with(url, 'arn:') THEN string_split(url, ':')[-1] WHEN starts_with(url, 'http') THEN string_split(regexp_replace(url, '/+$', ''), '/')[-1] ELSE url END AS queue FROM pages WHERE url IS NOT NULL")
def sqs_queue_name(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("url", S.sqs_queue_name(F.col("url")).alias("queue")).distinct()



@query("SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN NULL ELSE 'azure-devops' END AS provider, CASE s_nationkey % 4 WHEN 0 THEN 'org' || s_suppkey WHEN 1 THEN 'grp/sub' || s_suppkey WHEN 2 THEN NULL ELSE 'org' || s_suppkey END AS owner, CASE WHEN s_nationkey % 4 = 3 THEN 'proj' END AS project FROM supplier")
def parse_host_link(spark, d):
    key = F.col("s_suppkey").cast("string")
    url = F.when(F.col("s_nationkey") % 4 == 0, F.concat(F.lit("https://github.com/org"), key)).when(F.col("s_nationkey") % 4 == 1, F.concat(F.lit("https://gitlab.com/grp/sub"), key, F.lit("/")))
    url = url.when(F.col("s_nationkey") % 4 == 2, F.concat(F.lit("https://github.com/org/extra"), key)).otherwise(F.concat(F.lit("https://dev.azure.com/org"), key, F.lit("/proj")))
    return table(spark, d, "supplier").select("s_suppkey", S.parse_host_link(url).alias("l")).select("s_suppkey", "l.provider", "l.owner", "l.project")


@query("SELECT DISTINCT p_brand, string_split(replace(p_brand, '#', '.'), '.')[-1] AS last FROM part")
def last_seg(spark, d):
    return table(spark, d, "part").select("p_brand", S.last_seg(F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))).alias("last")).distinct()


# ---------------------------------------------------------------- sources, conversations, boards, logs


_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_STRIPPED = lambda x: f"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(text, chr(10))[i] AS content, i = 2 AS highlighted FROM (SELECT doc_id, text, unnest(range(1, least(3, len(string_split(text, chr(10)))) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def source_lines(spark, d):
    from ..sources.files import source_lines as lines_of

    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").alias("content"))
    return lines_of(docs, 1, 3, highlight_line=2).select("doc_id", "line", "content", "highlighted")


@query(
    r"""WITH l AS (SELECT doc_id, @line@ AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '. ', ' = '), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS raw FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, CASE WHEN contains(line, '=') THEN split_part(line, '=', 1) ELSE split_part(line, ':', 1) END AS k, CASE WHEN contains(line, '=') THEN substr(line, strpos(line, '=') + 1) ELSE substr(line, strpos(line, ':') + 1) END AS v
    FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '!') AND (contains(line, '=') OR contains(line, ':')))
    SELECT DISTINCT doc_id, @k@ AS key, @v@ AS value FROM s""".replace("@line@", _STRIPPED("raw")).replace("@k@", _STRIPPED("k")).replace("@v@", _STRIPPED("v"))
)
def parse_properties(spark, d):
    from ..sources.files import parse_properties as parse

    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.replace("text", F.lit(". "), F.lit(" = ")).alias("content"))
    return parse(docs).select("doc_id", "key", "value").distinct()


@query("SELECT conv_id, count(*) AS message_count FROM conversations GROUP BY conv_id")
def list_conversations(spark, d):
    messages = table(spark, d, "conversations")
    headers = messages.select("conv_id").distinct().withColumns({"kind": F.lit(None).cast("string"), "updated_at": F.col("conv_id")})
    return store.list_conversations(headers, messages, "chat").select("conv_id", "message_count")


@query(r"""SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM (SELECT conv_id, trim(regexp_replace(coalesce(arg_min(text, turn), ''), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def auto_title(spark, d):
    return store.titles(table(spark, d, "conversations"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN substr(text, 1, 300) || chr(10) || '…[' || (length(text) - 600) || ' chars omitted]…' || chr(10) || right(text, 300) ELSE text END) AS digest FROM documents WHERE text IS NOT NULL")
def compact_diagrams(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(S.compact_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE WHEN contains(text, 'the ') AND contains(text, 'and ') THEN ((length(text) - length(replace(text, 'the ', ''))) / 4 + (length(replace(text, 'the ', 'THE ')) - length(replace(replace(text, 'the ', 'THE '), 'and ', ''))) / 4)::INTEGER ELSE 0 END AS patched, md5(CASE WHEN contains(text, 'the ') AND contains(text, 'and ') THEN replace(replace(text, 'the ', 'THE '), 'and ', '& ') ELSE text END) AS digest FROM documents WHERE text IS NOT NULL")
def patch_diagrams(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    return store.patch_text(docs, "text", [("the ", "THE "), ("and ", "& ")]).select("doc_id", "patched", F.md5("text").alias("digest"))


def _items(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("board_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderkey").alias("ord"))


@query("SELECT o_orderpriority AS board_id, CASE WHEN o_orderstatus = 'P' THEN 'no status' ELSE o_orderstatus END AS \"column\", count(*) AS n FROM orders GROUP BY 1, 2")
def board_columns(spark, d):
    return store.board_columns(_items(spark, d))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def board_items(spark, d):
    """The listing shows a board's first 50 items: the limit is the feature."""
    return store.board_items(_items(spark, d), "1-URGENT", "f").select("id")


@query(
    """SELECT id, items, columns, first FROM (SELECT o_orderpriority AS id, count(*) AS items FROM orders GROUP BY 1)
    JOIN (SELECT id, string_agg(c || ':' || n, ',' ORDER BY c) AS columns FROM (SELECT o_orderpriority AS id, CASE WHEN o_orderstatus = 'P' THEN 'no status' ELSE o_orderstatus END AS c, count(*) AS n FROM orders GROUP BY ALL) GROUP BY id) USING (id)
    JOIN (SELECT id, string_agg(k || ':' || coalesce(s, ''), ',' ORDER BY k) AS first FROM (SELECT o_orderpriority AS id, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 10) GROUP BY id) USING (id)"""
)
def board_overview(spark, d):
    items = _items(spark, d).withColumn("title", F.concat(F.lit("order "), "id"))
    boards = items.select(F.col("board_id").alias("id"), F.col("board_id").alias("name")).distinct()
    text = lambda c, x, y: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s[x].cast("string"), F.coalesce(s[y].cast("string"), F.lit("")))), ",").alias(c)
    return store.board_overview(boards, items).select("id", "items", text("columns", "column", "n"), text("first", "id", "status"))


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'moved' WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def board_upsert(spark, d):
    moved = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.lit("moved").alias("status"))
    return store.upsert_rows(_items(spark, d).select("id", "status"), moved)


#: Requests of lines to the boards of their orders: moves, comments, new items, one that can't be done, one of no item; returned lines' were sent.
_REQUESTS = """WITH lines AS (SELECT l_orderkey || '-' || l_linenumber AS request_id, l_orderkey * 10 + l_linenumber AS ord, o_orderpriority AS board_id,
    CASE l_linenumber WHEN 1 THEN 'move' WHEN 2 THEN 'move' WHEN 4 THEN 'create' WHEN 5 THEN 'archive' WHEN 6 THEN 'move' ELSE 'comment' END AS action,
    CASE WHEN l_linenumber = 6 THEN 'none' ELSE CAST(l_orderkey AS VARCHAR) END AS item_id, 'Order ' || l_partkey AS title, CASE WHEN l_linenumber = 2 THEN l_returnflag ELSE l_linestatus END AS status, l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    items AS (SELECT o_orderpriority AS board_id, CAST(o_orderkey AS VARCHAR) AS id, 'order ' || o_custkey AS title, CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE o_orderstatus END AS status FROM orders),
    asked AS (SELECT * FROM lines WHERE request_id NOT IN (SELECT request_id FROM lines WHERE l_returnflag = 'R') QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ord, item_id, title, status) = 1),
    told AS (SELECT *, CASE WHEN action = 'archive' THEN 'boards have no such write: archive'
        WHEN action = 'create' AND (EXISTS (SELECT 1 FROM items i WHERE i.board_id = asked.board_id AND i.status <> 'closed' AND i.title = lower(asked.title)) OR row_number() OVER (PARTITION BY board_id, action, title ORDER BY ord, request_id) > 1) THEN 'an open item has this title'
        WHEN item_id = 'none' THEN 'the board has no such item' END AS error FROM asked)"""


def _board_writes(spark, d):
    orders = table(spark, d, "orders")
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    items = orders.select(F.col("o_orderpriority").alias("board_id"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("order "), "o_custkey").alias("title"), F.when(F.col("o_orderstatus") == "P", "closed").otherwise(F.col("o_orderstatus")).alias("status"))
    action = F.when(number.isin(1, 2, 6), "move").when(number == 4, "create").when(number == 5, "archive").otherwise("comment")
    lines = table(spark, d, "lineitem").join(orders, key == F.col("o_orderkey")).select(
        F.concat_ws("-", key.cast("string"), number.cast("string")).alias("request_id"), (key * 10 + number).cast("bigint").alias("ord"), F.col("o_orderpriority").alias("board_id"), action.alias("action"),
        F.when(number == 6, "none").otherwise(key.cast("string")).alias("item_id"), F.concat(F.lit("Order "), "l_partkey").alias("title"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("array<string>").alias("labels"),
        F.when(number == 2, F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("status"), "l_returnflag",
    )
    return store.request_board_writes(items, lines, lines.filter("l_returnflag = 'R'"))


@query(_REQUESTS + " SELECT request_id, board_id, action, CASE WHEN action = 'create' THEN request_id ELSE item_id END AS item_id, error FROM told")
def board_outbox(spark, d):
    return _board_writes(spark, d)[1].select("request_id", "board_id", "action", "item_id", "error")


@query(
    _REQUESTS
    + """ SELECT board_id, id, title, coalesce(m.status, items.status) AS status FROM items LEFT JOIN (SELECT board_id, item_id AS id, arg_max(status, ord) AS status FROM told WHERE action = 'move' AND error IS NULL GROUP BY 1, 2) m USING (board_id, id)
    UNION ALL SELECT board_id, request_id, title, status FROM told WHERE action = 'create' AND error IS NULL"""
)
def board_after_writes(spark, d):
    return _board_writes(spark, d)[0].select("board_id", "id", "title", "status")


_LOG = "'[' || CASE user_id % 4 WHEN 0 THEN 'Index' WHEN 1 THEN 'graph' WHEN 2 THEN 'scan' ELSE event_type END || '] ' || CAST(event_id % 100 AS VARCHAR) || '/100'"


def _logs(spark, d):
    name = F.when(F.col("user_id") % 4 == 0, "Index").when(F.col("user_id") % 4 == 1, "graph").when(F.col("user_id") % 4 == 2, "scan").otherwise(F.col("event_type"))
    message = F.concat(F.lit("["), name, F.lit("] "), (F.col("event_id") % 100).cast("string"), F.lit("/100"))
    return table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("ord"), message.alias("message"))


_PHASE = "CASE WHEN starts_with(lower(message), '[index]') THEN 'index' WHEN starts_with(lower(message), '[graph]') THEN 'graph' WHEN starts_with(lower(message), '[scan]') THEN 'scan' ELSE 'info' END"


@query(f"SELECT run_id, ord, {_PHASE} AS phase FROM (SELECT event_type AS run_id, event_id AS ord, {_LOG} AS message FROM events)")
def classify_log(spark, d):
    return _logs(spark, d).select("run_id", "ord", progress.classify_log(F.col("message")).alias("phase"))


@query(
    f"""WITH l AS (SELECT run_id, ord, message, {_PHASE} AS phase FROM (SELECT event_type AS run_id, event_id AS ord, {_LOG} AS message FROM events)),
    f AS (SELECT run_id, phase, max(ord) AS last_ord, max(CASE WHEN starts_with(message, '[graph]') THEN least(1.0, CAST(ord % 100 AS DOUBLE) / 100) END) AS fraction FROM l GROUP BY run_id, phase),
    p AS (SELECT run_id, arg_max(phase, last_ord) AS phase, arg_max(coalesce(fraction, -1), last_ord) AS fraction FROM f WHERE phase <> 'info' GROUP BY run_id)
    SELECT r.run_id, coalesce(p.phase, 'info') AS phase, coalesce(p.fraction >= 0, false) AS determinate, CASE WHEN p.fraction >= 0 THEN CAST(least(100, floor(50 + 35 * p.fraction + 0.5)) AS INTEGER) END AS pct FROM (SELECT DISTINCT run_id FROM l) r LEFT JOIN p USING (run_id)"""
)
def ingest_progress(spark, d):
    return progress.ingest_progress(progress.phase_fractions(_logs(spark, d)))


_PROJECTS = "SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'analyzing' ELSE 'error' END AS status FROM customer"


def _projects(spark, d):
    status = F.when(F.col("c_custkey") % 3 == 0, "ready").when(F.col("c_custkey") % 3 == 1, "analyzing").otherwise("error")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), status.alias("status"), F.col("c_acctbal").alias("updated_at"))


@query(f"SELECT id, name, CASE WHEN status <> 'analyzing' THEN status WHEN id IN (SELECT o_custkey FROM orders) THEN 'ready' ELSE 'error' END AS status FROM ({_PROJECTS})")
def reap_stale(spark, d):
    return store.reap_stale(_projects(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))).select("id", "name", "status")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def project_latest(spark, d):
    return store.default_project(_projects(spark, d)).select("id")


@query("SELECT s_name AS name, s_nationkey % 2 = 0 AND s_nationkey % 3 <> 0 AND (s_suppkey % 2 = 0 OR s_nationkey % 5 <> 0) AS stale FROM supplier")
def update_check(spark, d):
    suppliers = table(spark, d, "supplier")
    source = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "https://h/").otherwise("local:/"), F.col("s_suppkey").cast("string"))
    repos = suppliers.select(F.col("s_name").alias("name"), source.alias("source"), F.when(F.col("s_nationkey") % 5 == 0, F.lit(None)).when(F.col("s_nationkey") % 3 == 0, "same").otherwise("old").alias("commit"))
    heads = suppliers.filter("s_nationkey % 2 = 0").select(source.alias("source"), F.when(F.col("s_nationkey") % 3 == 0, F.when(F.col("s_nationkey") % 5 == 0, F.lit(None)).otherwise("same")).otherwise("new").alias("remote_commit"))
    return store.check_updates(repos, heads).select("name", "stale")


@query("SELECT p_partkey, p_brand || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_name(spark, d):
    return store.unique_names(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"))).select("p_partkey", "unique_name")


_CONFIG_SQL = "config AS (SELECT 'k' || (event_id % 50) || '.' || event_type AS key, CAST(max(user_id) AS VARCHAR) AS value, min(event_id) AS first FROM events GROUP BY 1)"


@query(
    f"""WITH {_CONFIG_SQL}, consts AS (SELECT p_brand AS class, p_type AS name, max(p_name) AS value, min(p_name) AS low FROM part GROUP BY 1, 2), flat AS (SELECT name, min(value) AS value FROM (SELECT name, first_value(value) OVER (PARTITION BY name ORDER BY class, value) AS value FROM (SELECT p_brand AS class, p_type AS name, p_name AS value FROM part)) GROUP BY name),
    tokens AS (SELECT '${{k' || (event_id % 60) || '.' || event_type || ':none}}' AS token, 'k' || (event_id % 60) || '.' || event_type AS n FROM events GROUP BY ALL),
    t2 AS (SELECT DISTINCT '${{' || event_type || '}}' AS token, event_type AS n FROM events)
    SELECT token, coalesce(value, 'none') AS channel FROM tokens LEFT JOIN config ON key = n
    UNION ALL SELECT token, (SELECT arg_min(value, first) FROM config WHERE ends_with(key, '.' || n)) FROM t2
    UNION ALL SELECT class || '.' || name, value FROM consts UNION ALL SELECT name, value FROM flat UNION ALL SELECT '/x', '/x' UNION ALL SELECT '', 'unknown' UNION ALL SELECT '#{{a}}', '#{{a}}'"""
)
def resolve_channel(spark, d):
    from ..operators.resolve import resolve_channel as resolve

    events, part = table(spark, d, "events"), table(spark, d, "part")
    key = F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string"), F.lit("."), "event_type")
    config = events.groupBy(key.alias("key")).agg(F.max("user_id").cast("string").alias("value"), F.min("event_id").alias("first"))
    constants = part.select(F.col("p_brand").alias("class"), F.col("p_type").alias("name"), F.col("p_name").alias("value"), F.concat(F.rpad("p_brand", 12, " "), "p_name").alias("ord"))
    asked = events.select(F.concat(F.lit("${k"), (F.col("event_id") % 60).cast("string"), F.lit("."), "event_type", F.lit(":none}")).alias("token"))
    asked = asked.union(events.select(F.concat(F.lit("${"), "event_type", F.lit("}")))).union(part.select(F.concat_ws(".", "p_brand", "p_type"))).union(part.select("p_type"))
    asked = asked.union(spark.createDataFrame([("/x",), ("",), ("#{a}",)], "token string"))
    return resolve(asked, constants, config)


# ---------------------------------------------------------------- symbol resolution on types made of parts


_TYPES_SQL = """WITH RECURSIVE types AS (
    SELECT p_partkey, 'T' || (p_partkey % 400) AS simple, 'p' || (p_size % 7) AS package, 'p' || (p_size % 7) || '.T' || (p_partkey % 400) AS fqn, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS ord,
        'p' || ((p_size + 1) % 7) || '.T' || ((p_partkey * 3) % 400) AS import, 'p' || ((p_size + 2) % 7) AS wild, 'T' || ((p_partkey * 7) % 450) AS super, 'f' || (p_partkey % 10) AS field, 'T' || ((p_partkey * 5) % 400) AS field_type,
        CASE WHEN p_partkey % 4 = 0 THEN 'interface' ELSE 'class' END AS kind FROM part
), last AS (SELECT fqn, arg_max(p_partkey, ord) AS p_partkey FROM types GROUP BY fqn), scanned AS (SELECT t.* FROM types t JOIN last USING (fqn, p_partkey)),
asked AS (SELECT p_partkey, super AS simple FROM types UNION SELECT p_partkey, string_split(import, '.')[2] FROM types),
c AS (
    SELECT a.p_partkey, a.simple, s.p_partkey AS target, 1 AS rank FROM asked a JOIN types t USING (p_partkey) JOIN scanned s ON s.fqn = t.import WHERE string_split(t.import, '.')[2] = a.simple
    UNION ALL SELECT a.p_partkey, a.simple, min(s.p_partkey), 2 FROM asked a JOIN types t USING (p_partkey) JOIN types s ON s.simple = a.simple AND s.package = t.wild GROUP BY a.p_partkey, a.simple HAVING count(*) = 1
    UNION ALL SELECT a.p_partkey, a.simple, s.p_partkey, 3 FROM asked a JOIN types t USING (p_partkey) JOIN scanned s ON s.fqn = t.package || '.' || a.simple
    UNION ALL SELECT a.p_partkey, a.simple, min(s.p_partkey), 4 FROM asked a JOIN types s ON s.simple = a.simple GROUP BY a.p_partkey, a.simple HAVING count(*) = 1
), found AS (SELECT p_partkey, simple, arg_min(target, rank) AS target FROM c GROUP BY p_partkey, simple),
supers AS (SELECT t.p_partkey, f.target, x.simple FROM types t JOIN found f ON f.p_partkey = t.p_partkey AND f.simple = t.super JOIN types x ON x.p_partkey = f.target)"""


def _part_index(spark, d):
    from ..sources.extract import TYPE_DDL, index

    k = F.col("p_partkey")
    name = lambda x, n: F.concat(F.lit("T"), (x % n).cast("string"))
    package = lambda x: F.concat(F.lit("p"), ((F.col("p_size") + x) % 7).cast("string"))
    rows = table(spark, d, "part").select(
        F.lit("R").alias("repo"), F.lpad(k.cast("string"), 9, "0").alias("file"), F.lit(0).alias("place"), name(k, 400).alias("simple_name"), F.when(k % 4 == 0, "interface").otherwise("class").alias("kind"),
        F.concat_ws(".", package(0), name(k, 400)).alias("fqn"), package(0).alias("package"), F.lit(1).alias("line"), F.array(F.concat_ws(".", package(1), name(k * 3, 400))).alias("explicit"), F.array(package(2)).alias("wildcard"),
        F.array(name(k * 7, 450)).alias("supertypes"), F.from_json(F.lit("[]"), TYPE_DDL.split("annotations ")[1].split(", fields")[0]).alias("annotations"),
        F.array(F.struct(F.concat(F.lit("f"), (k % 10).cast("string")).alias("name"), name(k * 5, 400).alias("type"), F.lit(None).cast("string").alias("constant"), F.lit("").alias("channel"))).alias("fields"),
        F.from_json(F.lit("[]"), TYPE_DDL.split("methods ")[1]).alias("methods"),
    )
    return index(rows)


def _part_of(column: str) -> F.Column:
    """The part that a type's key names."""
    return F.element_at(F.split(F.col(column), "\\|"), 2).cast("bigint")


def _part_asked(idx):
    own = idx.types.select("key", F.explode("supertypes").alias("simple"))
    return own.union(idx.types.select("key", F.substring_index(F.get("explicit", F.lit(0)), ".", -1))).distinct()


@query(_TYPES_SQL + " SELECT p_partkey, simple, target FROM found")
def find_class(spark, d):
    from ..operators.resolve import find_class as find

    idx = _part_index(spark, d)
    return find(idx, _part_asked(idx)).select(_part_of("key").alias("p_partkey"), "simple", _part_of("target").alias("target"))


@query(
    _TYPES_SQL
    + """, q AS (SELECT a.p_partkey, a.simple, t.import AS fqn, 1 AS rank FROM asked a JOIN types t USING (p_partkey) WHERE string_split(t.import, '.')[2] = a.simple
    UNION ALL SELECT a.p_partkey, a.simple, min(s.fqn), 2 FROM asked a JOIN types t USING (p_partkey) JOIN types s ON s.simple = a.simple AND s.package = t.wild GROUP BY a.p_partkey, a.simple HAVING count(*) = 1
    UNION ALL SELECT a.p_partkey, a.simple, t.package || '.' || a.simple, 3 FROM asked a JOIN types t USING (p_partkey)) SELECT p_partkey, simple, arg_min(fqn, rank) AS fqn FROM q GROUP BY p_partkey, simple"""
)
def resolve_fqn(spark, d):
    from ..operators.resolve import resolve_fqn as resolve

    idx = _part_index(spark, d)
    return resolve(idx, _part_asked(idx)).select(_part_of("key").alias("p_partkey"), "simple", "fqn")


@query(_TYPES_SQL + " SELECT super AS simple, p_partkey AS impl FROM scanned")
def impls_of(spark, d):
    from ..operators.resolve import impls_of as impls

    return impls(_part_index(spark, d)).select("simple", _part_of("impl").alias("impl"))


@query(_TYPES_SQL + " SELECT p_partkey, field AS name, field_type AS type FROM types UNION ALL SELECT t.p_partkey, x.field, x.field_type FROM types t JOIN supers s USING (p_partkey) JOIN types x ON x.p_partkey = s.target WHERE x.field <> t.field")
def field_type(spark, d):
    from ..operators.resolve import field_types

    return field_types(_part_index(spark, d)).select(_part_of("key").alias("p_partkey"), "name", "type")


@query(
    _TYPES_SQL
    + """, up AS (SELECT p_partkey, p_partkey AS at, [simple] AS names FROM types UNION ALL SELECT u.p_partkey, s.target, list_append(u.names, s.simple) FROM up u JOIN supers s ON s.p_partkey = u.at WHERE NOT list_contains(u.names, s.simple))
    SELECT p_partkey, names[-1] AS ancestor, CAST(len(names) - 1 AS INTEGER) AS distance FROM up"""
)
def hierarchy(spark, d):
    from ..operators.resolve import ancestors

    return ancestors(_part_index(spark, d)).select(_part_of("key").alias("p_partkey"), F.col("target_simple").alias("ancestor"), F.size("walk").alias("distance"))


@query(GRAPH + " SELECT ep_id, path, CASE WHEN contains(method, '.') THEN method ELSE class_name || '.' || method END AS name FROM nodes WHERE CASE WHEN contains(method, '.') THEN method ELSE class_name || '.' || method END IN (SELECT method FROM producers) OR contains(method, 'send')")
def producing_nodes(spark, d):
    return views.producing_nodes(graph(spark, d)).withColumn("path", path_text())


@query(
    GRAPH
    + """, cons AS (SELECT channel, kind, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM members WHERE side = 'consumer' GROUP BY channel, kind), prod AS (SELECT channel, kind, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM members WHERE side = 'producer' GROUP BY channel, kind)
    SELECT p.repo AS owner, 'out' AS direction, p.channel, c.kind, c.repos FROM (SELECT DISTINCT repo, channel FROM producers) p JOIN cons c ON c.channel = p.channel
    UNION ALL SELECT e.id, 'in', e.channel, p.kind, p.repos FROM entry_points e JOIN prod p ON p.channel = e.channel WHERE e.type IN ('kafka-consumer', 'event-listener')"""
)
def entry_connections(spark, d):
    return views.connections(linked(spark, d, keep="members"))


@query(SUPPLY + _FLOWS + """, pick AS (SELECT repo, channel, method FROM entry_points WHERE id = (SELECT min(id) FROM entry_points WHERE channel IN (SELECT channel FROM members)))
    SELECT DISTINCT s.flow_id FROM steps s JOIN pick ON s.repo = pick.repo JOIN entry_points e ON e.id = s.entry_id AND e.channel = pick.channel AND e.method = pick.method""")
def flows_for_unit(spark, d):
    g = supply_graph(spark, d)
    linked = g.entry_points.join(g.members.select("channel").distinct(), "channel", "left_semi").agg(F.min_by(F.struct("repo", "channel", "method"), "id")).first()[0]
    repo, channel, method = linked or ("", "", "")
    return views.flows_for_unit(_steps(spark, d), g.entry_points, views.publishes(g), views.reached_methods(g), repo, channel, method, "in")

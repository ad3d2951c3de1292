"""Graph operators on hand-built graphs and against naive versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meshlens.functions import scalars as S
from meshlens.operators import cycles, diff, flows, links, reach, store, tools, tree, views
from meshlens.plans import catalogue
from meshlens.plans.fixpoint import reachable
from meshlens.plans.relations import DOCUMENT_DDL, ENTRY_DDL, MEMBER_DDL, NODE_DDL, PRODUCER_DDL, GraphRelations, read_snapshot, from_documents, graph_document, links_document, read_graph, write_graph
from meshlens.streaming import progress


def entries(spark, *rows):
    """(repo, class, type, channel) with defaults for the rest."""
    made = [(f"{k:03}", f"{r}:{c}.on:{ch}", r, t, ch, c, "on", f"{c}.java", k, "", "", 1, 5, 2, 0, None) for k, (r, c, t, ch) in enumerate(rows)]
    return spark.createDataFrame(made, ENTRY_DDL)


def producers(spark, *rows):
    made = [(f"{k:03}", f"{r}:{c}.send:{ch}", r, t, ch, f"{c}.send", f"{c}.java", k, "", "") for k, (r, c, t, ch) in enumerate(rows)]
    return spark.createDataFrame(made, PRODUCER_DDL)


def members(spark, *rows):
    """(channel, producing repo, consuming repo)."""
    made = []
    for k, (ch, a, b) in enumerate(rows):
        made += [(ch, "message", "", "producer", f"{a}:P.m", a, f"{k}"), (ch, "message", "", "consumer", f"{b}:C.m", b, f"{k}")]
    return spark.createDataFrame(made, MEMBER_DDL)


def graph(spark, e=(), p=(), m=(), nodes=(), repos=("a", "b"), unreachable=None):
    return GraphRelations(entries(spark, *e), producers(spark, *p), members(spark, *m), spark.createDataFrame(list(nodes), NODE_DDL), unreachable, spark.createDataFrame([(r, r) for r in repos], "ord string, repo string"))


def test_orphans(spark):
    g = graph(
        spark, e=[("b", "C1", "kafka-consumer", "linked"), ("b", "C2", "kafka-consumer", " lone "), ("b", "C3", "rest-endpoint", "/x"), ("b", "C4", "websocket", "ws"), ("b", "C5", "event-listener", "unknown-event")],
        p=[("a", "P1", "kafka-producer", "linked"), ("a", "P2", "kafka-producer", "nobody"), ("a", "P3", "http-call", "/x"), ("a", "P4", "grpc-call", "/S/m"), ("a", "P5", "kafka-producer", "ws"), ("a", "P6", "kafka-producer", "unknown")],
    )
    got = {(r.side, r.channel) for r in tools.find_orphans(g).collect()}
    assert got == {("producer", "nobody"), ("producer", "/S/m"), ("producer", "ws"), ("consumer", "lone")}
    assert tools.find_orphans(graph(spark)).count() == 0


def test_cycles(spark):
    assert cycles.find_cycles(members(spark, ("x", "a", "b"), ("y", "b", "a"), ("z", "b", "b"))).collect() == [("a>b>a", 2, ["x", "y"])]
    assert cycles.find_cycles(members(spark, ("x", "a", "b"), ("y", "b", "c"))).count() == 0
    assert cycles.find_cycles(members(spark)).count() == 0
    full = members(spark, *[(f"{a}{b}", a, b) for a in "abcde" for b in "abcde" if a != b])
    assert cycles.find_cycles(full).count() == 84
    assert cycles.cycle_summary(full).collect()[0] == (84, "a,b,c,d,e")


@pytest.mark.parametrize(
    ("consumers", "made", "want"),
    [
        (["b"], ["a"], {"a"}), (["a"], ["a"], set()), (["a", "b"], ["a", "b"], set()), (["a", "b"], ["a", "b", "c"], {"c"}), (["a", "b"], ["a"], {"a"}), ([], ["a"], set()),
    ],
)
def test_closed_loops(spark, consumers, made, want):
    got = links.link_message(entries(spark, *[(r, "C", "kafka-consumer", "t") for r in consumers]), producers(spark, *[(r, "P", "kafka-producer", "t") for r in made]))
    rows = got.collect()
    assert {r.repo for r in rows if r.side == "producer"} == want
    assert {r.repo for r in rows if r.side == "consumer"} == (set(consumers) if want else set())


def test_http_links_by_normalised_path(spark):
    e = entries(spark, ("b", "C", "rest-endpoint", "/o/status/{id}"), ("a", "C", "rest-endpoint", "/o/status/{id}"))
    p = producers(spark, ("a", "P", "http-call", "/o/status/123"), ("a", "Q", "http-call", "/other"))
    rows = links.link_http(e, p).collect()
    assert {(r.channel, r.side, r.repo) for r in rows} == {("/o/status/123", "producer", "a"), ("/o/status/123", "consumer", "b")}


def naive_tree(root, calls, max_depth=4, max_nodes=50):
    out, seen = [((), root)], {root}

    def go(name, path, depth):
        if depth >= max_depth or len(out) >= max_nodes:
            return
        k = 0
        for callee in calls.get(name, ()):
            if len(out) >= max_nodes:
                break
            if callee in seen:
                continue
            seen.add(callee)
            out.append(((*path, k), callee))
            k += 1
            go(callee, out[-1][0], depth + 1)

    go(root, (), 0)
    return sorted(out)


def test_call_tree_equals_depth_first_search(spark):
    rng = random.Random(3)
    calls, roots, want = [], [], {}
    for g in range(12):
        n = rng.choice([3, 10, 40, 90])
        edges = {f"g{g}m{k}": [f"g{g}m{rng.randrange(n)}" for _ in range(rng.randint(0, 6))] for k in range(n)}
        for a, bs in edges.items():
            calls += [(a, k, b + "()", 1, b, "C", "f", 1, False) for k, b in enumerate(bs)]
        roots.append((f"e{g}", f"g{g}m0", "root", "C", "f", 0))
        want[f"e{g}"] = naive_tree(f"g{g}m0", edges)
    calls.append(("g0m0", 99, "x.getName", 0, None, None, None, None, False))
    ddl = "caller string, ord bigint, display string, arity int, callee string, callee_class string, callee_file string, callee_line int, ambiguous boolean"
    rows = tree.call_tree(spark.createDataFrame(roots, "ep_id string, key string, method string, class_name string, file string, line int"), spark.createDataFrame(calls, ddl)).collect()
    for ep, nodes in want.items():
        got = sorted((tuple(r.path), r.method[:-2] if r.path else None) for r in rows if r.ep_id == ep)
        assert got == [(p, n if p else None) for p, n in nodes], ep


def test_tree_marks(spark):
    calls = [("r", 0, "a.x", 1, "A", "A", "f", 1, True), ("r", 1, "b.unknown", 1, None, None, None, None, False), ("A", 0, "c.y", 1, "B", "B", "f", 2, False)]
    for k in range(5):
        calls.append((f"d{k}" if k else "B", 0, f"d.n{k + 1}", 1, f"d{k + 1}", "D", "f", 3, True))
    calls += [("many", k, f"m.c{k}", 1, f"c{k}", "M", "f", 4, False) for k in range(80)]
    ddl = "caller string, ord bigint, display string, arity int, callee string, callee_class string, callee_file string, callee_line int, ambiguous boolean"
    roots = [("e", "r", "R.on", "R", "f", 0), ("f", "many", "M.on", "M", "f", 0)]
    rows = tree.call_tree(spark.createDataFrame(roots, "ep_id string, key string, method string, class_name string, file string, line int"), spark.createDataFrame(calls, ddl))
    got = {r.method: (r.depth, r.confidence) for r in rows.filter("ep_id = 'e'").collect()}
    assert got["a.x"] == (1, "AMBIGUOUS") and got["b.unknown"] == (1, "INFERRED")
    assert got["d.n2"] == (4, "EXTRACTED"), "the depth limit marks an ambiguous node as extracted again"
    wide = {r.method: r.confidence for r in rows.filter("ep_id = 'f'").collect()}
    assert len(wide) == 50 and wide["m.c48"] == "TRUNCATED", "the node that fills the tree is marked truncated"
    metrics = {r.ep_id: r for r in tree.tree_metrics(rows).collect()}
    assert (metrics["f"].total_nodes, metrics["f"].branch_count, metrics["f"].depth) == (50, 1, 1)


def test_callers_and_paths(spark):
    rows = [("e", [], 0, "A.on", "A", "f", 1, ""), ("e", [0], 1, "svc.place", "S", "f", 2, ""), ("e", [0, 0], 2, "repo.save", "R", "f", 3, ""), ("e", [0, 0, 0], 3, "db.saveAll", "D", "f", 4, ""), ("e", [1], 1, "save", "T", "f", 5, "")]
    nodes = spark.createDataFrame(rows, NODE_DDL)
    assert {(r.called_method, r.call_path) for r in tree.find_callers(nodes, "SAVE").collect()} == {("repo.save", "A.on > svc.place > repo.save"), ("db.saveAll", "A.on > svc.place > repo.save > db.saveAll"), ("save", "A.on > T.save")}
    assert sorted(r.chain for r in tree.trace_path(nodes, "a.on", "save").collect()) == ["A.on > save", "A.on > svc.place > repo.save"]
    assert sorted(r.chain for r in tree.trace_path(nodes, "save", "save").collect()) == ["repo.save > db.saveAll"]


def test_reachability(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    want, todo = {0, 1}, [0, 1]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in want:
                want.add(b)
                todo.append(b)
    got = reachable(spark.createDataFrame([(0,), (1,), (1,)], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert sorted(r.node for r in got) == sorted(want)
    methods = spark.createDataFrame([("a", "run", True), ("b", "getName", True), ("c", "dead", True), ("d", "iface", False)], "key string, name string, has_body boolean")
    reached = reach.reachable_methods(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "c", "x.getC", 0), ("a", None, "y", 1)], "caller string, callee string, display string, arity int"))
    assert [r.key for r in reach.unreachable_methods(methods, reached).collect()] == ["c"]


def test_dead_code(spark):
    e = entries(spark, ("a", "C1", "x", "1"), ("a", "C2", "x", "2"), ("a", "C3", "x", "3"), ("a", "C4", "x", "4"))
    e = e.withColumn("total_nodes", F.when(F.col("class_name") == "C1", 1).when(F.col("class_name") == "C2", F.lit(None)).otherwise(5)).withColumn("thin", F.when(F.col("class_name") == "C3", True).when(F.col("class_name") == "C4", False))
    g = graph(spark, m=[("x", "a", "b")], repos=("a", "b", "c")).with_(entry_points=e)
    assert {r.id[2:4] for r in tools.thin_handlers(g).collect()} == {"C1", "C2", "C3"}
    row = tools.dead_code_summary(g).collect()[0]
    assert (row.unreachable_methods, row.thin_handlers, row.isolated_repos, row.method_index_available) == (0, 3, 1, False)


def test_diff(spark):
    old = graph(spark, e=[("a", "C1", "k", "x"), ("a", "C2", "k", "y")], p=[("a", "P", "k", "x")], m=[("x", "a", "b"), ("y", "a", "b")])
    new = graph(spark, e=[("a", "C1", "k", "x"), ("a", "C3", "k", "z")], p=[("a", "P", "other", "x")], m=[("x", "a", "c"), ("z", "a", "b")])
    new = new.with_(entry_points=new.entry_points.withColumn("depth", F.lit(7)))
    assert {r.id[2:4]: r.status for r in diff.diff_entries(old, new).collect()} == {"C1": "changed", "C2": "removed", "C3": "added"}
    assert [r.status for r in diff.diff_producers(old, new).collect()] == ["changed"]
    assert {r.channel: r.status for r in diff.diff_links(old, new).collect()} == {"x": "changed", "y": "removed", "z": "added"}
    assert diff.diff_summary(old, new).collect()[0].asDict() == {"entry_points_added": 1, "entry_points_removed": 1, "entry_points_changed": 1, "producers_added": 0, "producers_removed": 0, "producers_changed": 1, "links_added": 1, "links_removed": 1}
    assert diff.diff_summary_text(diff.diff_summary(old, new)).collect()[0].text == "+1 entry point · ~1 changed · −1 removed · +1 channel · −1 channel"
    same = diff.diff_summary_text(diff.diff_summary(old, old)).collect()[0]
    assert (same.text, same.has_changes) == ("", False)
    assert diff.diff_repo_counts(old, new).collect()[0] == ("a", 1, 1, 1)


def test_registered_flows_have_no_hop_limit(spark, monkeypatch):
    """A chain of six hops that ends where it began: only the visited entry ends it."""
    hops = spark.createDataFrame([(f"e{k}", f"e{(k + 1) % 7}", f"r{(k + 1) % 7}", f"c{k}", "message", "", "") for k in range(7)], "src string, dst string, dst_repo string, channel string, kind string, verb string, response_type string")
    origins = spark.createDataFrame([("flow:e0", "e0", "r0")], "flow_id string, id string, repo string")
    monkeypatch.setattr(views, "publishes", lambda g: None)
    monkeypatch.setattr(views, "flow_hops", lambda sent, entries: hops)
    monkeypatch.setattr(views, "flow_origins", lambda entries, members: origins)
    rows = catalogue.QUERIES["detect_flows"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.depth, r.entry_id) for r in rows) == [(k, f"e{k}") for k in range(7)]
    assert catalogue.QUERIES["flow_metrics"](spark, "/root/testdata/sf0.001").collect()[0].hop_count == 6


def test_flows(spark):
    hops = spark.createDataFrame([("o", "b1", "a", "b", "t", "message", "", ""), ("b1", "c1", "b", "c", "/x", "http", "GET", "Out"), ("c1", "o", "c", "a", "u", "message", "", "")], "src string, dst string, src_repo string, dst_repo string, channel string, kind string, verb string, response_type string")
    origins = spark.createDataFrame([("flow:o", "o", "a")], "flow_id string, id string, repo string")
    steps = views.detect_flows(origins, hops)
    assert sorted((r.depth, r.entry_id) for r in steps.collect()) == [(0, "o"), (1, "b1"), (2, "c1")], "an entry doesn't come twice on a branch"
    assert views.flow_metrics(steps).collect()[0].asDict() == {"flow_id": "flow:o", "repos": "a,b,c", "repo_count": 3, "hop_count": 2, "has_cross_repo": True, "has_sync": True}
    taken = flows.hops_taken(flows.flow_entries(origins, hops), hops)
    assert {(r.src, r.dst, r.kind) for r in flows.repo_edges(taken).collect()} == {("a", "b", "message"), ("b", "c", "http"), ("c", "b", "http-response")}
    assert {(r.via, r.from_repo) for r in views.flow_trace_repo(steps, "c").collect()} == {("GET /x", "b")}


def test_scalars(spark):
    rows = [("/a/123/b", "/a/{p}/b"), ("a/{id}/", "/a/{p}"), ("/x/550e8400-e29b-41d4-a716-446655440000", "/x/{p}"), ("//", "/"), ("", "/")]
    df = spark.createDataFrame(rows, "path string, want string").select("want", S.normalize_http_path(F.col("path")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    hosts = {"https://github.com/acme": ("github", "acme", None), "https://github.com/a/b": (None, None, None), "https://gitlab.com/g/sub/": ("gitlab", "g/sub", None), "https://dev.azure.com/o/p": ("azure-devops", "o", "p"), "https://o.visualstudio.com/p": ("azure-devops", "o", "p"), "ftp://github.com/a": (None, None, None), "https://github.com/../a": (None, None, None), "https://bitbucket.org/w?x=1": ("bitbucket", "w", None)}
    got = {r.u: tuple(r.l) for r in spark.createDataFrame([(u,) for u in hosts], "u string").select("u", S.parse_host_link(F.col("u")).alias("l")).collect()}
    assert got == hosts
    trivial = {("a.getX", 0): True, ("a.getX", 1): False, ("is", 0): False, ("isOk", 0): True, ("x.map", 3): True, ("hasNext", 1): True, ("process", 0): False}
    df = spark.createDataFrame([(*k, v) for k, v in trivial.items()], "d string, n int, want boolean")
    assert all(r.want == r.got for r in df.select("want", S.is_trivial_call(F.col("d"), F.col("n")).alias("got")).collect())


def test_boards_and_diagrams(spark):
    issue = {"number": 4, "title": "a &amp; b", "state": "OPEN", "assignee": {"login": "x"}, "labels": [{"name": "l"}, {"name": ""}], "html_url": "u"}
    pages = spark.createDataFrame([(json.dumps(issue),), (json.dumps(issue | {"pull_request": {"url": "p"}}),)], "payload string")
    row = store.normalize_issues(pages, "o/r").collect()
    assert len(row) == 1 and row[0].asDict() | {"raw": ""} == {"id": "github:o/r#4", "number": "4", "title": "a & b", "status": "open", "assignee": "x", "labels": ["l"], "url": "u", "updated_at": "", "raw": ""}
    item = {"id": 9, "fields": [{"name": "Status", "value": {"name": "Doing"}}], "content": {"number": 2, "title": "t", "assignees": ["q"], "labels": []}}
    assert store.normalize_project_items(spark.createDataFrame([(json.dumps(item),)], "payload string"), "o/1").select("id", "status", "assignee").collect()[0] == ("github-project:o/1#9", "Doing", "q")


def test_changes_of_diagrams(spark):
    def change(rows, *changes):
        made = [(c, a, *[more.get(k) for k in ("diagram_id", "header", "code", "kind", "edits", "now", "new_id")]) for c, a, more in changes]
        after, told = store.change_diagrams(spark.createDataFrame(rows, store.DIAGRAM_DDL), spark.createDataFrame(made, store.CHANGE_DDL))
        return [tuple(r) for r in after.orderBy("conv_id", "ord").collect()], {r.conv_id: r for r in told.collect()}

    panel, told = change([], ("c", "replace", {"code": "a b a", "new_id": "d1", "now": "t1"}), ("e", None, {"header": " H ", "kind": "odd", "new_id": "d2"}))
    assert panel == [("c", "d1", "Diagram", "mermaid", "a b a", "t1", 0), ("e", "d2", "H", "mermaid", "", None, 0)] and told["c"].action == "add"
    after, told = change(panel, ("c", " PATCH ", {"edits": [("a", "c"), ("b", "a")], "now": "t2"}))
    assert after[0] == ("c", "d1", "Diagram", "mermaid", "c a c", "t2", 0) and after[1] == panel[1], "others stay"
    assert (told["c"].replaced, told["c"].error, told["c"].diagram_id) == (3, None, "d1")
    assert [(x.find, x.replacements) for x in told["c"].applied] == [("a", 2), ("b", 1)]
    told = change(panel, ("c", "patch", {"edits": [("a b a", "z" * 200), ("", "n"), ("z" * 99, "y")]}))[1]
    assert told["c"].applied == [] and "zzz" in told["c"].error, "a text that only an earlier edit would make isn't there"
    after, told = change(panel, ("c", "patch", {"edits": [("a", "x"), ("zz", "")]}))
    assert after == panel and "zz" in told["c"].error and told["c"].replaced == 0, "all or nothing"
    assert change(panel, ("c", "append", {"code": "!"}))[0][0][4] == "a b a!" and change(panel, ("c", "clear", {}))[0] == panel[1:]
    two, told = change(panel, ("c", "add", {"diagram_id": "d1", "code": "n", "new_id": "d3"}))
    assert [r[1] for r in two] == ["d1", "d3", "d2"] and told["c"].diagram_id == "d3", "a taken id gives a new one"
    for action, more in (("append", {"code": "!"}), ("replace", {"diagram_id": "none"}), ("patch", {"diagram_id": "d1"}), ("fly", {})):
        after, told = change(two, ("c", action, more))
        assert after == two and told["c"].error, action
    assert change(two, ("c", "remove", {"diagram_id": "d1"}))[0] == two[1:] and change(two, ("c", "remove", {}))[0] == two
    assert change(two, ("c", "replace", {"diagram_id": "d3", "kind": "html", "code": "<p>", "header": "N"}))[0][1][2:5] == ("N", "html", "<p>")


def test_tools_give_lists_and_errors(spark, tmp_path):
    tree_rows = [("b:C1.on:linked", [], 0, "C1.on", "C1", "f", 1, "EXTRACTED"), ("b:C1.on:linked", [0], 1, "repo.save", "Repo", "g", 2, "EXTRACTED")]
    old = graph(spark, e=[("b", "C1", "kafka-consumer", "linked")], p=[("a", "P1", "kafka-producer", "linked")], m=[("linked", "a", "b")], nodes=tree_rows)
    new = graph(spark, e=[("b", "C1", "kafka-consumer", "linked"), ("b", "C2", "kafka-consumer", "late")], m=[("late", "a", "b")], nodes=tree_rows)
    found = tools.fetch(tools.run_tool(new, "diff_graphs", {"old_graph": old}))
    assert found["entry_points_added"] == [{"key": "b:C2.on:late"}] and found["producers_removed"] == [{"key": "a:P1.send:linked"}]
    assert found["links_added"] == [{"key": "late"}] and found["summary"][0]["links_removed"] == 1 and found["entry_points_changed"] == []
    assert "no entry point" in tools.run_tool(new, "get_node", {"entry_point_id": "x"})["error"]
    node = tools.fetch(tools.run_tool(new, "get_node", {"entry_point_id": "b:C1.on:linked"}))
    assert [r["method"] for r in node["call_tree_flat"]] == ["C1.on", "repo.save"] and node["entry_point"][0]["channel"] == "linked"
    (caller,) = tools.fetch(tools.run_tool(new, "find_callers", {"method_name": "SAVE"}))["rows"]
    assert (caller["type"], caller["channel"], caller["repo"], caller["call_path"]) == ("kafka-consumer", "linked", "b", "C1.on > repo.save")
    dead = tools.fetch(tools.run_tool(new, "find_dead_code", {}))
    assert dead["isolated_repos"] == [] and dead["summary"][0]["method_index_available"] is False and dead["unreachable_methods"] == []
    overview = tools.fetch(tools.run_tool(new, "get_architecture_overview", {}))
    assert overview["totals"][0]["total_entry_points"] == 2 and overview["entry_types"] == [{"type": "kafka-consumer", "n": 2}]
    files = spark.createDataFrame([("b", "src/C1.java", "one\ntwo\nthree")], "repo string, path string, content string")
    source = tools.fetch(tools.run_tool(new, "get_source", {"files": files, "file_path": "src/C1.java", "start_line": 2, "highlight_line": 3}))
    assert [(r["line"], r["content"], r["highlighted"]) for r in source["rows"]] == [(2, "two", False), (3, "three", True)]
    projects = spark.createDataFrame([("p1", "ready", "2"), ("p2", "ready", "3"), ("p3", "error", "4")], "id string, status string, updated_at string")
    assert tools.fetch(tools.run_tool(new, "select_project", {"projects": projects}))["rows"][0]["id"] == "p2"
    assert "no project" in tools.run_tool(new, "select_project", {"projects": projects, "project": "p9"})["error"]
    broken = new.with_(entry_points=new.entry_points.withColumn("id", F.raise_error(F.lit("lost")).cast("string")))
    assert "lost" in tools.fetch(tools.run_tool(broken, "search_code", {"query": "x"}))["error"], "what fails later is an answer, too"


def test_diff_with_a_snapshot(spark, tmp_path):
    folder = str(tmp_path / "store")
    old = graph(spark, e=[("b", "C1", "kafka-consumer", "t")], m=[("t", "a", "b")])
    new = graph(spark, e=[("b", "C2", "kafka-consumer", "t")], m=[("t", "a", "b")])
    assert store.project_diff(new, folder)["no_baseline"]
    write_graph(old, folder, 10)
    write_graph(new, folder, 20)
    assert store.list_snapshots(spark, folder) == [20, 10]
    latest = store.project_diff(new, folder, light=True)
    assert latest["compared_at"] == 20 and tools.fetch(latest["diff"])["entry_points_added"] == [] and "old_graph" not in latest
    chosen = store.project_diff(new, folder, at="10")
    assert tools.fetch(chosen["diff"])["entry_points_added"] == [{"key": "b:C2.on:t"}] and chosen["old_graph"].entry_points.count() == 1
    for wrong in ("11", "x", "../10"):
        with pytest.raises(LookupError):
            store.project_diff(new, folder, at=wrong)
    assert store.save_snapshot(new.with_(methods_total=7), folder, 30, keep=2) == [30, 20] == store.list_snapshots(spark, folder)
    assert read_snapshot(spark, folder, 30).methods_total == 7 and read_snapshot(spark, folder, 20).methods_total == 0
    assert not (tmp_path / "store/members/snapshot_ts=10").exists()


def test_store(spark):
    snaps = spark.createDataFrame([("p", str(k)) for k in range(13)] + [("p", "x1")], "project_id string, snapshot_ts string")
    assert sorted(int(r.snapshot_ts) for r in store.retained_snapshots(snaps).collect()) == list(range(3, 13))
    with pytest.raises(ValueError):
        store.rename_project(snaps, "p", "  ")
    heads = spark.createDataFrame([("s1", "n", "u", "c1"), ("s2", "n", "local:/x", None), ("s3", "n", "local:/y", "c1"), ("s4", "n", "v", None)], "id string, name string, source string, commit string")
    remote = spark.createDataFrame([("u", "c1"), ("local:/x", "c2"), ("local:/y", "c2"), ("v", "c9")], "source string, remote_commit string")
    assert {r.source: r.stale for r in store.check_updates(heads, remote).collect()} == {"u": False, "local:/x": False, "local:/y": True, "v": True}


def test_progress_as_a_stream(spark, tmp_path):
    lines = ["[clone] a ready at /x", "[index] 5/10", "[index] 3/10", "[graph] 1/4", "noise"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"run_id": "r", "ord": k, "message": m}) for k, m in enumerate(lines)))
    stream = progress.watch_logs(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("phases").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.awaitTermination(60)
    rows = {r.phase: r for r in spark.table("phases").collect()}
    assert rows["index"].fraction == 0.5 and rows["graph"].fraction == 0.25
    assert progress.ingest_progress(spark.table("phases")).collect()[0].asDict() == {"run_id": "r", "phase": "graph", "determinate": True, "pct": 59}


def test_graph_document_round_trip(spark, tmp_path):
    tree_json = {"method": "A.on", "file": "f", "line": 1, "class_name": "A", "confidence": "EXTRACTED", "children": [{"method": "b.x", "file": "g", "line": 2, "class_name": "B", "confidence": "INFERRED", "children": []}]}
    document = {"repos": ["a", "b"], "entry_points": [{"id": "a:A.on:t", "repo": "a", "type": "kafka-consumer", "channel": "t", "class_name": "A", "method": "on", "file": "f", "line": 1, "call_tree": tree_json, "metrics": {"depth": 1, "total_nodes": 2}}], "producers": [{"id": "b:P.m:send:k", "repo": "b", "type": "kafka-producer", "channel": "t", "method": "P.m"}], "cross_repo_links": [{"channel": "t", "producers": ["b:P.m:send:k"], "consumers": ["a:A.on:t"]}], "generated_at": "x"}
    (tmp_path / "g.json").write_text(json.dumps(document, indent=1))
    g = read_graph(spark, str(tmp_path / "g.json"))
    assert [(r.path, r.method) for r in g.nodes.orderBy("path").collect()] == [([], "A.on"), ([0], "b.x")]
    assert g.unreachable is None and g.methods_total == 0
    assert links_document(g.members).select("kind", "producers", "consumers").collect()[0] == ("message", ["b:P.m:send:k"], ["a:A.on:t"])
    assert tools.fetch(tools.run_tool(g, "find_orphans", {"extra": 1}))["summary"] == [{"orphan_producers": 0, "orphan_consumers": 0, "orphan_channels": 0}]
    assert "error" in tools.run_tool(g, "nope", {}) and tools.run_tool(g, "task_complete", {"status": "?"})["status"] == "complete"
    for name in tools.registry():
        if name not in ("diff_graphs", "task_complete"):
            files = spark.createDataFrame([("a", "f", "x")], "repo string, path string, content string")
            projects = spark.createDataFrame([("p", "ready", "1")], "id string, status string, updated_at string")
            arguments = {"query": "a", "entry_point_id": "a:A.on:t", "method_name": "x", "from_method": "on", "to_method": "x", "channel": "t", "files": files, "file_path": "f", "projects": projects}
            assert "error" not in tools.fetch(tools.run_tool(g, name, arguments)), name
    assert tools.fetch(tools.run_tool(g, "diff_graphs", {"old_graph": g}))["summary"][0]["entry_points_changed"] == 0
    assert graph_document(g, roots={"a": "/src/a", "b": "/src/b"}).first().repo_roots == {"a": "/src/a", "b": "/src/b"} and graph_document(g).first().repo_roots == {}
    text = graph_document(g).select(F.to_json(F.struct("*")).alias("j"))
    again = from_documents(text.select(F.from_json("j", DOCUMENT_DDL).alias("d")).select("d.*"))
    for relation in ("entry_points", "producers", "nodes", "repos"):
        drop = ["ord"] if "ord" in getattr(g, relation).columns else []
        assert sorted(map(str, getattr(again, relation).drop(*drop).collect())) == sorted(map(str, getattr(g, relation).drop(*drop).collect())), relation
    assert {(r.channel, r.side, r.id) for r in again.members.collect()} == {(r.channel, r.side, r.id) for r in g.members.collect()}
    g.register("g1")
    assert spark.table("g1_entry_points").count() == 1
    write_graph(g, str(tmp_path / "out"), 5)
    assert spark.read.parquet(str(tmp_path / "out/producers")).select("snapshot_ts").collect()[0][0] == 5


def test_search_takes_each_field_by_itself(spark):
    ddl = "flow_id string, name string, label string, tag string, channel string"
    origins = spark.createDataFrame([("f1", "Save", "GET /a", "REST", "/a"), ("f2", "x", "every 5 ms", "TIMER", "orders.IN"), ("f3", "y", None, "KAFKA", None)], ddl)
    metrics = spark.createDataFrame([("f1", "shop"), ("f2", "stock,web"), ("f3", "shop,web")], "flow_id string, repos string")
    hits = lambda text, *hidden: {r.flow_id for r in views.flow_search(origins, metrics, text, hidden).collect()}
    assert hits("orders.in") == {"f2"} and hits(" SHOP ") == {"f1", "f3"} and hits("shop", "KAFKA") == {"f1"}
    assert hits("stock,web") == set() and hits("rest shop") == set(), "no text reaches over two fields"
    assert hits("  ") == {"f1", "f2", "f3"} and hits("none") == set()


def test_tests_by_a_languages_own_rules(spark):
    want = {"a/Src/Test/Java/X.java": True, "a\\src\\test\\java\\X.java": True, "a/TESTS/x.py": True, "a/latest.java": False, "a/OrderTest.java": True, "a/Ordertest.java": False, "attests/x.java": False, ".Test": True, "X.Test": False}
    rule = S.is_test_of(F.col("p"), ("src/test/java",), ("test", "tests"), ("Test", "IT"))
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", rule.alias("t")).collect()}
    assert got == want
    assert not spark.range(1).select(S.is_test_of(F.lit("src/test/ATest.java")).alias("t")).first().t


def test_trees_as_text(spark):
    rows = [("e", [], 0, "on", "C", "f", 1, "EXTRACTED"), ("e", [0], 1, "repo.save", "R", "g", 2, "INFERRED"), ("e", [0, 0], 2, "bus.send", "", "", 0, ""), ("e", [1], 1, "", "D", "", 0, "AMBIGUOUS"), ("e", [2], 1, "", "", "", 0, None), ("e", [10], 1, "z", None, "", 0, "EXTRACTED")]
    nodes = spark.createDataFrame(rows, NODE_DDL)
    sending = spark.createDataFrame([("e", [0, 0]), ("e", [0, 0]), ("other", [])], "ep_id string, path array<int>")
    lines = [r.line for r in tree.rendered(nodes, sending).orderBy("ep_id", "rank").collect()]
    assert lines == ["\u2192 C.on", "  \u2192 repo.save [INFERRED]", "    \u2192 bus.send [\u26a1 PRODUCER]", "  \u2192 D [AMBIGUOUS]", "  \u2192 unknown", "  \u2192 z"]
    assert tree.rendered(nodes.limit(0), sending).collect() == []


def test_sync_replaces_a_boards_items(spark):
    boards = spark.createDataFrame([("p", "old", "project", None, "t0"), ("q", "own", "project", True, "t0"), ("r", "repo", "repo", None, None)], "id string, name string, kind string, name_override boolean, synced_at string")
    items = spark.createDataFrame([("p", "1", "a"), ("q", "2", "b"), (None, "3", "c")], "board_id string, id string, title string")
    fresh = spark.createDataFrame([("7", "new")], "id string, title string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    after, held = store.sync_board(boards, items, "p", fresh, "t1", "New")
    assert rows(held) == {("p", "7", "new"), ("q", "2", "b"), (None, "3", "c")}
    assert rows(after.select("id", "name", "synced_at")) == {("p", "New", "t1"), ("q", "own", "t0"), ("r", "repo", None)}
    assert rows(store.sync_board(boards, items, "q", fresh.limit(0), "t1", "New")[0].select("id", "name")) == {("p", "old"), ("q", "own"), ("r", "repo")}
    assert store.sync_board(boards, items, "q", fresh.limit(0), "t1")[1].filter("board_id = 'q'").isEmpty()
    with pytest.raises(LookupError):
        store.sync_board(boards, items, "none", fresh, "t1")


def test_writes_to_boards_are_an_outbox(spark):
    items = spark.createDataFrame([("b", 1, "One", "open", 5), ("b", 2, "Two", "closed", 5), ("c", 1, "Other", None, 5)], "board_id string, id int, title string, status string, size int")
    ask = lambda *rows: spark.createDataFrame([(i, o, b, a, t, title, None, None, s) for i, o, b, a, t, title, s in rows], store.REQUEST_DDL)
    requests = ask(
        ("10", 1, "b", "move", "1", None, "doing"), ("11", 2, "b", "move", "1", None, "done"), ("11", 3, "b", "move", "1", None, "repeated"), ("12", 4, "c", "comment", "1", None, None), ("13", 5, "c", "move", "2", None, "done"),
        ("14", 6, "b", "create", None, " oNE ", "new"), ("15", 7, "b", "create", None, "two", "new"), ("16", 8, "b", "create", None, " Two ", "late"), ("17", 9, "c", "create", None, "one", None), ("18", 10, "b", "create", None, "  ", ""), ("19", 11, "b", None, "1", None, ""), ("20", 12, None, "move", "1", None, "x"), ("9", 0, "b", "move", "2", None, "sent before"),
    )
    sent = spark.createDataFrame([("9",), ("9",)], "request_id string")
    after, outbox = store.request_board_writes(items, requests, sent)
    assert {r.request_id: (r.item_id, r.error) for r in outbox.collect()} == {
        "10": ("1", None), "11": ("1", None), "12": ("1", None), "13": ("2", "the board has no such item"), "14": ("14", "an open item has this title"), "15": ("15", None), "16": ("16", "an open item has this title"),
        "17": ("17", None), "18": ("18", "a new item needs a title"), "19": ("1", "boards have no such write: "), "20": ("1", "the board has no such item"),
    }
    rows = {(r.board_id, r.id): (r.title, r.status, r.size) for r in after.collect()}
    assert rows == {("b", 1): ("One", "done", 5), ("b", 2): ("Two", "closed", 5), ("c", 1): ("Other", None, 5), ("b", 15): ("two", "new", None), ("c", 17): ("one", "", None)}
    assert after.columns == items.columns and outbox.filter("request_id = '15'").first().payload == '{"title":"two","status":"new"}'
    again, nothing = store.request_board_writes(after, requests, outbox.select("request_id").union(sent))
    assert nothing.isEmpty() and sorted(map(str, again.collect())) == sorted(map(str, after.collect())), "running again changes nothing"
    assert store.request_board_writes(items.limit(0), requests.limit(0), sent)[0].isEmpty()

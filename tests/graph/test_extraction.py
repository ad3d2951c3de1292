"""Java parsing, detection, resolution and the whole analysis on our own sources."""

import pytest
from pyspark.sql import functions as F

from meshlens.plans.analysis import analyze, analyze_files
from meshlens.sources import gallery, samples
from meshlens.functions.scalars import is_test_path
from meshlens.operators.detect import detect_entry_points, detect_producers
from meshlens.operators.resolve import call_edges
from meshlens.sources.extract import index, java_types
from meshlens.sources.files import flatten_yaml, load_config, parse_properties, scan_config_files, scan_source_files
from meshlens.sources.javaparse import parse_java


def _shop(spark):
    return samples.files(spark).filter(~is_test_path(F.concat(F.lit("/"), "path"))), load_config(samples.config_files(spark))


def _rules_index(spark):
    """The shop and one class for each detection rule."""
    one = lambda path, text: spark.createDataFrame([(*path, text)], "repo string, path string, content string")
    config = load_config(samples.config_files(spark).unionByName(one(*gallery.CONFIG)))
    return index(java_types(_shop(spark)[0].unionByName(one(gallery.FILE, gallery.SOURCE)))), config


def test_the_shop_gives_the_rows_written_by_hand(spark):
    idx = index(java_types(_shop(spark)[0]))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    by_hand = lambda want: sorted(map(tuple, want), key=str)
    assert rows(idx.types.select("repo", "file", "fqn", "kind", "line", F.array_join("supertypes", ","), F.size("methods"))) == by_hand(samples.TYPES)
    assert rows(idx.methods.select("repo", "method_key", "n_params", "has_body")) == by_hand(samples.method_rows())
    assert rows(call_edges(idx).select("caller", F.col("ord").cast("int"), "display", "arity", "callee", "callee_class", "callee_file", "callee_line", "ambiguous")) == by_hand(samples.call_rows())
    rules = _rules_index(spark)
    assert rows(detect_entry_points(*rules).select("id", "type", "channel", "line", "message_type", "method_type")) == by_hand([*samples.ENTRIES, *gallery.entry_rows()])
    assert rows(detect_producers(*rules).select("id", "type", "channel", "line", "message_type", "response_type")) == by_hand([*samples.PRODUCERS, *gallery.producer_rows()])


@pytest.fixture(scope="module")
def graph(spark):
    return analyze_files(*_shop(spark))


def test_parser_reads_members_and_calls():
    (outer, color, point) = parse_java(
        """package a.b; import x.*; import y.Z; // c
        @Ann(value = {"p", Q}, n = 5) class T<X extends Y<X>> extends G<A, B> implements I, J {
          static final String C = "c\\"v", D = "d"; Map<String, List<Q>> m = new HashMap<String, List<Q>>();
          T(Foo f) { init(f, 1); }
          <R> R run(@P final List<Foo> xs, int[] ys, String... more) throws E {
            Foo foo = new Foo(1, 2), bar; if (a < b && c > d) { foo.go(x -> x.deep(3), true, "s" + t, this.n, p.q); }
            wc.get().uri("/u/{id}", id).retrieve(); this.repo.save(xs); super.up(); return null;
          }
          enum Color { RED("r") { void z() { } }; String c() { return c; } }
          record Point(int a) { int sum() { return add(a); } }
        }"""
    )
    assert (outer["fqn"], outer["supertypes"], outer["explicit"], outer["wildcard"]) == ("a.b.T", ["G", "I", "J"], ["y.Z"], ["x"])
    assert outer["annotations"][0]["args"] == {"value": ["p", "Q"], "n": ["5"], "_raw": ["p", "Q", "5"]}
    assert [(f["name"], f["type"], f["constant"]) for f in outer["fields"]] == [("C", "String", 'c\\"v'), ("D", "String", "d"), ("m", "Map", None)]
    assert [m["name"] for m in outer["methods"]] == ["<init>", "run", "c", "sum"], "an outer type has its nested types' methods"
    run = outer["methods"][1]
    assert [(p["name"], p["type"], p["annotations"]) for p in run["params"]] == [("xs", "List", ["P"]), ("ys", "", [])]
    assert run["locals"] == {"foo": "Foo", "bar": "Foo"}
    calls = [(c["receiver"], c["method"], c["args"]) for c in run["calls"]]
    assert calls == [("foo", "go", ["this.n", "p.q"]), ("x", "deep", ["3"]), ("", "retrieve", []), ("", "uri", ["/u/{id}", "id"]), ("wc", "get", []), ("this.repo", "save", ["xs"]), ("", "up", [])]
    assert color["kind"] == "enum" and point["kind"] == "record"


@pytest.mark.parametrize("text", ["", "class", "class A {", "}}} class B { void x( }", "class C { int f = ; void ok() { a.b(; } }", "@", '"', "/* open", "class D { String s = \"unclosed\n void m() { } }"])
def test_parser_survives_broken_sources(text):
    parse_java(text)


def test_yaml_and_properties(spark):
    assert flatten_yaml("a:\n  b: 1\n  c:\n    d: 'x y'\n- skip: me\n# no\ne: \"q\"") == [("a.b", "1"), ("a.c.d", "x y"), ("e", "q")]
    assert flatten_yaml('a: x # y\nb: "one\n\tc:\n  - d: e\nf:\n\tg: h') == [("a", "x # y"), ("b", "one"), ("g", "h")]
    lines = spark.createDataFrame([("\ttab = \u00a0v \x0b\r\n ! no=1\rcolon: a=b\x0cnone",)], "content string")
    assert [(r.key, r.value) for r in parse_properties(lines).orderBy("ord").collect()] == [("tab", "v"), ("colon: a", "b")]
    config = {r.key: r.value for r in load_config(samples.config_files(spark)).collect()}
    assert config == {"app.topic": "order-in", "mp.messaging.incoming.in.topic": "jobs"}


def test_entry_points(graph):
    got = {r.id: r for r in graph.entry_points.collect()}
    want = {
        "order:OrderController.get:/api/orders/{id}": "rest-endpoint", "order:OrderController.create:/api/orders": "rest-endpoint", "order:OrderController.on:order-in": "kafka-consumer",
        "order:OrderController.sweep:0 0 * * * *": "scheduled-task", "order:Tool.main:main": "main", "stock:StockController.stock:/api/stock/{id}": "rest-endpoint", "stock:Listener.on:orders.out": "kafka-consumer",
        "stock:Handler.handle:com.acme.stock.Shipped": "message-handler", "stock:StockService.reserve:/StockService/reserve": "grpc-service", "stock:Routes.configure:shipments": "kafka-consumer", "stock:Quarkus.run:jobs": "reactive-incoming",
    }
    assert {k: r.type for k, r in got.items()} == want
    assert got["order:OrderController.on:order-in"].thin and not got["order:OrderController.create:/api/orders"].thin
    assert got["order:OrderController.create:/api/orders"].method_type == "POST"


def test_producers(graph):
    got = {r.id: (r.type, r.channel, r.message_type) for r in graph.producers.collect()}
    assert got == {
        "order:OrderServiceImpl.place:send:kafka": ("kafka-producer", "orders.out", "OrderPlaced"), "order:OrderServiceImpl.place:http:/api/stock/12": ("http-call", "/api/stock/12", "GET"),
        "order:OrderServiceImpl.place:send:jms": ("jms-producer", "legacy", ""), "order:OrderServiceImpl.place:grpc:StockService/reserve": ("grpc-call", "/StockService/reserve", "StockServiceBlockingStub"),
        "order:OrderServiceImpl.find:http:/api/stock/{id}": ("http-call", "/api/stock/{id}", "GET"), "stock:Listener.on:publish:bus:com.acme.stock.Shipped": ("message-bus-producer", "com.acme.stock.Shipped", "com.acme.stock.Shipped"),
        "stock:Routes.configure:to:done": ("jms-producer", "done", ""), "stock:Quarkus.run:outgoing:out": ("unknown", "out", "Done"), "stock:Quarkus.go:emitter:emits": ("unknown", "emits", ""),
    }


def test_links_trees_and_dead_code(graph):
    links = {(r.channel, r.kind, r.side, r.id) for r in graph.members.collect()}
    assert ("orders.out", "message", "consumer", "stock:Listener.on:orders.out") in links
    assert ("/StockService/reserve", "grpc", "producer", "order:OrderServiceImpl.place:grpc:StockService/reserve") in links
    assert {k for c, k, *_ in links if c == "/api/stock/12"} == {"http"}
    tree = [(r.path, r.method, r.confidence) for r in graph.nodes.filter("ep_id = 'order:OrderController.create:/api/orders'").orderBy("path").collect()]
    assert tree[:2] == [([], "OrderController.create", "EXTRACTED"), ([0], "service.place", "EXTRACTED")]
    assert ([0, 0, 0], "d.check", "INFERRED") in tree and any(m == "audit" and c == "EXTRACTED" for _, m, c in tree), "inherited methods are found up the hierarchy"
    dead = {r.id for r in graph.unreachable.collect()}
    assert sorted(map(tuple, graph.unreachable.select("id", "repo", "class_name", "method", "file", "line").collect())) == sorted(samples.unreachable_rows())
    assert dead == {"order:OrderServiceImpl.dead", "order:Boot.main", "stock:Quarkus.go"} | ({"order:Tool.work"} & dead)
    assert graph.methods_total == 21


def test_scan_of_folders(spark, tmp_path):
    for (repo, path), text in samples.SHOP.items():
        target = tmp_path / repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "order/target/classes").mkdir(parents=True)
    (tmp_path / "order/target/classes/Gone.java").write_text("class Gone { }")
    (tmp_path / "order/target/generated-sources").mkdir(parents=True)
    (tmp_path / "order/target/generated-sources/Kept.java").write_text("class Kept { }")
    (tmp_path / "order/application.properties").write_text("app.topic=order-in")
    roots = {r: str(tmp_path / r) for r in ("order", "stock")}
    paths = {(r.repo, r.path) for r in scan_source_files(spark, roots).select("repo", "path").collect()}
    assert ("order", "/target/generated-sources/Kept.java") in paths and ("order", "/src/OrderController.java") in paths
    assert not any("Gone" in p or "Test" in p for _, p in paths)
    assert scan_config_files(spark, roots).count() == 1
    graph = analyze(spark, roots)
    assert graph.entry_points.filter(F.col("channel") == "order-in").count() == 1


@pytest.fixture(scope="module")
def found(spark):
    """What each class of the gallery gives: entry points and producers by class."""
    rules = _rules_index(spark)
    entries = [tuple(r) for r in detect_entry_points(*rules).filter("repo = 'gallery'").select("id", "type", "channel", "line", "message_type", "method_type").collect()]
    producers = [tuple(r) for r in detect_producers(*rules).filter("repo = 'gallery'").select("id", "type", "channel", "line", "message_type", "response_type").collect()]
    return entries, producers


@pytest.mark.parametrize("line", range(2, len(gallery.SAMPLES) + 2), ids=[s.name for s in gallery.SAMPLES])
def test_each_rule_takes_its_class_and_nothing_else(found, line):
    for got, want in zip(found, (gallery.entry_rows(), gallery.producer_rows()), strict=True):
        assert sorted(r for r in got if r[3] == line) == sorted(r for r in want if r[3] == line)


def test_every_rule_has_a_class():
    """Annotations, supertypes and senders of the rule tables that stand for a kind of their own occur in the gallery."""
    from meshlens.operators import detect

    text = gallery.SOURCE
    for names in (detect.CONSUMERS, detect.REST_VERBS, detect.EVENTS, detect.WEBSOCKETS, detect.SOCKET_METHODS, detect.LIFECYCLE, detect.LIFECYCLE_METHODS, detect.GRAPHQL, detect.FUNCTIONS, detect.AXON):
        missing = [n for n in names if n not in text]
        assert not missing, missing
    kinds = {r[1] for r in gallery.entry_rows()} | {r[1] for r in gallery.producer_rows()}
    assert kinds >= {kind for kind, _ in detect.CONSUMERS.values()} | {kind for kind, *_ in detect.SENDERS.values()}

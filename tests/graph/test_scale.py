"""Where work is done, not what comes of it: how many tasks share it, and what is sent to the driver."""

import pytest

from meshlens.plans.adapter import part_sources
from meshlens.plans.fixpoint import cut
from meshlens.sources import syntax
from meshlens.sources.extract import index, java_types

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("read", [java_types, syntax.syntax_nodes])
def test_reading_java_is_dealt_over_tasks_however_few_bytes_its_table_has(spark, read):
    files = part_sources(spark, SF).coalesce(1)
    assert files.rdd.getNumPartitions() == 1
    assert read(files).rdd.getNumPartitions() > 4


def test_nodes_and_types_made_of_few_bytes_are_not_sent_to_the_driver(spark):
    nodes = cut(syntax.syntax_nodes(part_sources(spark, SF)))
    for found in (syntax.call_sites(nodes), syntax.symbols(nodes), syntax.imports(nodes)):
        assert "Broadcast" not in plan(found)
    assert "Broadcast" not in plan(index(java_types(part_sources(spark, SF))).scanned)


def test_rows_of_one_file_fill_several_batches(spark, monkeypatch):
    from meshlens.sources import extract

    monkeypatch.setattr(extract, "BATCH_ROWS", 3)
    import pyarrow as pa

    read = [(5, [{"k": n} for n in range(8)]), (0, []), (5, [{"k": 9}])]
    batches = list(extract.batched(iter(read), pa.schema([("k", pa.int64())])))
    assert [b.num_rows for b in batches] == [3, 3, 2, 1]
    assert [k for b in batches for k in b.column(0).to_pylist()] == [*range(8), 9]


def test_a_wildcard_meets_its_package_and_not_all_types_of_the_name(spark):
    """1000 types of one name in as many packages: a question is about one of them."""
    from pyspark.sql import functions as F

    from meshlens.operators.resolve import find_class, resolve_fqn
    from meshlens.sources.extract import JavaIndex

    n = F.col("id").cast("string")
    types = spark.range(1000).select(F.concat(F.lit("k"), n).alias("key"), F.lit("T").alias("simple_name"), F.concat(F.lit("p"), n).alias("package"), F.concat(F.lit("p"), n, F.lit(".in.T")).alias("fqn"), F.array().cast("array<string>").alias("explicit"), F.array(F.concat(F.lit("p"), ((F.col("id") + 1) % 1000).cast("string"))).alias("wildcard"), F.lit("class").alias("kind"), n.alias("ord"))
    idx = JavaIndex(types, types, None, None, None)
    asked = types.select("key", F.lit("T").alias("simple"))
    for df, column, want in ((find_class(idx, asked), "target", "k8"), (resolve_fqn(idx, asked), "fqn", "p8.in.T")):
        assert df.count() == 1000
        assert df.filter("key = 'k7'").first()[column] == want
        assert "[simple_name" not in "".join(line for line in plan(df).split("\n") if "Join [" in line and "startswith" in line.lower())
        assert "StartsWith" not in plan(df)


def test_questions_about_trees_deal_them_once(spark):
    from meshlens.operators import diff, tree

    nodes = spark.createDataFrame([("e", [], "A.on", "a", 1), ("e", [0], "b", "b", 1), ("e", [0, 1], "A.ship", "c", 1), (None, [], "x.on", "a", 1), (None, [0], "x.ship", "b", 1)], "ep_id string, path array<int>, method string, file string, line int")
    dealt = lambda df: plan(df).count("Exchange ")
    asked = tree.trace_path(nodes, ".on", "ship")
    assert dealt(asked) == 1
    assert [tuple(r) for r in asked.collect()] == [("e", "A.on > b > A.ship", [], [0, 1])]
    asked = tree.node_relations(nodes)
    assert dealt(asked) == 1
    assert sorted(tuple(r)[1:] for r in asked.filter("ep_id = 'e'").collect()) == [([], "A.on", None, 1, 0), ([0], "b", "A.on", 1, 0), ([0, 1], "A.ship", "b", 0, 0)]
    asked = diff.node_diff(nodes.filter("method <> 'b'"), nodes)
    assert dealt(asked) == 1
    assert sorted((r.method, r.is_new) for r in asked.collect()) == [("A.on", False), ("A.ship", False), ("b", True), ("x.on", True), ("x.ship", True)]


def test_listeners_are_ranked_where_their_customers_are(spark):
    from meshlens.plans import adapter

    assert plan(adapter.tree_nodes(spark, SF)).count("Exchange hashpartitioning") == 3  # lines by order, orders and customers by customer


def test_changes_by_repository_read_each_graph_once(spark):
    """A repository comes with its entry point's status: both graphs' entry points meet once."""
    from meshlens.operators import diff
    from meshlens.plans.relations import GraphRelations

    ddl = "id string, ord string, repo string, depth int, total_nodes int, unique_files int, extra string"
    side = lambda *rows: GraphRelations(spark.createDataFrame([(i, i, r, d, 1, 1, "x") for i, r, d in rows], ddl), None, None, spark.createDataFrame([], "ep_id string, path array<int>, method string, file string, line int"), None, None)
    got = diff.diff_repo_counts(side(("gone", "a", 1), ("same", "a", 1), ("more", "b", 1)), side(("same", "a", 1), ("more", "c", 2), ("made", "c", 1)))
    assert plan(got).count("Join ") == 2  # trees of each side
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 1, 0), ("c", 1, 0, 1)]


def test_links_are_asked_of_ends_without_their_trees(spark):
    from meshlens.plans import adapter

    g = adapter.linked(spark, SF)
    assert g.entry_points.columns == list(adapter.LINK_ENTRY) and g.producers.columns == list(adapter.LINK_PRODUCER)
    assert "l_suppkey" not in plan(adapter.entry_points(spark, SF).select(*adapter.LINK_ENTRY))


def test_calls_are_resolved_without_broadcasts(spark, monkeypatch):
    """Spark guesses the size of what is made of types from the table of parts, and would send it to the driver."""
    from meshlens.operators import resolve

    plans = []
    monkeypatch.setattr(resolve, "cut", lambda df: plans.append(plan(df)) or cut(df))
    plans.append(plan(resolve.call_edges(index(java_types(part_sources(spark, SF))))))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_unreachable_methods_are_asked_of_calls_alone(spark, monkeypatch):
    """No call trees, channels, producers or links are made for them, and the whole analysis gives the same."""
    from meshlens.plans import analysis, catalogue_sources

    whole = analysis.analyze_files(part_sources(spark, SF)).unreachable
    for made in ("call_tree", "tree_metrics", "call_edges", "detect_entry_points", "detect_producers", "all_links"):
        monkeypatch.setattr(analysis, made, lambda *a: 1 / 0)
    alone = catalogue_sources.java_graph_unreachable(spark, SF)
    assert "Broadcast" not in plan(alone)
    assert alone.count() > 0 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, alone.collect()))


def test_ends_are_dealt_once_to_find_message_links(spark):
    """Which repositories hear and send on a channel is told by a row each; wide rows are dealt to meet these, once."""
    from meshlens.operators import links

    rows = [("e1", "a", "kafka-consumer", "t"), ("e2", "b", "kafka-consumer", "t"), ("e3", "a", "kafka-consumer", "own"), ("e4", None, "kafka-consumer", "n")]
    sent = [("p1", "a", "kafka-producer", "t"), ("p2", "a", "kafka-producer", "own"), ("p3", None, "kafka-producer", "n"), ("p4", "a", "kafka-producer", "far")]
    table = lambda rows: spark.createDataFrame([(i, *r) for i, r in zip("abcdefgh", rows, strict=False)], "ord string, id string, repo string, type string, channel string")
    found = links.link_message(table(rows), table(sent))
    assert plan(found).count("Exchange ") <= 4
    assert sorted((r.channel, r.side, r.id) for r in found.collect()) == [("n", "consumer", "e4"), ("n", "producer", "p3"), ("t", "consumer", "e1"), ("t", "consumer", "e2"), ("t", "producer", "p1")]


def test_what_changed_is_told_where_entries_and_trees_are(spark):
    """Entry points and trees of a graph that is dealt by customers meet there, and so do both graphs' entry points: nothing is dealt by id."""
    from meshlens.operators import diff
    from meshlens.plans import adapter, catalogue

    old, new = adapter.changing(spark, SF, adapter.OLD), adapter.changing(spark, SF, adapter.NEW)
    found = diff.diff_entries(old, new)
    assert plan(found).count("Join ") == plan(old.nodes).count("Join ") * 4  # none but those that make them
    assert plan(found).count("Exchange hashpartitioning") == 4 * plan(old.nodes).count("Exchange hashpartitioning")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, catalogue.diff_entries(spark, SF).collect()))

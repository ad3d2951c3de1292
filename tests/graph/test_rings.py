"""Components, cycles and flows in graphs with circles, against plain searches."""

import random
import re

from pyspark.sql import functions as F

from meshlens.operators import components, flows, views


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def adjacency(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def plain_components(pairs):
    edges, nodes = adjacency(pairs), {n for p in pairs for n in p}
    far = {n: reached(edges, n) for n in nodes}
    return {n: min([n, *(m for m in far[n] if n in far[m])]) for n in nodes}


def plain_cycles(pairs):
    edges, found = adjacency(pairs), []

    def walk(path):
        for b in edges.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                found.append((*path, b))
            elif b > path[0] and b not in path:
                walk([*path, b])

    for n in edges:
        walk([n])
    return sorted(found)


def some_pairs(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


def test_components_and_cycles_equal_plain_searches(spark):
    pairs = some_pairs(4, 40, 55) + [(100 + i, 100 + (i + 1) % 6) for i in range(6)] + [(50, 51), (51, 50), (51, 60)]  # random, a circle, a pair with a tail
    df = spark.createDataFrame([*pairs, pairs[0], (None, 3)], "src int, dst int")
    assert dict(map(tuple, components.strong_components(df).collect())) == plain_components(pairs)
    assert sorted(tuple(r.path) for r in components.elementary_cycles(df).collect()) == plain_cycles(pairs)
    assert components.elementary_cycles(df, longest=2).count() == sum(len(c) == 3 for c in plain_cycles(pairs))


def test_colours_find_what_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(components, "PAIRS", 0)  # too many pairs always
    pairs = [(a, b) for a in range(5) for b in range(5) if a != b] + [(5, 0), (4, 6), (6, 7), (7, 6)]
    assert dict(map(tuple, components.strong_components(spark.createDataFrame(pairs, "src int, dst int")).collect())) == plain_components(pairs)


def test_a_long_chain_of_small_components_takes_few_rounds(spark, monkeypatch):
    n, rounds = 2000, []
    own = components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or own(df))
    pairs = [(3 * i + j, 3 * i + (j + 1) % 3) for i in range(n) for j in range(3)] + [(3 * i + 2, 3 * i + 3) for i in range(n - 1)]
    got = components.strong_components(spark.createDataFrame(pairs, "src int, dst int")).groupBy("component").count()
    assert got.count() == n and got.filter("count <> 3").isEmpty()
    assert len(rounds) < 60  # the chain is 6000 nodes deep


def test_sizes_that_spark_expects_do_not_grow_with_the_rounds(spark, capsys):
    pairs = [(i, (i + 1) % 12) for i in range(12)] + [(2, 9), (5, 3), (7, 1), (10, 6), (20, 21), (21, 20)]
    df = spark.createDataFrame(pairs, "src int, dst int")
    for found in (components.strong_components(df), components.elementary_cycles(df)):
        capsys.readouterr()
        found.explain("cost")
        sizes = re.findall(r"sizeInBytes=([0-9.]+)(?:E\+?([0-9]+))?", capsys.readouterr().out)
        assert sizes and max(int(digits or 0) for _, digits in sizes) < 40  # guesses that are multiplied each round have thousands of digits
    assert sorted(tuple(r.path) for r in found.collect()) == plain_cycles(pairs)


def test_graphs_without_nodes_or_cycles(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(empty).collect() == [] and components.elementary_cycles(empty).collect() == []
    loop = spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string")
    assert sorted(map(tuple, components.strong_components(loop).collect())) == [("a", "a"), ("b", "b")]
    assert components.elementary_cycles(loop).collect() == []


def test_flows_by_fixpoint_equal_flows_by_paths(spark):
    rng = random.Random(9)
    hops = [(f"e{a}", f"e{b}", f"r{a % 4}", f"r{b % 4}", f"c{b}", rng.choice(["http", "message"]), "", "") for a, b in some_pairs(11, 9, 22)]
    df = spark.createDataFrame(hops, "src string, dst string, src_repo string, dst_repo string, channel string, kind string, verb string, response_type string")
    origins = spark.createDataFrame([(f"flow:e{k}", f"e{k}", f"r{k % 4}") for k in (0, 3, 5)], "flow_id string, id string, repo string")
    steps = views.detect_flows(origins, df).cache()
    entries = flows.flow_entries(origins, df)
    want = {(r.flow_id, r.entry_id, r.repo, r.depth) for r in steps.groupBy("flow_id", "entry_id", "repo").agg(F.min("depth").alias("depth")).collect()}
    assert {tuple(r) for r in entries.select("flow_id", "entry_id", "repo", "depth").collect()} == want
    taken = flows.hops_taken(entries, df)
    by_paths = steps.filter("depth > 0").select("flow_id", F.element_at("path", -2).alias("src"), F.col("entry_id").alias("dst"), "kind").distinct().collect()
    assert {(r.flow_id, r.src, r.dst, r.kind) for r in taken.collect()} == set(map(tuple, by_paths))
    sync = {r.flow_id for r in by_paths if r.kind == "http"}
    assert {(r.flow_id, r.has_sync) for r in flows.reach_metrics(entries, taken).collect()} == {(f"flow:e{k}", f"flow:e{k}" in sync) for k in (0, 3, 5)}


def test_a_dense_graph_is_answered_without_its_paths(spark):
    pairs = [(a, b) for a in range(200) for b in range(a + 1, min(a + 8, 200))] + [(b, b - 5) for b in range(5, 200)]
    hops = spark.createDataFrame([(f"e{a}", f"e{b}", f"r{a % 7}", f"r{b % 7}", f"c{b}", "message", "", "") for a, b in pairs], "src string, dst string, src_repo string, dst_repo string, channel string, kind string, verb string, response_type string")
    origins = spark.createDataFrame([("flow:e0", "e0", "r0")], "flow_id string, id string, repo string")
    entries = flows.flow_entries(origins, hops)
    taken = flows.hops_taken(entries, hops)
    got = {(r.src, r.dst) for r in taken.collect()}
    edges = adjacency(pairs)
    want = {(f"e{a}", f"e{b}") for a, b in pairs if b != 0 and (a == 0 or a in reached({x: ys - {b} for x, ys in edges.items() if x != b}, 0))}
    assert got == want
    assert flows.downstream(taken, "r1").count() > 0 and flows.repo_nodes(entries).count() == 7

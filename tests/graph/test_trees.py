"""Trees put together of their callees' own trees, against walks from each root."""

import random

from meshlens.operators import tree

CALLS = "caller string, ord bigint, display string, arity int, callee string, callee_class string, callee_file string, callee_line int, ambiguous boolean"
ROOTS = "ep_id string, key string, method string, class_name string, file string, line int"


def graph(rng, n, most):
    """Calls of any shape: circles, targets at several depths, unresolved and ambiguous ones."""
    calls = []
    for k in range(n):
        for o in range(rng.randint(0, most)):
            to = rng.randrange(n)
            calls.append((f"m{k}", o, f"x.m{to}", 1, *((f"m{to}", "C", "f", to, rng.random() < 0.2) if rng.random() < 0.8 else (None, None, None, None, False))))
    return calls


def near_all(calls, root, max_depth, max_nodes):
    once, group = set(), [("e", None, -1, "on", 0, root, "R", "f", 0, False)]
    for c in calls:
        if (c[0], c[4] or c[2]) not in once:
            once.add((c[0], c[4] or c[2]))
            group.append(("e", *c))
    return tree._expanded(group, max_depth, max_nodes)


def test_general_trees_are_those_of_a_walk_from_each_root(spark):
    rng = random.Random(5)
    calls, roots = [], []
    for g, (n, most) in enumerate([(6, 3), (30, 4), (60, 9), (200, 12), (400, 30), (90, 90)]):
        calls += [(f"{g}{c[0]}", *c[1:4], c[4] and f"{g}{c[4]}", *c[5:]) for c in graph(rng, n, most)]
        calls = [(c[0], c[1], f"{g}{c[2]}" if c[0].startswith(str(g)) and not c[2].startswith(str(g)) else c[2], *c[3:]) for c in calls]
        roots += [(f"e{g}.{k}", f"{g}m{k}", "on", "R", "f", 0) for k in range(min(n, 40))]
    for max_depth, max_nodes in ((4, 50), (3, 12), (2, 5)):
        got = {}
        for r in tree.call_tree(spark.createDataFrame(roots, ROOTS), spark.createDataFrame(calls, CALLS), max_depth, max_nodes).collect():
            got.setdefault(r.ep_id, []).append((tuple(r.path), *tuple(r)[2:]))
        for ep, key, *_ in roots:
            own = [c for c in calls if c[0][0] == key[0]]
            want = [(tuple(n[1]), *n[2:]) for n in near_all(own, key, max_depth, max_nodes)]
            assert sorted(got[ep]) == sorted(want), (ep, max_depth, max_nodes)


def test_calls_near_a_method_are_fetched_once_for_all_roots_that_call_it(spark, monkeypatch):
    """300 roots call one method whose own tree fills theirs: calls near them are fetched for that one, not for each root."""
    calls = [(f"r{k}", o, f"x.{to}", 1, to, "C", "f", 1, False) for k in range(300) for o, to in enumerate(("hub", "late"))]
    calls += [("hub", o, f"x.h{o}", 1, f"h{o}", "C", "f", 1, False) for o in range(60)]
    near, asked = tree._near, []
    monkeypatch.setattr(tree, "_near", lambda entries, *a: asked.append(entries) or near(entries, *a))
    rows = tree.call_tree(spark.createDataFrame([(f"e{k}", f"r{k}", "on", "R", "f", 0) for k in range(300)], ROOTS), spark.createDataFrame(calls, CALLS))
    assert rows.count() == 300 * 50 and rows.filter("method = 'x.late'").isEmpty()
    assert sum(entries.count() for entries in asked) == 2  # hub and late


def test_layered_trees_are_made_of_own_trees_and_written_nowhere(spark, monkeypatch):
    rng = random.Random(7)
    layers, edges = [[f"{d}.{k}" for k in range(n)] for d, n in enumerate((40, 12, 25, 6, 3))], []
    for upper, lower in zip(layers, layers[1:], strict=False):
        edges.append([(a, b, p) for a in upper for p, b in enumerate(rng.sample(lower, rng.randint(0, len(lower))))])
    tables = [spark.createDataFrame(e, "caller string, callee string, pos int") for e in edges]
    roots = spark.createDataFrame([(f"e{a}", a) for a in layers[0]] + [("none", "x")], "ep_id string, node string")
    if hasattr(tree, "cut"):
        monkeypatch.setattr(tree, "cut", lambda df: 1 / 0)
    calls = {}
    for a, b, p in (x for e in edges for x in e):
        calls.setdefault(a, []).append((p, b))
    for max_nodes in (50, 9, 1):
        got = {}
        for r in tree.layered_tree(roots, tables, max_nodes=max_nodes).collect():
            got.setdefault(r.ep_id, []).append((r["rank"], r.node, tuple(r.path), r.depth))
        for ep, root in [(f"e{a}", a) for a in layers[0]] + [("none", "x")]:
            want, seen = [], set()

            def go(node, path):
                if node in seen or len(want) >= max_nodes:
                    return
                seen.add(node)
                want.append((len(want) + 1, node, path, len(path)))
                for p, b in sorted(calls.get(node, ())):
                    go(b, (*path, p))

            go(root, ())
            assert sorted(got[ep]) == want, (ep, max_nodes)


def test_general_trees_come_with_their_ranks_and_own_trees_are_made_once(spark):
    """Python walks own trees, once; roots' trees are put together of them by expressions, in order, so that no window ranks their nodes."""
    rng = random.Random(11)
    roots = spark.createDataFrame([(f"e{k}", f"m{k}", "on", "R", "f", 0) for k in range(30)], ROOTS)
    rows = tree.ranked_call_tree(roots, spark.createDataFrame(graph(rng, 30, 4), CALLS))
    trees = {}
    for r in rows.collect():
        trees.setdefault(r.ep_id, []).append((r["rank"], tuple(r.path)))
    assert len(trees) == 30 and all([p for _, p in sorted(t)] == sorted(p for _, p in t) and sorted(k for k, _ in t) == list(range(1, len(t) + 1)) for t in trees.values())
    calls = [(f"m{k}", o, f"x.h{k}.{o}", 1, f"h{k}.{o}", "C", "f", 1, False) for k in range(30) for o in range(3)]
    plan = tree.ranked_call_tree(roots, spark.createDataFrame(calls, CALLS))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan

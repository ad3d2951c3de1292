"""Syntax trees, upkeep by digests, trigram search and languages of names."""

import random

import pytest
from pyspark.sql import functions as F

from meshlens.operators import textindex
from meshlens.plans.refresh import SourceStore, folder_contents, folder_listing
from meshlens.sources import syntax
from meshlens.sources.extract import java_types
from meshlens.sources.files import language_for_file

SOURCE = """package a.b;
import java.util.*;
import static x.y.Z.of;
import Plain;
@Service @Named(value = {"p", "q"})
public final class T<X extends Y> extends G implements I {
  private final List<X> xs = make(1), ys = new ArrayList<X>(3);
  T(Foo f) { super(f); init(f).go(); }
  @Get("/x") public <R> R run(int[] n) throws E { this.repo.save(n); repo.find(of(n)).last(); a.b.C.stat(); return new Other(n) { void inner() { deep(); } }; }
  enum Color { RED(1), BLUE(two()); Color(int n) { } }
  record Point(int x) { int sum() { return add(x); } }
  interface Go { void go(); default int much() { return "s".length(); } }
}
"""


def files(spark, *texts):
    return spark.createDataFrame([("r", f"{k}.java", t) for k, t in enumerate(texts)], "repo string, path string, content string")


def test_records_of_a_source_written_by_hand(spark):
    nodes = syntax.syntax_nodes(files(spark, SOURCE)).cache()
    found = {(r.kind, r.name, r.line) for r in syntax.symbols(nodes).collect()}
    assert found == {
        ("class", "T", 5), ("constructor", "T", 8), ("method", "run", 9), ("method", "inner", 9), ("enum", "Color", 10), ("constructor", "Color", 10),
        ("record", "Point", 11), ("method", "sum", 11), ("interface", "Go", 12), ("method", "go", 12), ("method", "much", 12),
    }
    assert {(r.module, r.line) for r in syntax.imports(nodes).collect()} == {("java.util", 2), ("x.y.Z.of", 3)}
    calls = sorted((r.target, r.receiver, r.caller, r.line) for r in syntax.call_sites(nodes).collect())
    assert calls == sorted([
        ("make", "", "T", 7), ("init", "", "T", 8), ("go", "", "T", 8), ("save", "", "run", 9), ("find", "repo", "run", 9), ("of", "", "run", 9), ("last", "", "run", 9), ("stat", "", "run", 9),
        ("Other", "", "run", 9), ("deep", "", "inner", 9), ("two", "", "Color", 10), ("add", "", "sum", 11), ("length", "", "much", 12),
    ])


def test_numbers_nest(spark):
    rows = syntax.syntax_nodes(files(spark, SOURCE)).orderBy("pre").collect()
    assert [r.pre for r in rows] == list(range(len(rows))) and sorted(r.post for r in rows) == list(range(len(rows)))
    for a in rows:
        for b in rows:
            assert (a.pre in b.ancestors) == (a.pre < b.pre and a.post > b.post)
        assert a.depth == len(a.ancestors) and a.parent == (a.ancestors[-1] if a.ancestors else None)


def test_descendants_by_pattern(spark):
    nodes = syntax.syntax_nodes(files(spark, SOURCE)).cache()
    pattern = syntax.Node("method_declaration", below=(syntax.Node("identifier", "name", "owner"), syntax.Node("object_creation_expression", keep="made", deep=True)))
    assert [(r.owner.text, r.made.line) for r in syntax.matches(nodes, pattern).collect()] == [("run", 9)]


@pytest.mark.parametrize("text", [None, "", "class", "class A {", "}}} class B { void x( }", "class C { int f = ; void ok() { a.b(; } }", "@", "new new (", "import", "a.b.(c).d()", ").x()", "enum E { A(", "x.y.z()" * 50])
def test_broken_sources_have_what_can_be_told(spark, text):
    rows = list(syntax.Tree(text or "").nodes())
    assert sorted(r["post"] for r in rows) == list(range(len(rows)))


def test_refresh_equals_a_full_reading_and_reads_what_changed_only(spark, tmp_path):
    rng = random.Random(1)
    state = {("r1", f"A{k}.java"): f"package p; class A{k} {{ void m{k}() {{ }} }}" for k in range(12)}
    store = SourceStore(spark, str(tmp_path / "store"))
    assert store.types().collect() == [] and store.version() == 0
    before = {}
    for turn in range(3):
        now = spark.createDataFrame([(*k, v) for k, v in state.items()], "repo string, path string, content string")
        asked = []

        def contents(changed, now=now, asked=asked):
            asked += [(r.repo, r.path) for r in changed.collect()]
            return now.join(changed, ["repo", "path"], "left_semi")

        assert store.refresh(now.select("repo", "path", F.md5("content").alias("digest")), contents) == turn + 1
        assert sorted(asked) == sorted(k for k, v in state.items() if before.get(k) != v)
        want = java_types(now).select("repo", "file", "fqn", F.to_json("methods").alias("m"))
        assert sorted(map(tuple, store.types().select("repo", "file", "fqn", F.to_json("methods").alias("m")).collect())) == sorted(map(tuple, want.collect()))
        before = dict(state)
        for k in rng.sample(sorted(state), 4):  # edits, removals and new files
            state[k] = state[k].replace("void", "int") if rng.random() < 0.6 else state.pop(k) and ""
            if not state[k]:
                del state[k]
        state[("r2", f"N{turn}.java")] = f"class N{turn} {{ }}"
    assert store.types(1).count() == 12, "older versions stay readable"
    listing = spark.createDataFrame([(*k, v) for k, v in before.items()], "repo string, path string, content string").select("repo", "path", F.md5("content").alias("digest"))
    assert store.refresh(listing, lambda changed: 1 / 0) == 3, "nothing changed: nothing is read"


def test_refresh_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in "AB":
        (tmp_path / f"src/{name}.java").write_text(f"class {name} {{ }}")
    store = SourceStore(spark, str(tmp_path / "store"))
    roots, contents = {"r": str(tmp_path / "src")}, folder_contents(spark, most=1)
    store.refresh(folder_listing(spark, roots), contents)
    (tmp_path / "src/B.java").write_text("class B { void more() { } }")
    (tmp_path / "src/C.java").write_text("class C { }")
    assert store.refresh(folder_listing(spark, roots), contents) == 2
    assert {(r.simple_name, len(r.methods)) for r in store.types().collect()} == {("A", 0), ("B", 1), ("C", 0)}
    assert {r.parsed for r in store.files().collect()} == {1, 2}


def test_trigram_search_equals_a_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "ab", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    index = textindex.TextIndex.build(rows)
    for wanted in ("aba", "ABBA", "b\na", "é a", "ab", "", "zzz", "abababab"):
        got = index.search(wanted)
        assert sorted(r.n for r in got.collect()) == [n for n, t in enumerate(texts) if t is not None and wanted.lower() in t.lower()]
        assert got.columns == ["n", "text"]
    assert index.candidates("abba").count() < 100
    assert textindex.TextIndex.build(rows.limit(0)).search("abc").count() == 0


def test_rows_of_a_block_share_their_trigrams(spark, tmp_path):
    """1000 texts that differ in their numbers: fewer rows of trigrams than the texts have, and searches find them all."""
    rows = spark.range(0, 1000, 1, 2).select("id", F.concat(F.lit("R1:Customer.on:Part-"), "id").alias("text"))
    index = textindex.TextIndex.build(rows, str(tmp_path / "index"))
    alone = rows.select(F.explode(textindex.grams(F.lower("text")))).count()
    assert spark.read.parquet(f"{index.path}/grams").count() * 4 < alone
    assert sorted(r.id for r in index.search("PART-12").collect()) == [12, *range(120, 130)]
    assert index.search("customer").count() == 1000 and index.candidates("part-999").count() == 1


def test_languages_of_names(spark):
    registry = [("ts", ".ts", False), ("dts", ".d.ts", False), ("make", "Makefile", True), ("kts", ".gradle.kts", False), ("a", ".dup", False), ("b", ".dup", False)]
    names = {"x/a.ts": "ts", "a.d.ts": "dts", "A.D.TS": "dts", "a.b.d.ts": "ts", "Makefile": "make", "d/Makefile": "make", "makefile": None, ".ts": None, "..x.ts": "ts", "b.gradle.kts": "kts", "a.kts": None, "n.dup": "a", "": None, "none": None, "dot.": None}
    df = spark.createDataFrame([(k,) for k in names] + [("a.d.ts",), (None,)], "path string")
    got = language_for_file(df, spark.createDataFrame(registry, "tag string, key string, special boolean"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [*names.items(), ("a.d.ts", "dts"), (None, None)]))


def test_progress_stream_ends_as_the_table_and_never_falls(spark, tmp_path):
    from meshlens.streaming import progress

    lines = [("a", 1, "[clone] x ready at /x"), ("a", 2, "[clone] Using local repo y"), ("a", 3, "[scan] x: scanning 3"), ("a", 4, "[index] 5/10"), ("a", 5, "[index] 10/10"), ("a", 6, "[graph] 1/4"), ("a", 7, "[graph] 3/4"), ("a", 8, "[graph] x/0"),
             ("b", 1, "[clone] x ready at /x"), ("c", 1, "hello"), ("d", 1, "[index] 1/2"), ("d", 2, "[DONE] all"), (None, 1, "[analyze] 1/2"), ("e", None, "[detect] 1/0")]
    ddl = "run_id string, ord bigint, message string"
    order = [6, 3, 9, 7, 0, 4, 12, 10, 5, 13, 2, 11, 1, 8, 6, 0, 3]  # late and twice
    for k in range(0, len(order), 4):
        spark.createDataFrame([lines[i] for i in order[k : k + 4]], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "logs"))
    got = progress.run_progress(spark, str(tmp_path / "logs"), str(tmp_path / "told"), str(tmp_path / "state"), repo_total=4)
    repos = spark.createDataFrame([(r, 4) for r in "abcde"], "run_id string, repo_total int")
    whole = progress.ingest_progress(progress.phase_fractions(spark.createDataFrame([x for x in lines if x[0]], ddl)), repos)
    assert {tuple(r) for r in got.filter("run_id IS NOT NULL").drop("best").collect()} == {tuple(r) for r in whole.collect()}
    told = spark.read.parquet(str(tmp_path / "told")).orderBy("batch").collect()
    for run in "abcde":
        bests = [r.best for r in told if r.run_id == run]
        assert bests == sorted(bests)
    again = progress.run_progress(spark, str(tmp_path / "logs"), str(tmp_path / "told"), str(tmp_path / "state"), repo_total=4)
    assert again.count() == got.count(), "a stream that goes on finds nothing new"


def test_pages_that_were_read_are_not_broadcast(spark, monkeypatch, capsys):
    from meshlens.sources import listings

    own = listings.cut
    monkeypatch.setattr(listings, "cut", lambda df: df.explain() or own(df))
    pages = spark.range(3).selectExpr("'l' AS listing", "IF(id = 0, '', string(id)) AS token", """'{"items": ["a"], "next": "' || (id + 1) || '"}' AS payload""")
    assert listings.followed(pages).count() == 3
    told = capsys.readouterr().out
    assert "SortMergeJoin" in told and "Broadcast" not in told


def test_pages_are_followed_to_their_end_once(spark):
    import json

    from meshlens.sources import listings

    page = lambda *names, to=None: json.dumps({"items": [{"name": n} for n in names], "next": to})
    pages = [
        ("a", "", page("1", "2", to="x")), ("a", "x", page("3", to="y")), ("a", "y", page(to="z")), ("a", "z", page("4")),  # an empty page ends it
        ("b", None, page("1", to="x")), ("b", "x", '{"items": ["bro'), ("c", "", page("1", to="x")), ("c", "x", page("2", to="")), ("d", "x", page("1")),  # broken; led back; no first page
        ("e", "", page("1", "2", to="x")), ("e", "x", page("3", "4", to="y")), ("e", "y", page("5")), ("f", "", None), ("g", "", page("1", to="none")),
    ]
    df = spark.createDataFrame(pages, "listing string, token string, payload string")
    got = listings.repositories(listings.followed(df, most=4), "github")
    names = {}
    for r in sorted(got.collect(), key=lambda r: (r.listing, r.place)):
        names.setdefault(r.listing, []).append(r.name)
    assert names == {"a": ["1", "2", "3"], "b": ["1"], "c": ["1", "2"], "e": ["1", "2", "3", "4"], "g": ["1"]}
    assert listings.followed(df.limit(0)).collect() == []


def test_pages_of_a_folder(spark, tmp_path):
    from meshlens.sources import listings

    (tmp_path / "team x").mkdir()
    (tmp_path / "team x/first.json").write_text('{"items": [{"name": "a", "mainbranch": {"name": "dev"}, "links": {"clone": [{"href": "u"}]}}],\n "next": "p2"}')
    (tmp_path / "team x/p2.json").write_text('{"items": [{"name": "b"}]}')
    rows = listings.repositories(listings.followed(listings.read_pages(spark, str(tmp_path))), "bitbucket").orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("team x", 0, "a", "", "", "dev", "u"), ("team x", 1, "b", "", "", "", "")]


def test_progress_lines_are_twenty_at_most(spark):
    from meshlens.streaming import progress

    reports = [("r", "index", k, done, 3762, "methods") for k, done in enumerate(range(500, 5000, 500))] + [("r", "graph", k, k, 1000, "nodes") for k in range(1001)] + [("r", "scan", 1, 5, 0, "files")]
    got = [r.line for r in progress.progress_lines(spark.createDataFrame(reports, "run_id string, phase string, ord int, done int, total int, noun string")).orderBy("ord").collect()]
    assert sum(x.startswith("[graph]") for x in got) == 20 and "[graph] 952/1000 nodes" in got
    assert [x for x in got if x.startswith("[index]")] == [f"[index] {min(d, 3762)}/3762 methods" for d in range(500, 4001, 500)]
    assert not any(x.startswith("[scan]") for x in got)


def test_two_imports_equal_one(spark):
    from meshlens.operators import store

    texts = ['{"entry_points": [1, {"a": 2}], "repos": "odd", "generated_at": ""}', "[]", "no", None, "{}", '{"cross_repo_links": [1], "generated_at": "2020", "producers": null}']
    docs = spark.createDataFrame([(f"n{k}", t) for k, t in enumerate(texts)] + [("also", "{}")], "name string, text string")
    none = spark.createDataFrame([("old", "x", "t", "t", "ready", 0, 0, 0, 0)], "id string, name string, created_at string, updated_at string, status string, repos int, entry_points int, producers int, links int")
    once = store.seed_import(none, docs, "now")
    assert sorted(tuple(r)[1:] for r in once.collect()) == [("also", "now", "now", "ready", 0, 0, 0, 0), ("n0", "now", "now", "ready", 0, 2, 0, 0), ("n5", "2020", "now", "ready", 0, 0, 0, 1), ("x", "t", "t", "ready", 0, 0, 0, 0)]
    assert sorted(map(tuple, store.seed_import(once, docs, "later").collect())) == sorted(map(tuple, once.collect()))


def test_every_detection_rule_meets_parts_of_the_table(spark):
    """What any class of the gallery gives is among the rows of the registered queries, not only what services of parts give."""
    from meshlens.plans import adapter, catalogue, catalogue_sources  # noqa: F401
    from meshlens.sources import gallery

    files, _ = adapter.rule_sources(spark, "/root/testdata/sf0.001")
    n = adapter.table(spark, "/root/testdata/sf0.001", "part").count()
    assert files.count() == 2 * n and n > len(gallery.SAMPLES)
    assert files.filter("path LIKE 'rules/%'").selectExpr("regexp_extract(content, '(class|interface) ([A-Za-z]+)_[0-9]+', 2) AS name").distinct().count() == len({s.name for s in gallery.SAMPLES})
    for name, rows in (("java_entry_points", gallery.entry_rows()), ("java_producers", gallery.producer_rows())):
        assert {r[1] for r in rows} <= {r.type for r in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").select("type").distinct().collect()}

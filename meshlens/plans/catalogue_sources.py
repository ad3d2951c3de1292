"""Registered queries over Java sources made of parts: syntax trees, types, calls, detection, upkeep; and search by trigrams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import store, textindex
from ..sources import gallery, listings, syntax
from ..sources.extract import index
from ..sources.extract import java_types as read_types
from ..sources.files import language_for_file as with_language
from ..streaming.progress import progress_lines as lines_of
from ..streaming.progress import run_progress
from .adapter import graph, part_sources, parts_sql, rule_sources, rules_sql, table
from .analysis import unreachable_of
from .catalogue import ORACLES, _logs, query
from .fixpoint import cut, shared_folder, weighed
from .refresh import SourceStore

PARTS = "WITH " + parts_sql()
_KEY = "name || '.{0}@' || file || ':{1}'"


def _index(spark, d):
    return index(read_types(part_sources(spark, d)))


def _rules(spark, d):
    files, config = rule_sources(spark, d)
    return index(read_types(files)), config


# ---------------------------------------------------------------- syntax trees


@query(
    PARTS
    + """ SELECT repo, file, kind, name, 4 AS line FROM p UNION ALL SELECT repo, file, 'method', 'take', 4 FROM p WHERE kind = 'interface'
    UNION ALL SELECT repo, file, s.kind, coalesce(s.name, p.name), s.line FROM p, (VALUES ('constructor', NULL, 8), ('method', 'on', 9), ('method', 'get', 11), ('method', 'check', 13), ('method', 'idle', 14)) s(kind, name, line)
    WHERE p.kind = 'class' AND (s.line < 14 OR key % 4 = 3)"""
)
def structural_symbols(spark, d):
    return syntax.symbols(cut(syntax.syntax_nodes(part_sources(spark, d)))).select("repo", "file", "kind", "name", "line")


@query(PARTS + " SELECT repo, file, 'java.util.List' AS module, 2 AS line FROM p UNION ALL SELECT repo, file, 'shop.base.' || base, 3 FROM p")
def structural_imports(spark, d):
    return syntax.imports(cut(syntax.syntax_nodes(part_sources(spark, d))))


@query(
    PARTS
    + """ SELECT repo, file, c.* FROM p, (VALUES ('save', 'store', 10, 'on'), ('check', '', 10, 'on'), ('last', '', 12, 'get'), ('find', 'store', 12, 'get'), ('send', 'kafka', 13, 'check'), ('Sent', '', 13, 'check'), ('close', 'n', 14, 'idle')) c(target, receiver, line, caller)
    WHERE kind = 'class' AND (line < 14 OR key % 4 = 3)"""
)
def structural_calls(spark, d):
    return syntax.call_sites(cut(syntax.syntax_nodes(part_sources(spark, d)))).drop("pre")


# ---------------------------------------------------------------- types, calls and detection


@query(PARTS + " SELECT repo, file, 'shop.parts.' || name AS fqn, kind, 4 AS line, CASE kind WHEN 'class' THEN base ELSE '' END AS supertypes, CAST(CASE kind WHEN 'record' THEN 0 WHEN 'interface' THEN 1 ELSE 4 + (key % 4 = 3)::INTEGER END AS INTEGER) AS n_methods FROM p")
def java_types(spark, d):
    return read_types(part_sources(spark, d)).select("repo", "file", "fqn", "kind", "line", F.array_join("supertypes", ",").alias("supertypes"), F.size("methods").alias("n_methods"))


@query(
    PARTS
    + f""" SELECT repo, {_KEY.format("take", 4)} AS method_key, 1 AS n_params, false AS has_body FROM p WHERE kind = 'interface'
    UNION ALL SELECT repo, name || '.' || m.method || '@' || file || ':' || m.line, 1, true FROM p, (VALUES ('on', 9), ('get', 11), ('check', 13), ('idle', 14)) m(method, line) WHERE kind = 'class' AND (m.line < 14 OR key % 4 = 3)"""
)
def java_methods(spark, d):
    return _index(spark, d).methods.select("repo", "method_key", "n_params", "has_body")


@query(
    PARTS
    + f""" SELECT name || '.' || c.method || '@' || file || ':' || c.line AS caller, c.ord, c.display, c.arity, CASE WHEN c.display = 'check' THEN {_KEY.format("check", 13)} END AS callee, CASE WHEN c.display = 'check' THEN name END AS callee_class,
        CASE WHEN c.display = 'check' THEN file END AS callee_file, CASE WHEN c.display = 'check' THEN 13 END AS callee_line, false AS ambiguous
    FROM p, (VALUES ('on', 9, 0, 'store.save', 1), ('on', 9, 1, 'check', 1), ('get', 11, 0, 'last', 0), ('get', 11, 1, 'store.find', 2), ('check', 13, 0, 'kafka.send', 1), ('idle', 14, 0, 'n.close', 0)) c(method, line, ord, display, arity)
    WHERE kind = 'class' AND (c.line < 14 OR key % 4 = 3)"""
)
def java_calls(spark, d):
    from ..operators.resolve import call_edges

    return call_edges(_index(spark, d)).withColumn("ord", F.col("ord").cast("int"))


@query(
    PARTS
    + """ SELECT repo || ':' || name || '.on:brand-' || brand AS id, 'kafka-consumer' AS type, 'brand-' || brand AS channel, 9 AS line, 'Note' AS message_type, '' AS method_type FROM p WHERE kind = 'class'
    UNION ALL SELECT repo || ':' || name || '.get:/parts/' || key, 'rest-endpoint', '/parts/' || key, 11, '', 'GET' FROM p WHERE kind = 'class' UNION ALL """
    + rules_sql(gallery.entry_rows(), "method_type")
)
def java_entry_points(spark, d):
    from ..operators.detect import detect_entry_points

    return detect_entry_points(*_rules(spark, d)).select("id", "type", "channel", "line", "message_type", "method_type")


@query(PARTS + " SELECT repo || ':' || name || '.check:send:kafka' AS id, 'kafka-producer' AS type, 'size-' || size AS channel, 13 AS line, 'Sent' AS message_type, '' AS response_type FROM p WHERE kind = 'class' UNION ALL " + rules_sql(gallery.producer_rows(), "response_type"))
def java_producers(spark, d):
    from ..operators.detect import detect_producers

    return detect_producers(*_rules(spark, d)).select("id", "type", "channel", "line", "message_type", "response_type")


@query(PARTS + " SELECT repo || ':' || name || '.idle' AS id, repo, name AS class_name, 'idle' AS method, file, 14 AS line FROM p WHERE kind = 'class' AND key % 4 = 3")
def java_graph_unreachable(spark, d):
    return unreachable_of(part_sources(spark, d))


# ---------------------------------------------------------------- upkeep


@query(PARTS + ", n AS (SELECT *, key % 17 = 0 OR key % 10 = 3 AS fresh FROM p) SELECT repo, file, 'shop.parts.' || name AS fqn, kind, CASE kind WHEN 'class' THEN base ELSE '' END AS supertypes, CAST(CASE WHEN fresh THEN 2 ELSE 1 END AS INTEGER) AS parsed FROM n")
def refreshed_types(spark, d):
    """Types of a code base after a refresh: its first version lacks some files, has others with other contents, and some that are gone."""
    now = part_sources(spark, d)
    parts = table(spark, d, "part")
    gone = parts.filter("p_partkey % 13 = 5").withColumn("p_partkey", F.col("p_partkey") + 1_000_000_000)
    folder = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    older = parts.filter("p_partkey % 17 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 3, F.col("p_size") + 1).otherwise(F.col("p_size"))).unionByName(gone)
    older.write.parquet(f"{folder}/part.parquet")
    store = SourceStore(spark, f"{folder}/store")
    for files in (part_sources(spark, folder), now):
        store.refresh(files.select("repo", "path", F.md5("content").alias("digest")), lambda changed, files=files: files.join(changed, ["repo", "path"], "left_semi"))
    parsed = store.files().select("repo", F.col("path").alias("file"), "parsed")
    return store.types().join(parsed, ["repo", "file"]).select("repo", "file", "fqn", "kind", F.array_join("supertypes", ",").alias("supertypes"), "parsed")


# ---------------------------------------------------------------- search and names


@query(ORACLES["search_code"].replace("'c12'", "'part-12'"))
def search_index(spark, d):
    g = graph(spark, d)
    ends = {"entry_points": weighed(g.entry_points.select(*textindex.SEARCHED_ENTRY)), "producers": weighed(g.producers.select(*textindex.SEARCHED_PRODUCER))}
    return textindex.TextIndex.build(textindex.searched_rows(g.with_(**ends))).search("PART-12").select("kind", "hit")


#: Names of files by the key of a part, and languages by the names that they have: special ones, compound suffixes, last ones.
_NAMES = ("P{0}.java", "p{0}.d.ts", "a.b{0}/build.gradle.kts", "Dockerfile", "x.y{0}/.java", "p{0}.test.TS", "Q{0}.JAVA", "readme{0}")
_REGISTRY = (("java", ".java", False), ("declarations", ".d.ts", False), ("typescript", ".ts", False), ("kotlin-script", ".gradle.kts", False), ("docker", "Dockerfile", True), ("kotlin", ".kts", False))


@query(
    "SELECT path, CASE k WHEN 0 THEN 'java' WHEN 1 THEN 'declarations' WHEN 2 THEN 'kotlin-script' WHEN 3 THEN 'docker' WHEN 5 THEN 'typescript' WHEN 6 THEN 'java' END AS tag, count(*) AS n FROM (SELECT p_partkey % 8 AS k, 'src/' || CASE p_partkey % 8 "
    + " ".join("WHEN {} THEN '{}'".format(k, n.replace("{0}", "' || p_size || '")) for k, n in enumerate(_NAMES))
    + " END AS path FROM part) GROUP BY ALL"
)
def language_for_file(spark, d):
    named = lambda pattern: F.replace(F.lit(pattern), F.lit("{0}"), F.col("p_size").cast("string"))
    name = F.get(F.array(*[named(n) for n in _NAMES]), (F.col("p_partkey") % 8).cast("int"))
    files = table(spark, d, "part").select(F.concat(F.lit("src/"), name).alias("path"))
    return with_language(files, spark.createDataFrame(list(_REGISTRY), "tag string, key string, special boolean")).groupBy("path", "tag").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- progress as a stream


@query(ORACLES["ingest_progress"])
def progress_stream(spark, d):
    """Progress told by a stateful stream at its end: lines come in files that are dealt by chance, and some come twice."""
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    logs = _logs(spark, d)
    twice = logs.unionByName(logs.filter("ord % 3 = 0"))
    twice.withColumn("_file", F.pmod(F.xxhash64("ord", F.rand(1)), F.lit(4)).cast("int")).repartition(4, "_file").drop("_file").write.parquet(f"{folder}/logs")
    return run_progress(spark, f"{folder}/logs", f"{folder}/told", f"{folder}/state").drop("best")


@query(
    """WITH r AS (SELECT event_type AS run_id, event_id AS ord, event_id % 1000 AS done, 900 + user_id % 2 AS total, CASE WHEN user_id % 2 = 0 THEN 'index' ELSE 'graph' END AS phase FROM events),
    p AS (SELECT *, len(list_filter(range(1, 21), lambda k: round(total * k / 21.0) <= least(done, total))) AS passed FROM r),
    b AS (SELECT *, coalesce(max(passed) OVER (PARTITION BY run_id, phase ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT run_id, ord, '[' || phase || '] ' || least(done, total) || '/' || total || ' rows' AS line FROM b WHERE passed > before"""
)
def progress_lines(spark, d):
    events = table(spark, d, "events")
    phase = F.when(F.col("user_id") % 2 == 0, "index").otherwise("graph")
    return lines_of(events.select(F.col("event_type").alias("run_id"), phase.alias("phase"), F.col("event_id").alias("ord"), (F.col("event_id") % 1000).alias("done"), (900 + F.col("user_id") % 2).alias("total"), F.lit("rows").alias("noun")))


# ---------------------------------------------------------------- listings in pages, and imported documents


#: Parts of a page; a listing that has a broken page, and one that has an empty one, with the page's number.
_PAGE, _BROKEN, _EMPTY = 30, 5, 9


@query(
    f"""WITH i AS (SELECT p_partkey % 3 AS l, p_partkey // 3 // {_PAGE} AS page, p_partkey, p_name, p_brand FROM part),
    n AS (SELECT l, page, sum(count(*)) OVER (PARTITION BY l ORDER BY page) - count(*) AS before FROM i GROUP BY l, page)
    SELECT 'list' || l AS listing, CAST(before + row_number() OVER (PARTITION BY l, page ORDER BY p_partkey) - 1 AS INTEGER) AS place, p_name AS name, 'shop/' || p_partkey AS full_name, '' AS description, p_brand AS default_branch, '' AS clone_url
    FROM i JOIN n USING (l, page) WHERE before < 500 AND page < CASE l WHEN 1 THEN {_BROKEN} WHEN 2 THEN {_EMPTY} ELSE 1000000000 END"""
)
def repo_listing(spark, d):
    """Repositories listed by hosts in pages: one of three listings is as long as listings get, one has a broken page and one an empty one."""
    key = F.col("p_partkey")
    item = F.struct(key.alias("id"), F.to_json(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("shop/"), key.cast("string")).alias("path_with_namespace"), F.col("p_brand").alias("default_branch"))).alias("json"))
    paged = table(spark, d, "part").groupBy((key % 3).alias("l"), F.expr(f"p_partkey div 3 div {_PAGE}").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # _PAGE a page
    body = lambda items: F.concat(F.lit('{"items": ['), items, F.lit('], "next": "'), (F.col("page") + 1).cast("string"), F.lit('"}'))
    whole = body(F.array_join(F.transform("items", lambda x: x["json"]), ","))
    payload = F.when((F.col("l") == 1) & (F.col("page") == _BROKEN), F.substring(whole, F.lit(1), F.length(whole) - 7)).when((F.col("l") == 2) & (F.col("page") == _EMPTY), body(F.lit(""))).otherwise(whole)
    pages = paged.select(F.concat(F.lit("list"), F.col("l").cast("string")).alias("listing"), F.when(F.col("page") == 0, "").otherwise(F.col("page").cast("string")).alias("token"), payload.alias("payload"))
    return listings.repositories(listings.followed(pages), "gitlab")


@query(
    """SELECT 'seed-' || substr(sha256(text), 1, 16) AS id, name, CASE WHEN k % 2 = 0 THEN '2020-01-0' || (1 + k % 5) ELSE 'now' END AS created_at, 'now' AS updated_at, 'ready' AS status,
        CAST(CASE WHEN k % 5 = 1 THEN 0 ELSE 2 END AS INTEGER) AS repos, CAST(s % 4 AS INTEGER) AS entry_points, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS producers, 0 AS links
    FROM (SELECT p_partkey AS k, p_size AS s, 'part ' || p_partkey AS name, '{"repos": ' || CASE WHEN p_partkey % 5 = 1 THEN '"r"' ELSE '["a", "b"]' END || ', "entry_points": [' || array_to_string(list_transform(range(0, p_size % 4), lambda x: '{"id": "e' || x || '"}'), ',') || ']'
        || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', "producers": [{"id": "p"}]' END || CASE WHEN p_partkey % 2 = 0 THEN ', "generated_at": "2020-01-0' || (1 + p_partkey % 5) || '"' ELSE '' END || ', "key": ' || p_partkey || '}' AS text FROM part) WHERE k % 11 <> 0"""
)
def seed_import(spark, d):
    """Projects of graph documents of several versions, of which some can't be read, after two imports of overlapping sets."""
    key, size = F.col("p_partkey"), F.col("p_size")
    entries = F.array_join(F.transform(F.slice(F.array(*[F.lit(str(k)) for k in range(4)]), F.lit(1), (size % 4).cast("int")), lambda x: F.concat(F.lit('{"id": "e'), x, F.lit('"}'))), ",")
    text = F.concat(
        F.lit('{"repos": '), F.when(key % 5 == 1, '"r"').otherwise('["a", "b"]'), F.lit(', "entry_points": ['), entries, F.lit("]"), F.when(key % 3 == 0, "").otherwise(', "producers": [{"id": "p"}]'),
        F.when(key % 2 == 0, F.concat(F.lit(', "generated_at": "2020-01-0'), (key % 5 + 1).cast("string"), F.lit('"'))).otherwise(""), F.lit(', "key": '), key.cast("string"), F.when(key % 11 == 0, "").otherwise("}"),
    )
    documents = table(spark, d, "part").select(key.alias("key"), F.concat(F.lit("part "), key.cast("string")).alias("name"), text.alias("text"))
    none = spark.createDataFrame([], "id string, name string, created_at string, updated_at string, status string, repos int, entry_points int, producers int, links int")
    first = store.seed_import(none, documents.filter("key % 2 = 0").drop("key"), "now")
    return store.seed_import(first, documents.unionByName(documents.filter("key % 7 = 0")).drop("key"), "now")

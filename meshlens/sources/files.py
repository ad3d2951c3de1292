"""Source and configuration files as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_pruned_path, is_test_path, strip

#: File suffixes of the languages that have a parser, longest first.
LANGUAGES = ((".java", "java"),)


def _repo_files(spark: SparkSession, roots: dict[str, str], pattern: str) -> DataFrame:
    """repo, path (below the root), content of matching files; whole files, one row each.

    One scan reads all repositories; a file is joined with the roots among the folders above it.
    """
    plain = {repo: "/" + root.split("://")[-1].strip("/") for repo, root in roots.items()}
    tops = {t: roots[repo] for repo, t in plain.items()}
    outer = [root for t, root in tops.items() if not any(t.startswith(o + "/") for o in tops)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(outer)
    path = F.regexp_replace("path", "^[A-Za-z0-9+.-]+:/+", "/")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    placed = files.select(path.alias("_path"), "content", F.explode(above).alias("top"))
    known = spark.createDataFrame([(repo, top) for repo, top in plain.items()], "repo string, top string")
    found = placed.join(F.broadcast(known), "top")  # as many rows as there are repositories
    return found.select("repo", F.expr("substring(_path, length(top) + 1)").alias("path"), F.decode("content", "UTF-8").alias("content"))


def scan_source_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Java files of repositories {name: folder} outside build folders and tests."""
    return _repo_files(spark, roots, "*.java").filter(~is_pruned_path(F.col("path")) & ~is_test_path(F.col("path")))


def scan_config_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """application*.properties, .yml and .yaml outside build folders."""
    return _repo_files(spark, roots, "application*.{properties,yml,yaml}").filter(~is_pruned_path(F.col("path")))


def language_of(path: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for suffix, name in reversed(LANGUAGES):
        out = F.when(F.lower(path).endswith(suffix), F.lit(name)).otherwise(out)
    return out


def language_for_file(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (path, further columns) with `tag`: the language that a registry (tag, key, special) has for their names, or null.

    A special name goes before suffixes: all suffixes of a name together (.gradle.kts) go before the last one, in lower case, as
    keys are.  Names that begin with a dot have no suffix there.  Where keys repeat, the least tag counts.
    The candidates of a path are rows that are joined with the registry, so that it may be a table of any size.
    """
    name = F.element_at(F.split(F.rtrim(F.col("path"), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(name, "^\\.+", "")
    suffix = lambda pattern: F.lower(F.regexp_extract(stem, pattern, 1))
    candidate = lambda rank, key: F.struct(F.lit(rank).alias("rank"), key.alias("key"))
    asked = F.array(candidate(0, name), candidate(1, suffix("^[^.]+((?:\\.[^.]+)+)$")), candidate(2, suffix("[^.](\\.[^.]+)$")))
    keyed = files.select("path").distinct().select("path", F.explode(asked).alias("c")).select("path", "c.rank", "c.key").filter("key <> ''")
    known = registry.select("tag", F.col("key"), F.col("special"))
    met = keyed.join(known, "key").filter((F.col("rank") == 0) == F.col("special"))
    best = met.groupBy("path").agg(F.min(F.struct("rank", "tag")).alias("b")).select(F.col("path").alias("_path"), F.col("b.tag").alias("tag"))
    return files.join(best, F.col("path") == F.col("_path"), "left").drop("_path")


#: Where a text's lines end.
LINE_ENDS = "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\u2028\u2029]"


def parse_properties(files: DataFrame) -> DataFrame:
    """key, value of the lines of content, with the other columns and the line's place (ord).

    Blank lines and those that begin with # or ! are skipped; a line is split at its first =, else
    at its first colon; a line with neither is skipped.
    """
    others = [c for c in files.columns if c != "content"]
    lines = files.select(*others, F.posexplode(F.split("content", LINE_ENDS)).alias("ord", "_raw")).withColumn("_line", strip(F.col("_raw")))
    split = lines.filter(~F.col("_line").rlike("^[#!]") & (F.col("_line") != "")).withColumn("_at", F.locate("=", F.col("_line"))).withColumn("_at", F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.locate(":", F.col("_line"))))
    return split.filter("_at > 0").select(*others, "ord", strip(F.expr("substring(_line, 1, _at - 1)")).alias("key"), strip(F.expr("substring(_line, _at + 1)")).alias("value"))


def flatten_yaml(text: str) -> list[tuple[str, str]]:
    """Dotted keys of a block of nested mappings.

    List items, comment lines and lines without a colon are skipped; only blanks indent; a value loses
    its double quotes, then its single ones, at either end; what follows a # in it belongs to it.
    """
    out: list[tuple[str, str]] = []
    above: list[tuple[int, str]] = []
    for raw in text.splitlines():
        body = raw.strip()
        if not body or body.startswith(("#", "- ")) or ":" not in body:
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        while above and above[-1][0] >= indent:
            above.pop()
        key, _, value = body.partition(":")
        value = value.strip().strip('"').strip("'")
        if value:
            out.append((".".join([*(k for _, k in above), key.strip()]), value))
        else:
            above.append((indent, key.strip()))
    return out


def parse_yaml(files: DataFrame) -> DataFrame:
    """repo, path, ord, key, value of YAML files (repo, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.repo, r.path, k, key, value) for r in batch.itertuples() for k, (key, value) in enumerate(flatten_yaml(r.content or ""))]
            yield pd.DataFrame(rows, columns=["repo", "path", "ord", "key", "value"])

    return files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, ord int, key string, value string")


def load_config(files: DataFrame) -> DataFrame:
    """key, value over all repositories' files; of keys that repeat, the last file's last line counts.  first: the place of the key's first line."""
    yaml = F.lower("path").rlike("\\.ya?ml$")
    both = parse_properties(files.filter(~yaml)).select("repo", "path", "ord", "key", "value").unionByName(parse_yaml(files.filter(yaml)))
    place = F.struct("repo", "path", "ord")
    return both.groupBy("key").agg(F.max_by("value", place).alias("value"), F.min(place).alias("first"))


def source_lines(files: DataFrame, start_line: int = 1, end_line: int = 0, highlight_line: int = 0) -> DataFrame:
    """Numbered lines of content within [start_line, end_line] (0: to the end), with the other columns."""
    others = [c for c in files.columns if c != "content"]
    rows = files.select(*others, F.posexplode(F.split("content", "\n")).alias("_k", "content"))
    kept = rows.filter((F.col("_k") + 1 >= start_line) & ((F.col("_k") + 1 <= end_line) if end_line else F.lit(True)))
    return kept.select(*others, (F.col("_k") + 1).alias("line"), "content", (F.col("_k") + 1 == highlight_line).alias("highlighted"))


def resolve_source_path(files: DataFrame, wanted: str) -> DataFrame:
    """The file that a path names: exact, by its end, or by its base name; the first that fits, within the scanned roots only."""
    path = F.regexp_replace("path", "^/+", "")
    target = wanted.lstrip("/")
    parts = [p for p in target.split("/") if p]
    if ".." in parts:
        return files.limit(0)
    rank = F.when(path == target, 0).when(F.lit(target).endswith(F.concat(F.lit("/"), path)), 1).when(F.element_at(F.split(path, "/"), -1) == (parts[-1] if parts else ""), 2)
    return files.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "repo", "path").limit(1).drop("_rank")


def discover_local_repos(folder: str, below: tuple[str, ...] = ("src", "services", "apps", "packages")) -> list[dict]:
    """Sub-folders of a folder with whether they look like git and Java projects; if none does, those of the usual containers."""
    import os

    def listed(top: str) -> list[dict]:
        names = sorted(n for n in os.listdir(top) if not n.startswith(".") and os.path.isdir(os.path.join(top, n))) if os.path.isdir(top) else []
        marks = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", os.path.join("src", "main", "java"))
        return [{"name": n, "path": os.path.join(top, n), "is_git": os.path.exists(os.path.join(top, n, ".git")), "has_java": any(os.path.exists(os.path.join(top, n, m)) for m in marks)} for n in names]

    found = listed(folder)
    if any(x["is_git"] or x["has_java"] for x in found):
        return found
    deeper = [x for name in below for x in listed(os.path.join(folder, name))]
    return deeper if any(x["is_git"] or x["has_java"] for x in deeper) else found

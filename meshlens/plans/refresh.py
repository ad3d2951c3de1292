"""Upkeep of a parsed code base: only files whose digest changed are read and parsed again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.extract import TYPE_DDL, java_types
from .fixpoint import cut

FILE_DDL = "repo string, path string, digest string, parsed int"


@dataclass(frozen=True)
class SourceStore:
    """A folder that driver and executors share: of each version its files with their digests, and the types of the files that it parsed.

    Types are never copied: a file's row names the version that parsed it, and a version's types are those of its files.
    """

    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest whole version; 0 if there is none."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException:  # nothing written yet
            return 0

    def files(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.schema(FILE_DDL).parquet(f"{self.path}/files/version={version}") if version else self.spark.createDataFrame([], FILE_DDL)

    def types(self, version: int | None = None) -> DataFrame:
        """The types (TYPE_DDL) of a version's files."""
        files = self.files(version).select("repo", F.col("path").alias("file"), F.col("parsed").alias("version"))
        if not self.version():
            return self.spark.createDataFrame([], TYPE_DDL)
        stored = self.spark.read.schema(f"{TYPE_DDL}, version int").parquet(f"{self.path}/types")
        return stored.join(files, ["repo", "file", "version"], "left_semi").drop("version")

    def refresh(self, listing: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> int:
        """Brings the store up to a listing (repo, path, digest) of all files, and returns the new version; if nothing changed, the old one.

        contents gets (repo, path) of new and changed files and returns them with their content, (repo, path, content); no other file is read.
        A path that the listing has twice, or a null digest, counts as changed.  A refresh that fails leaves no version, and its
        rows are replaced by the next one.
        """
        version = self.version() + 1
        old = self.files(version - 1)
        known = listing.select("repo", "path", "digest").groupBy("repo", "path").agg(F.when(F.count("*") == 1, F.min("digest")).alias("digest"))
        listed = cut(known.join(old.select("repo", "path", "digest", "parsed"), ["repo", "path", "digest"], "left").select("repo", "path", "digest", F.coalesce("parsed", F.lit(version)).alias("parsed")))
        changed = listed.filter(F.col("parsed") == version)
        if version > 1 and changed.isEmpty() and listed.count() == old.count():
            return version - 1
        java_types(contents(changed.select("repo", "path"))).write.mode("overwrite").parquet(f"{self.path}/types/version={version}")
        listed.write.mode("overwrite").parquet(f"{self.path}/files/version={version}")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{self.path}/versions")
        return version


def folder_listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo, path, digest) of the Java files of {repo: folder}, by their length and time of change: no content is read."""
    out = spark.createDataFrame([], "repo string, path string, digest string")
    for repo, root in roots.items():
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root).select("path", "length", "modificationTime")
        out = out.unionByName(found.select(F.lit(repo).alias("repo"), "path", F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("digest")))
    return out


def folder_contents(spark: SparkSession, most: int = 10_000) -> Callable[[DataFrame], DataFrame]:
    """What refresh() reads changed files of folder_listing() with: by their names, `most` in a batch."""

    def contents(changed: DataFrame) -> DataFrame:
        out, names = spark.createDataFrame([], "repo string, path string, content string"), []

        def read(names: list) -> DataFrame:
            found = spark.read.format("binaryFile").load([n.path for n in names]).select("path", F.decode("content", "UTF-8").alias("content"))
            return found.join(changed, "path").select("repo", "path", "content")

        for row in changed.toLocalIterator():
            names.append(row)
            if len(names) == most:
                out, names = cut(out.unionByName(read(names))), []
        return out.unionByName(read(names)) if names else out

    return contents

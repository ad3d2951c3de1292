"""Java files to relations: types, methods, calls, fields, constants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARGS = "map<string,array<string>>"
ANNOTATION = f"struct<name:string,args:{_ARGS},nested:array<struct<name:string,args:{_ARGS}>>>"
CALL = (
    "struct<ord:int,line:int,receiver:string,method:string,args:array<string>,url:string,request_url:string,request_verb:string,factory:string,topic:string,"
    "new_types:array<string>,first_new:string,first_root:string,first_name:string,root:string,verb:string,built:boolean>"
)
METHOD = (
    "struct<name:string,line:int,returns_text:string,returns:string,static:boolean,has_body:boolean,params:array<struct<name:string,type_text:string,type:string,annotations:array<string>>>,"
    f"params_text:string,annotations:array<{ANNOTATION}>,locals:map<string,string>,calls:array<{CALL}>,mentions_builder:boolean,owner:string>"
)
FIELD = "struct<name:string,type:string,constant:string,channel:string>"
TYPE_DDL = (
    "repo string, file string, place int, simple_name string, kind string, fqn string, package string, line int, explicit array<string>, wildcard array<string>, supertypes array<string>, "
    f"annotations array<{ANNOTATION}>, fields array<{FIELD}>, methods array<{METHOD}>"
)


def _plain(value):
    """Records with their maps as lists of pairs, as Arrow wants them."""
    if isinstance(value, dict):
        return {k: list(v.items()) if k in ("args", "locals") and isinstance(v, dict) else _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


#: Rows that a batch of read files holds at most, and characters of files that it is made of.
BATCH_ROWS, BATCH_CHARS = 5000, 1 << 20


def dealt(files: DataFrame) -> DataFrame:
    """(repo, path, content) of files dealt over tasks by their paths: reading a file is work that its table's bytes don't tell, so the scan's few tasks won't do."""
    spark = files.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("repo", "path", "content").repartition(tasks, "repo", "path")


def batched(read: Iterator[tuple[int, list[dict]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of (characters of a file, its rows) as batches over many files; a file of more rows makes several."""
    held: list[dict] = []
    chars = 0
    for size, rows in read:
        held += rows
        chars += size
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            for k in range(0, len(held), BATCH_ROWS):
                yield pa.RecordBatch.from_pylist(held[k : k + BATCH_ROWS], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def java_types(files: DataFrame) -> DataFrame:
    """Types (TYPE_DDL) declared in files (repo, path, content); place orders the types of a file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(TYPE_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .javaparse import parse_java

        def read():
            for batch in batches:
                for repo, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield len(content or ""), [{"repo": repo, "file": path, "place": k, **_plain(t)} for k, t in enumerate(parse_java(content or ""))]

        yield from batched(read(), schema)

    return dealt(files).mapInArrow(run, TYPE_DDL)


@dataclass(frozen=True)
class JavaIndex:
    """types: every declared type with its key; scanned: of types with one name, the last (repository, file and place order)."""

    types: DataFrame
    scanned: DataFrame
    methods: DataFrame
    fields: DataFrame
    constants: DataFrame


def index(types: DataFrame) -> JavaIndex:
    """The index of types, cut by a checkpoint: every later step reads it."""
    from ..plans.fixpoint import cut

    keyed = cut(types.withColumn("ord", F.concat_ws("|", "repo", "file", F.lpad(F.col("place").cast("string"), 6, "0"))).withColumn("key", F.concat_ws("@", "fqn", "ord")))
    last = keyed.groupBy("fqn").agg(F.max_by("key", "ord").alias("key")).select("key")
    scanned = keyed.hint("merge").join(last, "key", "left_semi")
    own = [c for c in keyed.columns if c not in ("methods", "fields", "annotations", "explicit", "wildcard")]
    methods = keyed.select(*own, F.posexplode("methods").alias("m_ord", "m")).filter("m.name <> '<init>'")
    params = F.filter("m.params", lambda p: p["type"] != "")
    name = F.concat_ws(".", "simple_name", "m.name")
    methods = methods.select(
        F.col("key").alias("type_key"), "repo", "file", F.col("simple_name").alias("class_simple"), F.col("m.name").alias("name"), F.col("m.line").alias("line"), F.size(params).alias("n_params"), F.col("m.has_body").alias("has_body"),
        F.concat(name, F.lit("@"), "file", F.lit(":"), F.col("m.line").cast("string")).alias("method_key"), F.concat_ws("|", "ord", F.lpad(F.col("m_ord").cast("string"), 6, "0")).alias("ord"), "m_ord",
    )
    fields = keyed.select("key", "repo", "simple_name", "ord", F.posexplode("fields").alias("f_ord", "f")).select("key", "repo", "simple_name", "ord", "f_ord", "f.*")
    constants = fields.filter("constant is not null").select(F.col("simple_name").alias("class"), "name", F.col("constant").alias("value"), F.concat_ws("|", "ord", F.lpad(F.col("f_ord").cast("string"), 6, "0")).alias("ord"))
    return JavaIndex(keyed, scanned, methods, fields, constants)

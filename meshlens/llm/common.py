"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Rows and text bytes that one call of a batch function gets at most (one row may exceed the bytes).
SLICE_ROWS = 1024
SLICE_BYTES = 8 << 20
#: Rows of an Arrow batch between the JVM and Python, where the session leaves Spark's default of 10 000: whole texts travel in them.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context's own checkpoint folder; without either a cluster has none to share."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if (spark.sparkContext.master or "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshlens-checkpoint-"))  # one machine and one process
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back: lineage ends there.

    A join with the result shuffles: dozens of tables under Spark's limit for broadcasts, each many times larger in memory
    than its compressed bytes, would be held by the driver.  Small ones are broadcast where F.broadcast asks for it.
    """
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True).hint("merge")


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches from here on, unless the session asks for a size of its own."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, text_col: int | None = None, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part stays small in memory."""
    if text_col is None or not batch.num_rows:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    column = batch.column(text_col)
    at, held = 0, 0
    for i in range(batch.num_rows):
        size = len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if i > at and (held + size > slice_bytes or i - at >= SLICE_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema: str | StructType, text_col: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over small slices. make() runs once a task; the function it returns turns a RecordBatch into a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                if part.num_rows:
                    out = f(part)
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=target)

    bound_batches(df.sparkSession)
    target = arrow_schema(df.sparkSession, schema)
    if not any("`" in name for name in df.columns):
        return df.mapInArrow(run, schema)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # mapInArrow() looks columns up by their bare names
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f"c{k}" for k in range(batch.num_columns)])

    names = df.columns
    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    plain = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(fields)])
    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, plain).toDF(*[f.name for f in fields])


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def extended(fields: Iterable[StructField], ddl: str) -> StructType:
    """Fields of any names, as they are, and those of ddl; all may be null."""
    return StructType([StructField(f.name, f.dataType, True) for f in [*fields, *StructType.fromDDL(ddl)]])


def quoted(name: str) -> str:
    """A column's name for col(), whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def resolve(path: str) -> str:
    """An absolute path as it is; a bare name is a file of the installed public vocabularies, found where the code runs."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows in the order of their keys; the last group of a batch waits for its end."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*waiting, batch])
        columns = [table.column(k).to_numpy() for k in keys]
        open_rows = np.logical_and.reduce([c == c[-1] for c in columns])
        done = int(np.argmax(open_rows))
        if done:
            yield table.slice(0, done).combine_chunks()
        waiting = table.slice(done).combine_chunks().to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def keep_first(known: dict, n: int) -> None:
    """Drops all but the n entries that came first; of words, the frequent ones come early."""
    if len(known) > n:
        first = dict(list(zip(known, known.values(), strict=True))[:n]) if n else {}
        known.clear()
        known.update(first)


_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """What this worker process keeps for an operator over tasks.  It keeps it for one operator at a time: others' goes, to bound its memory."""
    if _HELD.keys() - {name}:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # only glibc can give freed memory back on request
            ctypes.CDLL(None).malloc_trim(0)
    return _HELD.setdefault(name, {})

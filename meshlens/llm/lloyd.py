"""Delta Lloyd: k-means rounds that look only at what can have changed.

Vectors are turned into integers and kept in blocks of rows, as a table bucketed by block; every round writes
each block's owners and squared distances to a table bucketed alike, so that a round joins the two without a
shuffle and never rewrites a vector.  A round compares vectors whose owner's centroid stayed with the centroids
that moved only, and vectors whose owner moved with all: distances to centroids that stayed are known not to
win.  Tasks return the vectors that change hands as signed sums, integers added to the cluster that gains and
taken from the one that loses, and the kept global sums take them up, so that no round adds all vectors again.
All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, slices, with_checkpoint_dir

#: Vectors of a block.
BLOCK = 256
#: Integers beyond are taken as this, so that squared distances of up to 64 components fit in a long.
LARGEST = 1 << 27
#: Centroids' integers that a clustering may have at most: they go to every task.
MOST_CENTROID_VALUES = 1 << 24
#: Up to here sums of squares of 64 components are exact in double precision.
_EXACT = 1 << 22

_BLOCKS = "block bigint, ids array<bigint>, vectors binary"
_STATE = "block bigint, owners array<int>, distances array<bigint>, cluster int, gained bigint, moved bigint, compared bigint, sums array<bigint>, distance bigint"


@dataclass
class Clustering:
    """assignments (vec_id, cluster, distance), a row each vector; the last centroids; their clusters' summed distances; what each round did."""

    assignments: DataFrame
    centroids: np.ndarray
    inertias: list[int]
    rounds: list[dict] = field(default_factory=list)


def kept_vectors(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with `dims` components, none null or non-finite; integers beyond LARGEST are taken as that."""
    x = F.col(vector_col)
    real = F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))

    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")

    return vectors.filter(real).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of `seed:vec_id`, in that order; equal hashes by components, null ids last."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return np.array([r.v for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def _in_blocks(kept: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first, done = (context.partitionId() if context else 0) << 33, 0
        waiting: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal done
            ids, flat = rows["vec_id"].to_pylist(), rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4")
            vectors = [flat[at * dims : (at + BLOCK) * dims].tobytes() for at in range(0, len(ids), BLOCK)]
            out = {"block": [first + done + k for k in range(len(vectors))], "ids": [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)], "vectors": vectors}
            done += len(vectors)
            return pa.RecordBatch.from_pydict(out, schema=target)

        for batch in batches:
            waiting.append(batch)
            rows = pa.Table.from_batches(waiting)
            if whole := rows.num_rows // BLOCK * BLOCK:
                yield packed(rows.slice(0, whole))
            waiting = rows.slice(whole).to_batches()
        if sum(b.num_rows for b in waiting):
            yield packed(pa.Table.from_batches(waiting))

    bound_batches(kept.sparkSession)
    target = arrow_schema(kept.sparkSession, _BLOCKS)
    return kept.mapInArrow(run, _BLOCKS)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows of x to centroids; by matrix product where doubles hold every sum exactly."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) * (x.shape[1] ** 0.5) <= _EXACT * 8:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def reassigned(x: np.ndarray, owners: np.ndarray, distances: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Owners and distances after the centroids `moved` (true or false each) have moved, and how many distances that took; owner -1 is none yet."""
    owners, distances = owners.copy(), distances.copy()
    anew = (owners < 0) | moved[owners]
    compared = 0
    if anew.any():
        all_of = squared_distances(x[anew], centroids)
        compared += all_of.size
        owners[anew] = all_of.argmin(1)  # the first of equals
        distances[anew] = all_of.min(1)
    rest, candidates = np.flatnonzero(~anew), np.flatnonzero(moved)
    if len(rest) and len(candidates):
        some = squared_distances(x[rest], centroids[candidates])
        compared += some.size
        best, at = some.min(1), candidates[some.argmin(1)]
        wins = (best < distances[rest]) | ((best == distances[rest]) & (at < owners[rest]))
        owners[rest[wins]], distances[rest[wins]] = at[wins], best[wins]
    return owners, distances, compared


def _round(joined: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Rows of blocks with their new owners, and a task's sums of what changed hands: rows without a block."""
    spark = joined.sparkSession
    shared = spark.sparkContext.broadcast((centroids, moved))
    known = "owners" in joined.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, moved = shared.value
        k, dims = centroids.shape
        gained, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        compared = changed = 0
        for batch in batches:
            for part in slices(batch, 1):
                out: dict[str, list] = {name: [] for name in target.names}
                for row in range(part.num_rows):
                    x = np.frombuffer(part.column(1)[row].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
                    old = np.array(part.column(2)[row].as_py(), np.int64) if known else np.full(len(x), -1)
                    far = np.array(part.column(3)[row].as_py(), np.int64) if known else np.zeros(len(x), np.int64)
                    new, distances, n = reassigned(x, old, far, centroids, moved)
                    compared += n
                    hands = new != old
                    changed += int(hands.sum())
                    np.add.at(sums, new[hands], x[hands])
                    np.add.at(gained, new[hands], 1)
                    lost = hands & (old >= 0)
                    np.subtract.at(sums, old[lost], x[lost])
                    np.subtract.at(gained, old[lost], 1)
                    np.add.at(inertia, new, distances)
                    out["block"].append(part.column(0)[row].as_py())
                    out["owners"].append(new.astype(np.int32))
                    out["distances"].append(distances)
                n_rows = len(out["block"])
                yield pa.RecordBatch.from_pydict(out | {name: [None] * n_rows for name in target.names if not out[name]}, schema=target)
        touched = np.flatnonzero(sums.any(1) | (gained != 0) | (inertia != 0))
        if len(touched) or compared:
            touched = touched if len(touched) else np.array([0])
            first = [i == 0 for i in range(len(touched))]
            out = {
                "cluster": touched, "gained": gained[touched], "moved": [changed * f for f in first], "compared": [compared * f for f in first],
                "sums": list(sums[touched]), "distance": inertia[touched],
            }
            yield pa.RecordBatch.from_pydict({name: pa.array(out[name], target.field(name).type) if name in out else pa.nulls(len(touched), target.field(name).type) for name in target.names}, schema=target)

    bound_batches(spark)
    target = arrow_schema(spark, _STATE)
    return joined.mapInArrow(run, _STATE)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delta_lloyd(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", buckets: int | None = None
) -> Clustering:
    """Clusters of vectors by `rounds` rounds of assignment to the nearest centroid and replacement of centroids, and a last assignment.

    Vectors and start: kept_vectors(), first_centroids(); with fewer than k vectors there are fewer clusters, and an empty table has none.
    Ties go to the smaller number; a centroid becomes floor(sum / count) of its vectors' components, an empty one stays; once no centroid moves,
    further rounds would change nothing and are left out.  Rows that repeat, and null ids, are vectors of their own; other columns are not read.
    Centroids are bounded by MOST_CENTROID_VALUES, as tasks get all.  A round's table is deleted when the next is written.
    """
    if dims * LARGEST * LARGEST * 4 > 1 << 62 or k * dims > MOST_CENTROID_VALUES:
        raise ValueError("at most 64 components a vector, and k * dims at most 2**24")
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, id_col, vector_col, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return Clustering(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), np.zeros((0, dims), np.int64), [])
    run, buckets = uuid.uuid4().hex, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{with_checkpoint_dir(spark)}/lloyd-{run}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.bucketBy(buckets, "block").option("path", f"{folder}/{name}").saveAsTable(f"lloyd_{run}_{name}")
        return spark.table(f"lloyd_{run}_{name}")

    def dropped(name: str) -> None:
        spark.sql(f"DROP TABLE lloyd_{run}_{name}")

    blocks = written(_in_blocks(kept, dims).repartition(buckets, "block"), "blocks")
    sums, counts = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
    moved, state, history, inertias = np.ones(len(centroids), bool), None, [], [0] * len(centroids)
    for r in range(rounds + 1):
        joined = blocks.select("block", "vectors")
        if state is not None:
            joined = joined.join(state.filter("block IS NOT NULL").select("block", "owners", "distances"), "block").select("block", "vectors", "owners", "distances")
        last, state = state, written(_round(joined, centroids, moved), f"round_{r}")
        if last is not None:
            dropped(f"round_{r - 1}")
            _delete(spark, f"{folder}/round_{r - 1}")
        handed = state.filter("block IS NULL")
        history.append({"moved_centroids": int(moved.sum()), "moved_vectors": 0, "compared": 0})
        inertias = [0] * len(centroids)
        values = handed.select("cluster", F.posexplode(F.concat("sums", F.array("gained", "moved", "compared", "distance"))))
        for cluster, at, by in values.groupBy("cluster", "pos").agg(F.try_sum("col")).collect():  # k * (dims + 4) rows at most
            if at < dims:
                sums[cluster, at] += by
            elif at == dims:
                counts[cluster] += by
            elif at == dims + 3:
                inertias[cluster] = by
            else:
                history[-1]["moved_vectors" if at == dims + 1 else "compared"] += by
        if r == rounds:
            break
        after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved, centroids = (after != centroids).any(1), after
        if not moved.any():
            break
    dropped("blocks")
    dropped(f"round_{r}")
    ends = spark.read.parquet(f"{folder}/round_{r}").filter("block IS NOT NULL").select("block", "owners", "distances")
    ids = spark.read.parquet(f"{folder}/blocks").select("block", "ids")
    rows = ids.join(ends, "block").select(F.inline(F.arrays_zip("ids", "owners", "distances"))).toDF("vec_id", "cluster", "distance")
    return Clustering(rows, centroids, inertias, history)


def cluster_report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, by delta_lloyd()'s defaults; sums beyond a long are null."""
    done = delta_lloyd(vectors)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in done.centroids.tolist()]
    total = None if None in done.inertias or sum(done.inertias) >= 1 << 63 else sum(done.inertias)
    clusters = vectors.sparkSession.createDataFrame(
        [(k, done.inertias[k], total, sha[k]) for k in range(len(sha))], "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    joined = done.assignments.join(F.broadcast(clusters), F.col("cluster") == F.col("_cluster"))  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, scale: int = 1024) -> str:
    """The same rows in DuckDB, every round as plain Lloyd: all vectors against all centroids, sums made anew."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, unnest(range({dims})) AS i, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT h.cid, v.i, v.x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cid FROM (SELECT DISTINCT vec_id FROM v)) h JOIN v USING (vec_id) WHERE h.cid < {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (SELECT v.vec_id, c.cid, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cid, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.t - ((s.t % s.n) + s.n) % s.n) // s.n END::BIGINT AS x
  FROM c{r} c LEFT JOIN (SELECT a.cid, v.i, sum(v.x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY ALL) s ON s.cid = c.cid AND s.i = c.i
)""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.cid::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.cid)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, s.sha AS centroid_sha256
FROM a{rounds} a JOIN (SELECT cid, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY cid) s USING (cid)"""
    )

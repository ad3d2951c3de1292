"""Embedding near-duplicates by collision-counting projections.

Vectors of a label are projected on many random lines.  On each line, sorted, a query's window is
what lies within WIDTH standard deviations that a pair at the threshold has; a pair collides where
one is in the other's window.  Pairs that collide on enough lines are verified by their cosine.  A
pair at the threshold collides on a line with a known probability, independently of the other
lines, so the count that misses at most 1 - RECALL of such pairs is a binomial quantile.

Windows on single lines hold a fixed part of a label, so counting over all of it would be work and
shuffle with the square of its size.  Counting is therefore done within cells: a table has some
other lines, and a vector's cell there says on which side of each it lies.  A pair at the threshold
shares a cell with a known probability, too; the lines of a table grow with the label's size, so
that cells stay about TARGET vectors, and there are as many tables as keep the pairs that share no
cell within the same 1 - RECALL.  A vector is copied once a table: 9 times for 5000 vectors of a label,
15 for 50 000, 72 for 100 million.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, bound_batches, cut, whole_groups
from .components import components

SIMILARITY = 0.93
LINES = 32
#: Half the window, in standard deviations of the projected difference of a pair at the threshold.
WIDTH = 1.5
RECALL = 0.9995
#: Vectors of a cell that its lines aim at, and the lines of a table at most.
TARGET = 512
MOST_SIDES = 24
#: Vectors of a block; cells that hold more, of vectors that are alike, are compared block by block.
BLOCK = 1024
#: Pairs whose cosines are worked out at once; the part of passed pairs from which a matrix product is cheaper, and far more than its rounding.
PAIRS = 1 << 16
DENSE = 0.02
ROUNDING = 1e-9
SEED = 20_231


def cells_of(vectors: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(lines of a table, tables) for so many vectors: a pair at the threshold shares a cell somewhere with at least the probability `recall`."""
    sides = min(MOST_SIDES, max(0, math.ceil(math.log2(max(1, vectors) / TARGET))))
    if not sides:
        return 0, 1
    share = (1 - math.acos(similarity) / math.pi) ** sides
    return sides, math.ceil(math.log(1 - recall) / math.log(1 - share))


def calibrated_count(lines: int = LINES, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with at least the probability `recall`."""
    p = math.erf(width / math.sqrt(2))
    tail, count = 0.0, lines
    while count > 1:
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            break
        count -= 1
    return count


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; scaled first, so that neither huge nor tiny ones overflow."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def collisions(query: np.ndarray, rows: np.ndarray, half: float) -> np.ndarray:
    """For projections (vectors, lines) of queries and rows: on how many lines each pair collides."""
    out = np.zeros((len(query), len(rows)), np.uint8)
    for line in range(query.shape[1]):
        order = np.argsort(rows[:, line], kind="stable")
        along = rows[order, line]
        rank = np.empty(len(rows), np.uint16)
        rank[order] = np.arange(len(rows), dtype=np.uint16)
        low = np.searchsorted(along, query[:, line] - half, side="left").astype(np.uint16)
        high = np.searchsorted(along, query[:, line] + half, side="right").astype(np.uint16)
        out += (rank[None, :] - low[:, None]) < (high - low)[:, None]  # unsigned: below the window wraps around
    return out


def linked(left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of left, rows of right) of unit vectors that link: found by counting, verified by the cosine.

    With same, left and right are the same rows and each pair is given once, the lower row first.
    Where many pairs passed, a matrix product says which cosines are clear of the threshold; the others
    are summed in one order, so a pair's answer doesn't depend on what else is compared.
    """
    lines = np.random.default_rng(SEED).standard_normal((left.shape[1], LINES))
    half = WIDTH * math.sqrt(2 - 2 * similarity)
    passed = collisions(left @ lines, right @ lines, half) >= calibrated_count()
    if same:
        passed = np.triu(passed, 1)
    sure: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if passed.mean() > DENSE:
        cosines = left @ right.T
        sure = np.nonzero(passed & (cosines >= similarity + ROUNDING))
        passed &= np.abs(cosines - similarity) < ROUNDING
    a, b = np.nonzero(passed)
    good = np.empty(len(a), bool)
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        good[part] = (left[a[part]] * right[b[part]]).sum(axis=1) >= similarity
    return np.concatenate([sure[0], a[good]]), np.concatenate([sure[1], b[good]])


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, digest, label, size, data: all but the first null where a vector links with nothing.

    data has single precision where that holds every component exactly; cosines are in double precision all the same.
    """

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"vec_id": batch.column(0), "digest": [], "label": [], "size": [], "data": []}
            for vector, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                v = vector.values.to_numpy(zero_copy_only=False) if vector.is_valid and label is not None and len(vector) and not vector.values.null_count else None
                fine = v is not None and bool(np.isfinite(v).all()) and bool(np.any(v))
                wide = v.astype("<f8") + 0.0 if fine else None  # + 0.0: no negative zeros
                out["digest"].append(hashlib.blake2b(b"%d " % label + wide.tobytes(), digest_size=16).digest() if fine else None)
                out["label"].append(label if fine else None)
                out["size"].append(len(wide) if fine else None)
                out["data"].append(_packed(wide) if fine else None)
            return out

        return f

    chosen = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), F.col("label").cast("bigint"))
    return arrow_map(chosen, make, "vec_id bigint, digest binary, label bigint, size int, data binary")


def _packed(wide: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        narrow = wide.astype("<f4")
    return (narrow if np.array_equal(narrow, wide) else wide).tobytes()


def _unpacked(data: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of `size` components from their bytes, in double precision."""
    raw = data.to_pylist()
    for kind in ("<f4", "<f8"):
        if all(len(x) == size * int(kind[2]) for x in raw):
            return np.frombuffer(b"".join(raw), kind).reshape(len(raw), size).astype(np.float64)
    return np.array([np.frombuffer(x, "<f4" if len(x) == 4 * size else "<f8").astype(np.float64) for x in raw])


def _coded(vectors: DataFrame, similarity: float) -> DataFrame:
    """vectors (rep, label, size, data, vectors: of the label, times) with codes: the cell of each in every table."""
    schema = "rep bigint, label bigint, size int, data binary, times bigint, codes array<int>"

    def make():
        lines_of: dict[tuple[int, int, int], np.ndarray] = {}

        def f(batch: pa.RecordBatch) -> dict:
            shapes = np.c_[batch.column(2).to_numpy(), batch.column(4).to_numpy()]
            codes: list = [None] * batch.num_rows
            for size, count in np.unique(shapes, axis=0).tolist():
                rows = np.flatnonzero((shapes == (size, count)).all(axis=1))
                sides, tables = cells_of(count, similarity)
                key = size, sides, tables
                if key not in lines_of:
                    if len(lines_of) > 8:
                        lines_of.clear()
                    lines_of[key] = np.random.default_rng(SEED + 1).standard_normal((size, sides * tables))
                x = _unpacked(batch.column(3).take(pa.array(rows)), size)
                bits = (unit(x) @ lines_of[key] > 0).reshape(len(rows), tables, sides)
                for row, code in zip(rows.tolist(), (bits @ (1 << np.arange(sides))).astype(np.int32), strict=True):
                    codes[row] = code
            return {n: batch.column(i) for i, n in enumerate(("rep", "label", "size", "data"))} | {"times": batch.column(5), "codes": codes}

        return f

    return arrow_map(vectors.select("rep", "label", "size", "data", "vectors", "times"), make, schema)


_KEYS = ("label", "size", "k", "cell", "i", "j")
_LINKS = "rep bigint, links bigint, root bigint"


def _compared(members: DataFrame, similarity: float) -> DataFrame:
    """(rep, links, root) of vectors in blocks (i <= j) of cells, in order: weighted links first found in this table, and links that keep what is joined joined."""
    schema = arrow_schema(members.sparkSession, _LINKS)

    def run(batches):
        for table in whole_groups(batches, _KEYS):
            keys = [table.column(c).to_numpy() for c in _KEYS]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
            edges = np.append(np.flatnonzero(new), table.num_rows)
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if end - begin > 1:
                    got = _block(table.slice(begin, end - begin), similarity)
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], schema=schema)

    return members.mapInArrow(run, _LINKS)


def _block(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    rep, times, part = (group.column(n).to_numpy() for n in ("rep", "times", "part"))
    i, j, k = (group.column(n)[0].as_py() for n in ("i", "j", "k"))
    mine, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
    if not len(mine) or not len(other):
        return None
    vectors = unit(_unpacked(group.column("data"), group.column("size")[0].as_py()))
    a, b = linked(vectors[mine], vectors[other], similarity, i == j)
    a, b = mine[a], other[b]
    if k and len(a):  # a pair counts in the first table where it shares a cell
        codes = np.array(group.column("codes").to_pylist())
        fresh = np.ones(len(a), bool)
        for earlier in range(k):
            column = codes[:, earlier]
            fresh &= column[a] != column[b]
        a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    links = np.bincount(a, times[b], len(rep)) + np.bincount(b, times[a], len(rep))
    root = np.argsort(np.argsort(rep, kind="stable"), kind="stable")  # ranks by id, so that the least is the least id
    ids = np.sort(rep, kind="stable")
    while True:  # least id along the links, until nothing moves
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if np.array_equal(root, before):
            break
    found = np.flatnonzero(links > 0)
    return rep[found], np.rint(links[found]), ids[root[found]]


def near_duplicate_vectors(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine, in double precision, is at least
    `similarity`.  Null labels, null, empty and zero vectors, vectors with null, infinite or NaN
    components, and vectors of different lengths don't link.  Equal vectors of a label are compared
    once and counted as often as they occur; rows that repeat a vec_id count as rows.  component_id
    is the least vec_id reachable by links and kept says that it is the row's own.  A null vec_id is
    never a component's; its row has n_links and the component of its vector.  Other columns are
    dropped; an empty table gives an empty one.
    """
    bound_batches(rows.sparkSession)
    vectors = cut(_vectors(rows))
    known = vectors.filter(F.col("digest").isNotNull())
    texts = known.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("data").alias("data"), F.first("size").alias("size"))
    texts = cut(texts.select(F.monotonically_increasing_id().alias("rep"), "digest", "vec_id", "times", "label", "data", "size"))
    sizes = texts.groupBy("label", "size").agg(F.count("*").alias("vectors")).filter("vectors > 1")
    coded = cut(_coded(texts.select("rep", "label", "size", "data", "times").join(sizes, ["label", "size"]), similarity))
    cell = ["label", "size", "k", "cell"]
    celled = coded.select("rep", "label", "size", F.posexplode("codes").alias("k", "cell"))
    full = celled.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = celled.join(full, cell).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))
    members = members.withColumn("block", F.explode(pairs)).select(*cell, "block.i", "block.j", "part", "rep")
    members = members.join(coded.select("rep", "times", "data", "codes"), "rep")  # a vector's data travels once a block, after all else is known
    found = cut(_compared(members.repartition(*_KEYS).sortWithinPartitions(*_KEYS), similarity))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b")).withColumnRenamed("node", "rep")
    placed = texts.select("digest", "rep", "times", "vec_id").join(degree, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("c"))
    classes = placed.join(least, "component").select("digest", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "c")
    out = vectors.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Bounded samples of labelled texts to fit models on: rows of every label, excerpts of whole texts, a row an id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Characters of an excerpt and the pieces that it is made of, evenly spaced from a text's beginning to its end.
MAX_CHARS = 20_000
PIECES = 20
#: Labels that are learned at most, the most frequent first: what the driver and a model's classes are bounded by.
LABELS = 1000
FOLDS = 5
_SCALE = 1 << 30


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def excerpt(text: Column, chars: int = MAX_CHARS, pieces: int = PIECES) -> Column:
    """A text of up to `chars` characters whole; of a longer one, pieces from all over it."""
    width, n = chars // pieces, F.length(text)
    piece = lambda k: F.substring(text, 1 + F.floor((n - width) * k / (pieces - 1)).cast("int"), F.lit(width))
    return F.when(n > chars, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), piece), " ")).otherwise(text)


def _hash(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(_SCALE))


def pick(labelled: DataFrame, rows: int) -> tuple[list[tuple[int, object]], dict]:
    """((doc_id, label), ...) of at most `rows` ids of labelled (doc_id, label), and how many ids each label has, about.

    A tenth of the rows is shared equally by the labels, so that a rare one is learned, too, and the rest
    by their sizes; a label's ids are those of least hash.  Ids and labels that are null aren't picked, nor is the held-out fold; an id with several
    labels has the least.  Ids are first thinned by their hash, so that few are sorted.
    """
    known = labelled.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = known.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.col("n").desc(), "label").limit(LABELS)
    sizes = {r.label: max(1, r.n) for r in counts.collect()}
    if not sizes:
        return [], {}
    share = {label: max(1, int(rows * (0.1 / len(sizes) + 0.9 * n / sum(sizes.values())))) for label, n in sizes.items()}
    chance = {label: min(1.0, (1.2 * share[label] + 6 * math.sqrt(share[label]) + 20) / n) for label, n in sizes.items()}
    below = StructType([known.schema["label"], StructField("_below", LongType())])
    thin = labelled.sparkSession.createDataFrame([(label, int(p * _SCALE)) for label, p in chance.items()], below)
    few = known.withColumn("_h", _hash("doc_id")).join(F.broadcast(thin), "label").filter("_h < _below")  # LABELS rows at most
    few = few.groupBy("doc_id").agg(F.min("label").alias("label"), F.first("_h").alias("_h"))
    found: dict = {}
    for r in sorted(few.collect(), key=lambda r: (r._h, r.doc_id)):  # about 1.2 times `rows`
        mine = found.setdefault(r.label, [])
        if len(mine) < share[r.label]:
            mine.append((r.doc_id, r.label))
    return [x for label in sorted(found) for x in found[label]], sizes


def texts_of(docs: DataFrame, picked: list[tuple[int, object]], label_type: str, chars: int = MAX_CHARS) -> list[tuple]:
    """(doc_id, excerpt, label) of picked ids, one row each: of unlike texts of an id the least.  Ids without a text have no row."""
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, f"doc_id bigint, label {label_type}")
    found = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), excerpt(F.col("text"), chars).alias("text")).join(F.broadcast(ids), "doc_id")  # at most as many ids as were asked for
    least = found.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r"))
    return [(r.doc_id, r.r.text, r.r.label) for r in least.collect()]

"""Quality classifier by compression: zstandard dictionaries of good and bad text, and a calibrated size difference.

Text that resembles the good examples is compressed better with the dictionary built from those.
Each text is compressed whole, in blocks that are independent of each other: so the dictionary
matters to the end of a long text.  The difference of the two sizes, normalised, together with what
each dictionary saves, becomes a probability by a logistic fit on rows the dictionaries haven't seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, held, unused
from .sampling import FOLDS, fold, pick, texts_of

#: At most so many labelled rows are sampled, as many of each label.
SAMPLE_ROWS = 6000
DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK = 1024
PRIOR_BYTES = 16
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Sizer:
    """Features of a text: (bad - good) / larger; what the good and the bad dictionary save, and the plain size, a byte.

    Sizes are without what an empty block takes, and PRIOR_BYTES keep a few bytes of text from saying much.
    """

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        def compressor(data: bytes | None):
            dictionary = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **dictionary).compress

        self.each = [(f, len(f(b""))) for f in map(compressor, (good, bad, None))]

    def __call__(self, text: str) -> tuple[float, ...]:
        raw = text.encode()
        good, bad, plain = (sum(len(f(raw[i : i + BLOCK])) - frame for i in range(0, max(1, len(raw)), BLOCK)) for f, frame in self.each)
        n = len(raw) + PRIOR_BYTES
        return (bad - good) / (max(good, bad) + PRIOR_BYTES), (plain - good) / n, (plain - bad) / n, plain / n


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from too little text, its last bytes as they are."""
    import zstandard

    raw = [t.encode() for t in texts if t]
    total = sum(map(len, raw))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), [x for x in raw if len(x) >= 64]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(raw)[-size:] or b"-" * 64


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method on rows that count by their weight."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    rows = np.ones(len(x)) if weight is None else weight
    penalty = ridge * np.array([1.0] * (len(w) - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (rows * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[int, str, int]], sizes: dict[int, int] | None = None) -> QualityModel:
    """A model of (doc_id, text, quality) rows; sizes says how many documents each label stands for, so that scores are probabilities among those.

    The calibration learns from texts that the dictionaries haven't seen: each fifth of the rows is
    measured with dictionaries of the other four.  The model's own dictionaries are of all rows.
    """
    order = sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))

    def dictionaries(of: list) -> list[bytes]:
        return [dictionary([t for _, t, q in of if q == want]) for want in (1, 0)]

    features, labels = [], []
    for part in range(FOLDS):
        seen, unseen = ([r for k, r in enumerate(order) if (k % FOLDS == part) == out] for out in (False, True))
        sizer = Sizer(*dictionaries(seen))
        features += [sizer(t) for _, t, _ in unseen]
        labels += [float(q) for *_, q in unseen]
    if not labels:
        return QualityModel(*dictionaries([]), np.zeros(4), np.ones(4), np.zeros(5))
    y = np.array(labels)
    share = {q: (sizes or {}).get(int(q), (y == q).sum()) / (y == q).sum() for q in set(labels)}
    weight = np.array([share[q] for q in labels])
    x = np.array(features)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return QualityModel(*dictionaries(order), mean, scale, fit_logistic((x - mean) / scale, y, weight / weight.mean()))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """(doc_id, excerpt, quality) of at most `rows` labelled ids outside the held-out fold, as many of each label; and the labels' sizes.

    Rows without an id, a text or a label of 0 or 1 aren't picked; of an id's labels the least counts.
    """
    picked, sizes = pick(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")), rows)
    return texts_of(docs, picked, "int"), sizes


def with_score(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    """All columns of docs and the score of text, under a name that docs hasn't."""
    position = docs.columns.index("text")
    schema = extended(docs.schema, f"{name} double")

    def make():
        held("quality")
        sizer = Sizer(model.good, model.bad)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([sizer(t or "") for t in batch.column(position).to_pylist()])
            z = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

        return f

    return arrow_map(docs, make, schema, text_col=position)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text is scored as empty text.  Only the text decides: equal texts get equal scores, rows
    that repeat stay; a score that ties with the threshold is predicted 1.  Other columns are
    dropped; an empty table gives an empty one.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), model, "_score")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, **options) -> QualityModel:
    """A model of a bounded sample of the labelled rows; without any, one that gives every text 0.5."""
    return train(*labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), **options))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and scores every document."""
    return score(docs, fit(docs, labels))


def drop_low_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score the threshold or more, ties included, with their columns as they are.

    Null and empty texts are scored as empty; equal texts stay or go alike and rows that repeat stay.
    An empty table gives an empty one.
    """
    name = unused(docs, "_score")
    return with_score(docs, model, name).filter(F.col(name) >= threshold).drop(name)

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained on a bounded sample with follow-the-regularised-leader (FTRL-proximal) updates under
elastic-net penalties, so most weights are exactly zero; then the softmax is calibrated by a
temperature fitted on sampled rows that training hasn't seen.  Prediction reads whole texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, held, unused
from .sampling import fold, pick, texts_of

#: At most so many labelled rows are sampled, as many of each language.
SAMPLE_ROWS = 4000
#: n-grams of 1 to ORDERS characters, hashed to BUCKETS features.
ORDERS = 3
BITS = 15
BUCKETS = 1 << BITS
#: FTRL-proximal: learning rate, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
UNDETERMINED = "und"
MIN_SCORE = 0.4


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a whole text, lower-cased and between spaces, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 33, np.uint32(32), codes)
    rolled = codes
    total = np.zeros(BUCKETS, np.int64)
    for n in range(1, ORDERS + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        hashed = (rolled + np.uint32(n)) * np.uint32(2654435761)
        total += np.bincount(hashed >> np.uint32(32 - BITS), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found, n = counts_of(text)
        x = np.log1p(n) * self.idf[found]
        return found, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        found, x = self.features(text)
        return x @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS, classes) of rows (features, values, class), one update a row."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            found, x, label = rows[k]
            root = np.sqrt(n[found])
            w = weights(z[found], n[found])
            error = softmax(x @ w)
            error[label] -= 1
            g = np.outer(x, error)
            n[found] += g * g
            z[found] += g - (np.sqrt(n[found]) - root) / alpha * w
    return weights(z, n)


def train(rows: list[tuple[int, str, str]]) -> LanguageModel:
    """A model of (doc_id, text, lang) rows; every fifth row, in hash order, only sets the temperature."""
    rows = sorted((r for r in rows if any(map(str.isalpha, r[1]))), key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))
    languages = tuple(sorted({r[2] for r in rows}))
    if not rows:
        return LanguageModel((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    df = np.zeros(BUCKETS)
    for _, text, _ in rows:
        df[counts_of(text)[0]] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    blank = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), 1.0)
    made = []
    for _, text, lang in rows:
        found, x = blank.features(text)
        made.append((found.astype(np.int32), x.astype(np.float32), languages.index(lang)))
    learn = [r for k, r in enumerate(made) if k % 5] or made
    check = made[::5]
    weights = ftrl(learn, len(languages))
    z = np.array([x @ weights[found] for found, x, _ in check])
    y = np.array([label for *_, label in check])

    def loss(t: float) -> float:
        return -float(np.mean(np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12)))

    temperature = min(np.geomspace(0.25, 20, 200), key=loss)
    return LanguageModel(languages, idf, weights, float(temperature))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[int, str, str]]:
    """(doc_id, excerpt, lang) of at most `rows` ids with a language, outside the held-out fold, as many of each language."""
    picked, _ = pick(docs.select("doc_id", F.col("lang").alias("label")), rows)
    return texts_of(docs, picked, "string")


def fit(docs: DataFrame, **options) -> LanguageModel:
    """A model of a bounded sample of the rows with a language; without any, one that calls every text undetermined."""
    return train(labelled_sample(docs.select("doc_id", "text", "lang"), **options))


def with_language(docs: DataFrame, model: LanguageModel, lang_name: str, score_name: str) -> DataFrame:
    """All columns of docs and the prediction for text, under names that docs hasn't."""
    position = docs.columns.index("text")
    schema = extended(docs.schema, f"{lang_name} string, {score_name} double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times languages weights

    def make():
        held("language")
        predict = shared.value.predict

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [predict(t) for t in batch.column(position).to_pylist()]
            extra = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, lang_name, score_name])

        return f

    return arrow_map(docs, make, schema, text_col=position)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    A text that is null or has no letter is `und` with score 0.  Only the text decides: equal texts
    get equal predictions, of languages that score alike the first by name; rows that repeat stay.
    Other columns are dropped; an empty table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return with_language(plain, model, "lang_pred", "score").select("doc_id", held, "lang_pred", "score")


def languages(docs: DataFrame) -> DataFrame:
    """Trains on the rows with a language outside the held-out fold and predicts for every document."""
    return identify(docs, fit(docs))


def drop_undetermined(docs: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language that scores min_score or more, with their columns as they are.

    Texts that are null, empty or without a letter go; equal texts stay or go alike and rows that
    repeat stay; a score that ties with min_score stays.  An empty table gives an empty one.
    """
    lang_name, score_name = unused(docs, "_lang"), unused(docs, "_score")
    known = with_language(docs, model, lang_name, score_name).filter((F.col(lang_name) != UNDETERMINED) & (F.col(score_name) >= min_score))
    return known.drop(lang_name, score_name)

"""A training corpus from raw documents: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  run() writes every stage's result as Parquet to the shared folder and reads it again
as the next stage's docs, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlens.llm import language, minhash, packing, quality
from meshlens.llm.common import table, with_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts, too), or whose best language scores under language.MIN_SCORE; ties stay.

    Rows that repeat stay or go alike; columns stay as they are, whatever their names.
    """
    return language.drop_undetermined(docs, language.fit(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that score under quality.THRESHOLD; ties stay, null texts count as empty ones, rows that repeat stay or go alike."""
    return quality.drop_low_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id stays of each class of near-duplicates, one row of it; texts without a word and rows without an id all stay."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens; null and empty texts are their end token alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: The stages are trained models, signatures and tokenizers, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that the stages keep; an empty table of documents gives an empty one."""
    folder = f"{with_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

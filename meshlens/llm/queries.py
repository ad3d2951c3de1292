"""Registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens, as pack_documents() says; null texts are empty."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back, as encode_texts() says; null texts are empty."""
    from .bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back, as text_media() says; null texts are empty."""
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document, as near_duplicates() says; texts without a word are classes of their own."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every text, as token_counts() says; null texts are empty."""
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, as languages() says; `und` where a text has no letter."""
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, as extract_text() says; null pages are empty."""
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 with control strings, formatted, exploded into examples and read back.

    Null texts and roles are empty; tied turns are in the order of role and text; see chat.py.
    """
    from .chat import conversation_digests, examples, format_turns

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(examples(format_turns(turns.unionByName(probe))))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector, as near_duplicate_vectors() says."""
    from .embeddings import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text, as quality_scores() says; null texts are empty."""
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in windows of benchmark items, as contamination() says; null texts have no words."""
    from .inverted import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components, as cluster_report() says."""
    from .lloyd import cluster_report

    return cluster_report(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut between lines for filling in the middle, as fim_digests() says; null texts are empty."""
    from .fim import fim_digests

    return fim_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import chat, fim, inverted, lloyd

    return {
        "op8_chat_formatting": chat.DIGEST_SQL,
        "op11_benchmark_decontamination": inverted.CONTAMINATION_SQL,
        "op12_centroid_clustering": lloyd.report_sql(),
        "op13_fill_in_middle": fim.DIGEST_SQL,
    }

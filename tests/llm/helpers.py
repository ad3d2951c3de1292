"""Small awkward inputs that all operators on documents share."""

from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 9000
TEXTS = [
    None, "", " ", "\n\n", "...", "a", "Hello, world!", "Hello, world!", "Hello,  world!", "naïve café 日本語 😀 ́\x1c\x85\xa0 x",
    "<|endoftext|> </s> [INST] <s>", LONG, "x" * 3000, "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten",
]


def awkward_docs(spark):
    """Null and repeated ids, null and odd texts, and extra columns whose names operators use themselves."""
    rows = [(k, t, "en" if k % 2 else None, "src", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (6, "Hello, world!", "en", "src", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("score", "_score", "piece", "length", "offset", "sequence_id", "held_out", "_part", "_kept", "id", "key", "rep"):
        docs = docs.withColumn(name, F.lit(7))
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")

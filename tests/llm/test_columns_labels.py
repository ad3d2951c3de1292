"""Columns of any name pass through what keeps columns; samples of many labels."""

from pyspark.sql import functions as F

from meshlens.llm import language, minhash, packing, quality
from meshlens.llm.sampling import pick

from .helpers import awkward_docs, empty_docs

ODD = ["a`b.c", "`", "x y", "ä-ö", "select", "_lang_", "_h", "__at"]


def test_columns_of_any_name_pass(spark):
    docs = awkward_docs(spark)
    for name in ODD:
        docs = docs.withColumn(name, F.lit(5))
    labels = spark.createDataFrame([(5, 1), (8, 0)], "doc_id bigint, quality int")
    for stage in (lambda d: language.drop_undetermined(d, language.fit(d), 0.0), lambda d: quality.drop_low_quality(d, quality.fit(d, labels), 0.0), minhash.drop_near_duplicates):
        docs = stage(docs)
        assert set(ODD) <= set(docs.columns)
        assert docs.count() > 0
    packed = packing.pack(docs.withColumn("length", F.lit(7)))
    assert set(ODD) | {"sequence_id", "offset"} <= set(packed.columns) and packed.filter("sequence_id IS NULL").isEmpty()


def test_an_empty_table_passes_every_stage(spark):
    docs, labels = empty_docs(spark), spark.createDataFrame([], "doc_id bigint, quality int")
    assert language.drop_undetermined(docs, language.fit(docs)).count() == 0
    assert quality.drop_low_quality(docs, quality.fit(docs, labels)).count() == 0
    assert minhash.drop_near_duplicates(docs).count() == 0
    assert packing.pack_documents(docs).count() == 0


def test_samples_of_many_labels_and_of_rare_ones(spark):
    labelled = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 7, "rare").otherwise(F.concat(F.lit("l"), F.col("id") % 900)).alias("label"))
    picked, sizes = pick(labelled, 4000)
    assert len(sizes) == 901 and {label for _, label in picked} == set(sizes)
    assert len(picked) <= 4000 + 901


def test_checkpointed_tables_are_not_broadcast_unasked(spark):
    """However small Spark takes a table for: the driver would hold each that is under the limit."""
    from meshlens.llm.common import cut
    from meshlens.llm.minhash import near_duplicates

    one = cut(spark.range(100).toDF("a"))
    assert "Broadcast" not in one.join(spark.range(5).toDF("a"), "a")._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(k, f"the quick brown fox {k // 2} jumps over lazy dogs and runs home at night") for k in range(40)], "doc_id bigint, text string")
    assert "Broadcast" not in near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()

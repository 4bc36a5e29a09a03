"""Batches that go to Python are bounded by their bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from cohortweave.llm import quality_rules
from cohortweave.llm.rowmaps import PART_BYTES
from cohortweave.operators.shared import ARROW_BYTES, arrow_batches, written


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])


def test_batches_of_long_texts_are_bounded(spark):
    """By rows alone all 300 texts would come as one batch of 30 MB."""
    before = spark.conf.get(ARROW_BYTES, None)
    texts = spark.range(300, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = [r.n for r in written(texts.mapInArrow(_sizes, "n long"), "sizes", batch_bytes=1 << 20).collect()]
    assert sum(found) >= 30_000_000 and max(found) < 2 << 20
    assert spark.conf.get(ARROW_BYTES, None) == before


def test_smaller_bound_of_the_session_stays(spark):
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, "64k")
    try:
        with arrow_batches(spark, 1 << 20):
            assert spark.conf.get(ARROW_BYTES) in ("64k", "65536", "65536b")
        with arrow_batches(spark, 1 << 10):
            assert spark.conf.get(ARROW_BYTES) == "1024"
        assert spark.conf.get(ARROW_BYTES) in ("64k", "65536", "65536b")
    finally:
        spark.conf.set(ARROW_BYTES, before) if before is not None else spark.conf.unset(ARROW_BYTES)


def test_quality_rules_take_texts_in_small_batches(spark, monkeypatch):
    """The counts are made while the bound holds, and come out as without it."""
    seen = []
    made = quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda *a, **more: seen.append(more.get("batch_bytes")) or made(*a, **more))
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 10, "en") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert quality_rules.judged_documents(docs, labels).count() == 50
    assert quality_rules.kept_documents(docs, labels).count() <= 50
    assert seen.count(PART_BYTES) == 3  # counts, and shares of both

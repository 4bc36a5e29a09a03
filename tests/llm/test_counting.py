"""Counts of phrases travel as a few packed rows, and no key that reaches the threshold is lost on the way."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import phrase_mining as pm


@pytest.mark.parametrize(("slices", "least"), [(1, 1), (7, 10), (211, 300)])
def test_packed_counts_are_summed(slices, least):
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 64, 400, dtype=np.uint64)
    parts, whole = [], Counter()
    for _ in range(5):
        keys = pool[draw.integers(0, 400, 3_000) ** 2 // 400]
        whole.update(keys.tolist())
        parts.append(pm._packed(*np.unique(keys, return_counts=True), 2, slices, least))
    rows = pa.Table.from_batches(parts)
    assert rows.num_rows <= 5 * slices
    found, reached = {}, set()
    for part in set(rows["slice"].to_pylist()):
        (made,) = pm._summed(least)(rows.filter(pa.compute.equal(rows["slice"], part))).to_pylist()
        keys = np.frombuffer(made["keys"], np.uint32).tolist()
        found |= {(part, k): n for k, n in zip(keys, np.frombuffer(made["n"], pm._count_type(least)).tolist())}
        reached |= set(np.frombuffer(made["reached"], np.uint32).tolist())
    wanted = {(((k >> 32) * slices) >> 32, k & 0xFFFFFFFF): min(n, least) for k, n in whole.items()}
    assert found == wanted
    assert reached == {k & ((1 << pm.SLOT_BITS) - 1) for k, n in whole.items() if n >= least}


def test_counts_leave_a_task_in_few_rows(spark):
    """20,000 different words and as many pairs: not a row for each."""
    texts = spark.range(200).select(F.lit("en").alias("lang"), F.expr("array_join(transform(sequence(0, 99), x -> 'w' || (id * 100 + x)), ' ')").alias("text"))
    ready = [spark.sparkContext.broadcast(np.zeros(1 << pm.SLOT_BITS, dtype=np.uint8)) for _ in range(2)]
    rows = pm._scan(texts.coalesce(1), 0, 2, ready, 4, 10).collect()
    assert len(rows) <= 3 * 4
    assert {w: sum(len(r["keys"]) for r in rows if r["words"] == w) // 4 for w in (1, 2)} == {1: 20_000, 2: 19_800}


def test_counts_in_one_slice(spark):
    docs = spark.createDataFrame([(i, f"common word n{i} common word. rare{i} thing", None) for i in range(12)], "doc_id long, text string, lang string")
    wanted = {"common": 24, "word": 24, "common word": 24, "thing": 12}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        frequent, totals = pm.frequent_phrases(docs)
        assert {r.phrase: r.f for r in frequent.collect()} == wanted
        assert [(r.lang, r.n) for r in totals.collect()] == [("und", 84)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

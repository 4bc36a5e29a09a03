import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortweave.operators import batching as bt
from cohortweave.operators import ranking as rk
from cohortweave.sources import tables


def one_pass(sizes, limit):
    """Batches of one pass over all groups."""
    batches, fill = [], None
    for n in sizes:
        if fill is None or fill + n > limit:
            batches.append(0 if not batches else batches[-1] + 1)
            fill = n
        else:
            batches.append(batches[-1])
            fill += n
    return batches


def in_chunks(sizes, limit, chunk_rows):
    chunks = [np.array(sizes[i : i + chunk_rows]) for i in range(0, len(sizes), chunk_rows)]
    outcomes = pd.concat([bt._chunk_outcomes(i, c, limit) for i, c in enumerate(chunks)])
    assert outcomes.groupby("chunk").size().max() <= limit + 1
    entries = bt._enter_chunks(outcomes, limit)
    out = []
    for (_, entry), chunk in zip(entries.iterrows(), chunks):
        out += list(bt._assign_chunk(pd.DataFrame({"n": chunk}), int(entry["fill"]), int(entry["opened"]), limit))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 17))
def test_chunks_give_the_batches_of_one_pass(sizes, limit, chunk_rows):
    batches = in_chunks(sizes, limit, chunk_rows)
    assert batches == one_pass(sizes, limit)
    totals = pd.Series(sizes).groupby(batches).agg(["sum", "count"])
    assert ((totals["sum"] <= limit) | (totals["count"] == 1)).all()


@pytest.mark.parametrize("sizes, batches", [([5, 18, 2, 25, 1], [0, 1, 1, 2, 3]), ([25, 3], [0, 1])])
@pytest.mark.parametrize("chunk_rows", [1, 2, 100])
def test_batches_of_whole_groups(spark, sizes, batches, chunk_rows):
    df = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(sizes)], "patient string, n long")
    packed = bt.pack_groups(df, "patient", "n", 20, chunk_rows).orderBy("patient").collect()
    assert [r.batch_id for r in packed] == batches


def test_every_series_has_the_batch_of_its_patient(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("patient_id"), F.col("id").alias("series_id"))
    batched = bt.batched_cohort(df, limit=30, chunk_rows=3)
    assert batched.count() == 100
    assert batched.groupBy("patient_id").agg(F.count_distinct("batch_id").alias("n")).where("n > 1").isEmpty()


def test_shards_are_full_but_the_last(spark, folder, rows):
    df = spark.range(100, 117).withColumnRenamed("id", "patient_id")
    shards = bt.fixed_size_shards(df, "patient_id", 8)
    assert rows(shards.groupBy("shard_id").count()) == [(0, 8), (1, 8), (2, 1)]
    tables.write_fixed_shards(shards, f"{folder}/s")
    assert rows(spark.read.parquet(f"{folder}/s").groupBy("shard_id").count()) == [(0, 8), (1, 8), (2, 1)]
    assert rows(shards.where("shard_id = 2"), "patient_id", "record_no") == [(116, 16)]


def test_splits(spark, rows):
    df = spark.range(1000).withColumnRenamed("id", "patient_id")
    twice = df.unionByName(df)
    by_key = bt.split_by_key(twice, "patient_id", seed=5)
    assert by_key.groupBy("patient_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    split_counts = lambda df: df.groupBy("split").count()
    counts = dict(rows(split_counts(by_key)))
    assert 1500 < counts["train"] < 1700 and set(counts) == {"train", "val", "test"}
    assert dict(rows(split_counts(bt.split_by_position(df, "patient_id")))) == {"train": 800, "val": 100, "test": 100}


def test_sample_batches(spark, rows):
    df = spark.range(70).withColumnRenamed("id", "k")
    assert rows(bt.sample_batches(df, "k", 32).groupBy("batch_id").count()) == [(0, 32), (1, 32), (2, 6)]


def test_global_numbers_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    numbered = rk.global_row_number(df.repartition(5), ["k"], "no")
    assert numbered.count() == 5000
    assert numbered.where("no <> k + 1").isEmpty()


def test_ranks_of_a_hot_group_and_of_null(spark):
    """One group has a third of the rows, one has a NULL key."""
    group = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN NULL ELSE concat('g', id % 11) END AS g"
    df = spark.range(3000).selectExpr(group, "id * 7 % 3001 AS v", "id")
    ranked = rk.rank_within(df, ["g"], ["v"], "place").toPandas()
    expected = ranked.groupby("g", dropna=False)["v"].rank(method="first").astype(int)
    assert len(ranked) == 3000 and (ranked["place"] == expected).all()


def test_lists_come_whole_in_bounded_blocks(spark):
    df = spark.range(40).selectExpr("IF(id < 30, 'a', 'b') AS g", "id AS v", "id * 2 AS w")
    blocks = rk.list_blocks(df, ["g"], ["v"], ["v", "w"], "entries", block_rows=8).collect()
    assert max(r.n_entries for r in blocks) == 8
    joined = [(r.g, e.v, e.w) for r in sorted(blocks, key=lambda r: (r.g, r.block_no)) for e in r.entries]
    assert joined == [("a" if i < 30 else "b", i, 2 * i) for i in range(40)]


def test_large_and_null_keys_keep_their_rows(spark):
    big = 2**53
    df = spark.createDataFrame([(big + 1, 1), (big + 3, 2), (big + 1, 3), (None, 4)], "patient_id long, series_id int")
    got = {r.series_id: (r.patient_id, r.batch_id) for r in bt.batched_cohort(df, limit=2).collect()}
    assert got == {1: (big + 1, 0), 3: (big + 1, 0), 2: (big + 3, 1), 4: (None, None)}

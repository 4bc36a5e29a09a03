"""What goes on from run to run: sketches, batches, buckets, counts; and the buffered shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import batching as bt
from cohortweave.operators import reports as rp
from cohortweave.operators import samples as sm
from cohortweave.operators.shared import new_path
from cohortweave.sources import tables

# --- sketches -----------------------------------------------------------------


def _files(spark):
    """Three descriptions of 5, 3,000 and 20,000 patients, each with several files, some without a patient."""
    rows = spark.range(60_000).selectExpr("CASE id % 3 WHEN 0 THEN 'few' WHEN 1 THEN 'some' END AS description", "concat('T', id % 2) AS time_point", "id")
    patient = F.when(F.col("description") == "few", F.col("id") % 5).when(F.col("description") == "some", F.col("id") % 3_000).otherwise(F.col("id"))
    return rows.withColumn("patient_id", F.when(F.col("id") % 11 > 0, patient))


def test_sketches_stay_within_their_error(spark):
    files = _files(spark)
    exact = {r.description: r.num for r in rp.patients_by_description(files).collect()}
    for lg_k, share in ((12, 0.065), (16, 0.0163)):  # four standard deviations
        about = {r.description: r.num for r in rp.sketched_patients(rp.patient_sketches(files, lg_k)).collect()}
        assert about.keys() == exact.keys() == {"few", "some", None}
        assert all(abs(about[d] - n) <= 1 + share * n for d, n in exact.items())


def test_sketches_take_in_new_files(spark):
    files = _files(spark)
    parts = [files.where(f"id % 7 {op} 3") for op in ("<", ">=")]
    merged = rp.merged_sketches(*[rp.patient_sketches(p) for p in parts], rp.patient_sketches(parts[0]))
    whole = rp.patient_sketches(files)
    for time_point in (None, "T1"):
        a, b = ({r.description: r.num for r in rp.sketched_patients(s, time_point).collect()} for s in (merged, whole))
        assert a == pytest.approx(b, rel=0.02)
    assert merged.agg(F.sum("n_files")).first()[0] == 60_000 + parts[0].count()
    assert rp.sketched_patients(rp.patient_sketches(files.limit(0))).count() == 0


def test_sketched_histogram(spark):
    draw = random.Random(4)
    images = [(k, [draw.gauss(k, 1) for _ in range(500)] + [None]) for k in range(40)] + [(0, None), (1, [])]
    df = spark.createDataFrame(images, "k int, pixels array<double>").repartition(6)
    exact = {r.bin: r.n for r in rp.pixel_histogram(df.where("pixels IS NOT NULL")).collect()}
    merged = rp.merged_pixel_sketches(rp.pixel_sketch(df, "k"))
    for sketch in (rp.pixel_sketch(df), merged):
        about = {r.bin: r.n for r in rp.sketched_histogram(sketch).collect()}
        below = lambda counts, i: sum(n for b, n in counts.items() if b < i)
        assert all(abs(below(about, i) - below(exact, i)) <= 0.015 * 20_000 for i in range(31))
    by_image = rp.sketched_histogram(rp.pixel_sketch(df, "k"), "k", bins=5).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert len(by_image) == 40 and all(abs(r.n - 500) <= 5 for r in by_image)
    flat = spark.createDataFrame([([2.0, 2.0],)], "pixels array<double>")
    assert [(r.bin, r.n) for r in rp.sketched_histogram(rp.pixel_sketch(flat)).collect()] == [(0, 2)]
    assert rp.sketched_histogram(rp.pixel_sketch(df.limit(0))).count() == 0


def test_one_scan_for_a_sketched_histogram(spark):
    df = rp.sketched_histogram(rp.pixel_sketch(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), pixels="embedding"))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


# --- batches --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_runs_one_after_another_equal_one_run(spark, seed):
    draw = random.Random(seed)
    rows = [(patient, k) for patient in range(90) for k in range(draw.choice([1, 2, 7, 19, 20, 21, 45]))]
    series = spark.createDataFrame(rows, "patient_id long, series_id long")
    cuts = [0, *sorted(draw.sample(range(1, 90), 3)), 90]
    log = spark.createDataFrame([], "patient_id long, n long, batch_id long")
    for a, b in zip(cuts[:-1], cuts[1:]):
        new = bt.continued_batches(series.where(F.col("patient_id") < b), log, chunk_rows=7)
        assert {r.patient_id for r in new.collect()} == set(range(a, b))
        log = spark.createDataFrame(log.collect() + new.collect(), log.schema)
    single = bt.pack_groups(series.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")), "patient_id", "n")
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, single.select("patient_id", "n", "batch_id").collect()))


def test_a_patient_of_the_log_keeps_its_batch(spark):
    log = spark.createDataFrame([(1, 18, 0), (5, 3, 1)], "patient_id long, n long, batch_id long")
    series = spark.createDataFrame([(1, 0)] * 30 + [(3, 0)] * 2 + [(None, 0)], "patient_id long, series_id long")
    assert [tuple(r) for r in bt.continued_batches(series, log).collect()] == [(3, 2, 1)]
    assert bt.continued_batches(series.where("patient_id = 1"), log).count() == 0


# --- buckets --------------------------------------------------------------------


def test_tables_in_buckets_join_without_a_shuffle(spark):
    sides = []
    for name, rows in (("left", spark.range(3_000).selectExpr("id % 700 AS patient_id", "id AS v")), ("right", spark.range(900).selectExpr("id AS patient_id", "id * 2 AS w"))):
        path = new_path(spark, f"buckets-{name}")
        sides.append(tables.write_bucketed(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=5))
    joined = sides[0].join(sides[1].hint("merge"), "patient_id").groupBy("patient_id").agg(F.sum("w").alias("w"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 700 and sides[0].count() == 3_000


# --- counts on the way ---------------------------------------------------------


def test_counts_come_with_the_write(spark, folder):
    rows = spark.range(100).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'bad' WHEN id % 7 = 0 THEN 'worse' WHEN id < 90 THEN 'ok' END AS status").repartition(6)
    counts = tables.write_counted(rows, f"{folder}/t", "status", ["ok", "bad", "worse", "never"])
    read = spark.read.parquet(f"{folder}/t").groupBy("status").count().collect()
    assert counts == {"": 100, "never": 0} | {r.status: r["count"] for r in read if r.status}
    assert tables.write_counted(rows.limit(0), f"{folder}/e", "status", ["ok"]) == {"": 0, "ok": 0}


# --- buffered shuffle -------------------------------------------------------------


@pytest.mark.parametrize("buffer", [1, 10, 64, 5_000])
def test_buffered_shuffle(spark, buffer):
    df = spark.range(2_000).selectExpr("id AS k", "CASE WHEN id % 3 > 0 THEN id % 3 END AS shard", "concat('x', id) AS v").repartition(7)
    rows = sm.buffered_shuffle(df, "k", "shard", buffer, seed=1).collect()
    again = sm.buffered_shuffle(df.repartition(2), "k", "shard", buffer, seed=1).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr) and len(rows) == 2_000
    for shard in (None, 1, 2):
        own = sorted((r.place, r.k) for r in rows if r.shard == shard)
        in_order = sorted(k for _, k in own)
        assert [p for p, _ in own] == list(range(len(own)))
        at = {k: i for i, k in enumerate(in_order)}
        assert all(abs(at[k] - p) < buffer and at[k] // buffer == p // buffer for p, k in own)
        assert buffer == 1 or [k for _, k in own] != in_order
    other = sm.buffered_shuffle(df, "k", "shard", buffer, seed=2).collect()
    assert buffer == 1 or sorted(map(tuple, other), key=repr) != sorted(map(tuple, rows), key=repr)
    assert sm.buffered_shuffle(df.limit(0), "k", "shard").count() == 0

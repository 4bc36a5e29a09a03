"""Hierarchy, batching and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.values import bucket_of
from cohortweave.operators import batching as bt
from cohortweave.operators import hierarchy as hi
from cohortweave.operators import series as sr
from cohortweave.operators.shared import new_path, written
from cohortweave.plans import jobs
from cohortweave.registry.base import (
    FEATURES_SQL,
    PATIENTS_SQL,
    SERIES_SQL,
    image_features,
    patient_sides,
    query,
    series,
    slices,
    table,
)
from cohortweave.sources import tables

# A study here is the orders of one year and one priority: its orders name many
# customers, which is the case the owner rule is for.
_SHARED_STUDIES_SQL = """
counted AS (SELECT l_orderkey AS series_id, count(*) AS n_slices FROM lineitem GROUP BY l_orderkey),
manifest AS (SELECT patient_id, study_id, series_id, n_slices FROM series JOIN counted USING (series_id)),
shared AS (
  SELECT patient_id, concat(study_id[-4:], '/', nation) AS study_id, series_id, n_slices
  FROM manifest JOIN (SELECT c_custkey AS patient_id, c_nationkey AS nation FROM customer) USING (patient_id)),
studies AS (
  SELECT study_id, min(patient_id) AS patient_id, min(patient_id) <> max(patient_id) AS conflict,
         count(*) AS n_series, CAST(sum(n_slices) AS BIGINT) AS n_slices
  FROM shared GROUP BY study_id)"""


def manifest(spark, sf_dir):
    counted = slices(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_slices"))
    return series(spark, sf_dir).select("patient_id", "study_id", "series_id").join(counted, "series_id")


def shared_studies(spark, sf_dir):
    """Series under studies shared by the patients of a nation, so studies have several patients."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), "c_nationkey")
    study = F.concat(F.right("study_id", F.lit(4)), F.lit("/"), F.col("c_nationkey").cast("string"))
    return manifest(spark, sf_dir).join(nation, "patient_id").select(
        "patient_id", study.alias("study_id"), "series_id", "n_slices"
    )


def patients(spark, sf_dir):
    return jobs.build_patients(*patient_sides(spark, sf_dir))[0]


@query(
    "study_rollup",
    f"WITH {SERIES_SQL}, {_SHARED_STUDIES_SQL} SELECT * FROM studies",
)
def study_rollup(spark, sf_dir):
    return hi.study_rollup(shared_studies(spark, sf_dir))


@query(
    "study_series",
    f"""WITH {SERIES_SQL}, {_SHARED_STUDIES_SQL}, ranked AS (
      SELECT study_id, series_id, (row_number() OVER (PARTITION BY study_id ORDER BY series_id) - 1) // 1000 AS block_no
      FROM shared)
    SELECT study_id, block_no, count(*) AS n_entries, string_agg(series_id, ' ' ORDER BY series_id) AS series_ids
    FROM ranked GROUP BY study_id, block_no""",
)
def study_series(spark, sf_dir):
    lists = hi.study_series(shared_studies(spark, sf_dir))
    return lists.withColumn("series_ids", F.array_join(F.col("series_ids").cast("array<string>"), " "))


@query(
    "patient_hierarchy",
    f"""WITH {SERIES_SQL}, {_SHARED_STUDIES_SQL}, owned AS (
      SELECT o.patient_id, s.study_id, s.series_id, s.n_slices FROM shared s
      JOIN (SELECT study_id, patient_id FROM studies) o USING (study_id)),
    ranked AS (
      SELECT *, (row_number() OVER (PARTITION BY patient_id ORDER BY study_id, series_id) - 1) // 1000 AS block_no
      FROM owned)
    SELECT patient_id, block_no, count(*) AS n_entries,
      string_agg(concat(study_id, ':', series_id, ':', n_slices), ' ' ORDER BY study_id, series_id) AS manifest
    FROM ranked GROUP BY patient_id, block_no""",
)
def patient_hierarchy(spark, sf_dir):
    lists = hi.patient_hierarchy(shared_studies(spark, sf_dir))
    line = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("study_id", "series_id", "n_slices")])
    return lists.withColumn("manifest", F.array_join(F.transform("manifest", line), " "))


@query(
    "patient_rollup",
    f"""WITH {SERIES_SQL}, {_SHARED_STUDIES_SQL} SELECT patient_id, count(*) AS n_studies,
      CAST(sum(n_series) AS BIGINT) AS n_series, CAST(sum(n_slices) AS BIGINT) AS n_slices,
      count(*) FILTER (conflict) AS n_conflicts FROM studies GROUP BY patient_id""",
)
def patient_rollup(spark, sf_dir):
    return hi.patient_rollup(hi.study_rollup(shared_studies(spark, sf_dir)))


@query(
    "cohort_join",
    f"""WITH {SERIES_SQL}, {PATIENTS_SQL} SELECT patient_id, study_id, series_id, coalesce(age, -1) AS age, pcr,
      CAST(rcb AS INT) AS rcb FROM series JOIN patients USING (patient_id)""",
)
def cohort_join(spark, sf_dir):
    known = patients(spark, sf_dir).select(
        "patient_id",
        F.coalesce("demographic.age", F.lit(-1.0)).alias("age"),
        F.col("outcome.pCR").alias("pcr"),
        F.col("outcome.RCB").alias("rcb"),
    )
    return hi.cohort_join(series(spark, sf_dir).select("patient_id", "study_id", "series_id"), known)


@query(
    "bucketed_cohort_join",
    f"""WITH {SERIES_SQL}, {PATIENTS_SQL} SELECT patient_id, count(*) AS n_series, max(CAST(rcb AS INT)) AS rcb
    FROM series JOIN patients USING (patient_id) GROUP BY patient_id""",
)
def bucketed_cohort_join(spark, sf_dir):
    """Series and patients in buckets of one key: joined and counted without a shuffle."""
    known = patients(spark, sf_dir).select("patient_id", F.col("outcome.RCB").alias("rcb"))
    sides = []
    for name, rows in (("series", series(spark, sf_dir).select("patient_id", "series_id")), ("patients", known)):
        path = new_path(spark, f"{name}-buckets")
        sides.append(tables.write_bucketed(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=8))
    joined = sides[0].join(sides[1].hint("merge"), "patient_id")
    return joined.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_series"), F.max("rcb").alias("rcb"))


@query(
    "cohort_unmatched",
    f"""WITH {SERIES_SQL}, {PATIENTS_SQL} SELECT DISTINCT 'study' AS side, CAST(patient_id AS VARCHAR) AS patient_id, study_id
    FROM series WHERE patient_id NOT IN (SELECT patient_id FROM patients) UNION ALL
    SELECT 'patient', CAST(patient_id AS VARCHAR), NULL FROM patients
    WHERE patient_id NOT IN (SELECT patient_id FROM series)""",
)
def cohort_unmatched(spark, sf_dir):
    return hi.cohort_unmatched(series(spark, sf_dir), patients(spark, sf_dir))


@query(
    "feature_dedup",
    f"""WITH {FEATURES_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY patient_id, feature_name ORDER BY study_id DESC, series_id DESC) AS place,
             count(*) OVER (PARTITION BY patient_id, feature_name) - 1 AS n_collisions FROM features)
    SELECT patient_id, feature_name, study_id, series_id, series_id AS value, n_collisions FROM ranked WHERE place = 1""",
)
def feature_dedup(spark, sf_dir):
    return sr.feature_dedup(image_features(spark, sf_dir).withColumn("value", F.col("series_id")))


COHORT_MANIFEST_SQL = f"""WITH {SERIES_SQL}, {PATIENTS_SQL}, per_series AS (
  SELECT l_orderkey AS series_id, count(*) AS n_slices,
         min(CASE WHEN l_discount <> 0 THEN CAST(l_linenumber AS DOUBLE) END) AS z_lo,
         max(CASE WHEN l_discount <> 0 THEN CAST(l_linenumber AS DOUBLE) END) AS z_hi FROM lineitem GROUP BY l_orderkey),
per_patient AS (
  SELECT patient_id, count(DISTINCT study_id) AS n_studies, count(*) AS n_series, CAST(sum(n_slices) AS BIGINT) AS n_slices,
         min(z_lo) AS z_lo, max(z_hi) AS z_hi FROM series JOIN per_series USING (series_id) GROUP BY patient_id)
SELECT patient_id, n_studies, n_series, n_slices, z_lo, z_hi, coalesce(age, -1) AS age,
       CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS response_group
FROM per_patient JOIN patients USING (patient_id)"""


@query("cohort_manifest", COHORT_MANIFEST_SQL)
def cohort_manifest(spark, sf_dir):
    return jobs.cohort_manifest(slices(spark, sf_dir), series(spark, sf_dir), patients(spark, sf_dir))


_TEXT_IDS = "CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_custkey AS STRING), 9, '0') WHEN o_orderkey % 97 = 0 THEN 'unnamed' ELSE CAST(o_custkey AS STRING) END"


@query(
    "subject_owner",
    f"""WITH named AS (
      SELECT o_orderkey AS series_id, concat(o_custkey // 2, '-', year(o_orderdate)) AS study_id,
             TRY_CAST({_TEXT_IDS.replace('AS STRING', 'AS VARCHAR')} AS BIGINT) AS patient FROM orders),
    owners AS (SELECT study_id, min(patient) AS patient_id, coalesce(min(patient) <> max(patient), false) AS conflict FROM named GROUP BY study_id)
    SELECT series_id, study_id, patient_id, conflict FROM named JOIN owners USING (study_id)""",
)
def subject_owner(spark, sf_dir):
    """Ids with leading zeros and studies of two patients: numbers first, then one owner."""
    named = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS series_id", "concat_ws('-', o_custkey div 2, year(o_orderdate)) AS study_id", f"{_TEXT_IDS} AS patient_id", "1L AS n_slices"
    )
    owned = hi.owned_series(hi.with_subject(named))
    return owned.select("series_id", "study_id", "patient_id", F.coalesce("owner_conflict", F.lit(False)).alias("conflict"))


# --- batching and sinks ------------------------------------------------------------


@query(
    "batched_cohort",
    f"""WITH RECURSIVE {SERIES_SQL}, sizes AS (
      SELECT patient_id, count(*) AS n, row_number() OVER (ORDER BY patient_id) AS seq FROM series GROUP BY patient_id),
    packed AS (
      SELECT seq, patient_id, n AS fill, CAST(0 AS BIGINT) AS batch_id FROM sizes WHERE seq = 1 UNION ALL
      SELECT s.seq, s.patient_id, CASE WHEN p.fill + s.n > 20 THEN s.n ELSE p.fill + s.n END,
             CASE WHEN p.fill + s.n > 20 THEN p.batch_id + 1 ELSE p.batch_id END
      FROM packed p JOIN sizes s ON s.seq = p.seq + 1)
    SELECT patient_id, series_id, batch_id FROM series JOIN packed USING (patient_id)""",
)
def batched_cohort(spark, sf_dir):
    rows = series(spark, sf_dir).select("patient_id", "series_id")
    return bt.batched_cohort(rows, limit=20)


@query(
    "batches_continued",
    f"""WITH RECURSIVE {SERIES_SQL}, sizes AS (
      SELECT patient_id, count(*) AS n, row_number() OVER (ORDER BY patient_id) AS seq FROM series GROUP BY patient_id),
    packed AS (
      SELECT seq, patient_id, n, n AS fill, CAST(0 AS BIGINT) AS batch_id FROM sizes WHERE seq = 1 UNION ALL
      SELECT s.seq, s.patient_id, s.n, CASE WHEN p.fill + s.n > 20 THEN s.n ELSE p.fill + s.n END,
             CASE WHEN p.fill + s.n > 20 THEN p.batch_id + 1 ELSE p.batch_id END
      FROM packed p JOIN sizes s ON s.seq = p.seq + 1)
    SELECT patient_id, n, batch_id FROM packed""",
)
def batches_continued(spark, sf_dir):
    """Three runs, each with more patients than the one before, and a log that grows: the batches of a single run."""
    path = new_path(spark, "batch-log")
    rows = series(spark, sf_dir).select("patient_id", "series_id")
    upto = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("most"))
    spark.createDataFrame([], "patient_id long, n long, batch_id long").write.parquet(path)
    for part in (0.3, 0.31, 1.0):
        arrived = rows.where(F.col("patient_id") <= upto.scalar() * part)
        new = written(bt.continued_batches(arrived, spark.read.parquet(path), limit=20), "batch-log-part")
        new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "batch_partitions",
    f"""WITH RECURSIVE {SERIES_SQL}, sizes AS (
      SELECT patient_id, count(*) AS n, row_number() OVER (ORDER BY patient_id) AS seq FROM series GROUP BY patient_id),
    packed AS (
      SELECT seq, n AS fill, n, CAST(0 AS BIGINT) AS batch_id FROM sizes WHERE seq = 1 UNION ALL
      SELECT s.seq, CASE WHEN p.fill + s.n > 500 THEN s.n ELSE p.fill + s.n END, s.n,
             CASE WHEN p.fill + s.n > 500 THEN p.batch_id + 1 ELSE p.batch_id END
      FROM packed p JOIN sizes s ON s.seq = p.seq + 1)
    SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_series FROM packed GROUP BY batch_id""",
)
def batch_partitions(spark, sf_dir):
    """Batches written by folder, one of them written again, and read back."""
    path = new_path(spark, "batches")
    batched = bt.batched_cohort(series(spark, sf_dir).select("patient_id", "series_id"), limit=500)
    tables.write_batches(batched, path, num_shards=2, spread="series_id")
    again = tables.read_batches(spark, path).where(F.col("batch_id") == 0)
    tables.write_batches(written(again, "batch-again"), path)
    counts = tables.read_batches(spark, path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_series"))
    return counts.select(F.col("batch_id").cast("bigint").alias("batch_id"), "n_series")


@query(
    "fixed_size_shards",
    f"""WITH {FEATURES_SQL}, {PATIENTS_SQL}, valid AS (
      SELECT DISTINCT patient_id FROM features JOIN patients USING (patient_id) WHERE pcr IS NOT NULL)
    SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS record_no,
           (row_number() OVER (ORDER BY patient_id) - 1) // 8 AS shard_id FROM valid""",
)
def fixed_size_shards(spark, sf_dir):
    valid = hi.cohort_join(
        image_features(spark, sf_dir).select("patient_id").distinct(),
        patients(spark, sf_dir).where(F.col("outcome.pCR").isNotNull()).select("patient_id"),
    )
    return bt.fixed_size_shards(valid, "patient_id", 8)


@query(
    "patient_shards",
    f"WITH {SERIES_SQL} SELECT count(*) AS n_records, count(DISTINCT patient_id) AS n_patients, 4 AS n_files FROM series",
)
def patient_shards(spark, sf_dir):
    path = new_path(spark, "patient-shards")
    tables.write_sharded(series(spark, sf_dir), path, 4, "patient_id")
    n_files = tables.shard_counts(spark, path).count()
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("patient_id").alias("n_patients"),
        F.lit(n_files).cast("int").alias("n_files"),
    )


@query(
    "shard_counts",
    """WITH numbered AS (SELECT row_number() OVER () - 1 AS k, count(*) OVER () AS total FROM customer)
    SELECT n_records, count(*) AS n_files FROM (SELECT k // (total // 4 + 1) AS shard, count(*) AS n_records FROM numbered GROUP BY shard)
    GROUP BY n_records""",
)
def shard_counts(spark, sf_dir):
    """Customers in four shard files of one folder, the last one shorter, counted by file."""
    path = new_path(spark, "shards")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows.coalesce(1).write.option("maxRecordsPerFile", rows.count() // 4 + 1).parquet(path)
    return tables.shard_counts(spark, path).groupBy("n_records").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "sample_batches",
    "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch_id FROM embeddings",
)
def sample_batches(spark, sf_dir):
    return bt.sample_batches(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 32)


@query(
    "split_assign",
    """SELECT c_custkey, CASE WHEN (c_custkey * 2654435761) % 100 < 80 THEN 'train'
      WHEN (c_custkey * 2654435761) % 100 < 90 THEN 'val' ELSE 'test' END AS split FROM customer""",
)
def split_assign(spark, sf_dir):
    bucket = F.pmod(F.col("c_custkey") * F.lit(2654435761), F.lit(100))
    return bt.split_by_key(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", bucket=bucket)


@query(
    "split_by_position",
    """SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= count(*) OVER () * 80 // 100 THEN 'train'
      WHEN row_number() OVER (ORDER BY c_custkey) <= count(*) OVER () * 90 // 100 THEN 'val' ELSE 'test' END AS split
    FROM customer""",
)
def split_by_position(spark, sf_dir):
    return bt.split_by_position(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(
    "split_hash",
    """WITH b AS (SELECT c_custkey, CAST('0x' || left(md5(concat(c_custkey, ':7')), 15) AS BIGINT) % 100 AS bucket FROM customer)
    SELECT *, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END AS split FROM b""",
)
def split_hash(spark, sf_dir):
    """The default split and the buckets behind it."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", bucket_of(F.col("c_custkey"), 100, 7).alias("bucket"))
    return bt.split_by_key(rows, "c_custkey", seed=7)

"""Sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.operators import batching as bt
from cohortweave.operators import samples as sm
from cohortweave.operators.shared import new_path
from cohortweave.plans import jobs
from cohortweave.registry.base import (
    FEATURES_SQL,
    PATIENTS_SQL,
    SLICES_SQL,
    image_features,
    patient_sides,
    query,
    slices,
    table,
)
from cohortweave.sources import tables

REQUIRED = ["time1/1_URGENT/image", "time1/2_HIGH/image", "time1/5_LOW/image"]
PREFERRED = ["time1/2_HIGH/image", "time1/5_LOW/image", "time1/1_URGENT/image", "time1/3_MEDIUM/image"]

LABELS_SQL = """
records AS (
  SELECT doc_id AS patient_id, CASE WHEN toxic = 0 THEN quality ELSE -1 END AS pcr, CAST(n_chars % 5 AS INT) AS rcb
  FROM labels JOIN documents USING (doc_id))"""


def records(spark, sf_dir):
    """Labels as results: a toxic document has no response, in output form -1."""
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("doc_id").alias("patient_id"),
            F.when(F.col("toxic") == 0, F.col("quality")).otherwise(-1).alias("pCR"),
            (F.col("n_chars") % 5).cast("int").alias("RCB"),
        )
    )


@query("labelled_only", f"WITH {LABELS_SQL} SELECT * FROM records WHERE pcr <> -1 AND rcb <> -1")
def labelled_only(spark, sf_dir):
    return sm.labelled_only(records(spark, sf_dir)).toDF("patient_id", "pcr", "rcb")


@query(
    "response_group",
    f"""WITH {LABELS_SQL} SELECT patient_id, CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS response_group
    FROM records""",
)
def response_group(spark, sf_dir):
    return records(spark, sf_dir).select(
        "patient_id", sm.response_group(F.col("pCR"), F.col("RCB")).alias("response_group")
    )


@query(
    "response_onehot",
    f"""WITH {LABELS_SQL}, grouped AS (
      SELECT patient_id, CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS g FROM records)
    SELECT patient_id, CAST(p AS INT) AS place, CAST(g = p + 1 AS INT)::DOUBLE AS value
    FROM grouped, (SELECT unnest([0, 1, 2]) AS p)""",
)
def response_onehot(spark, sf_dir):
    label = sm.one_hot(sm.response_group(F.col("pCR"), F.col("RCB")))
    cells = records(spark, sf_dir).select("patient_id", F.posexplode(label).alias("place", "value"))
    return cells.withColumn("value", F.col("value").cast("double"))


@query(
    "required_series",
    f"""WITH {FEATURES_SQL}, wanted AS (SELECT * FROM features WHERE feature_name IN {tuple(REQUIRED)})
    SELECT patient_id, study_id, series_id, feature_name FROM wanted WHERE patient_id IN (
      SELECT patient_id FROM wanted GROUP BY patient_id HAVING count(DISTINCT feature_name) = {len(REQUIRED)})""",
)
def required_series(spark, sf_dir):
    return sm.required_series(image_features(spark, sf_dir), REQUIRED)


_ORDER = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(PREFERRED))


@query(
    "preferred_series",
    f"""WITH {FEATURES_SQL}, ranked AS (
      SELECT *, CASE feature_name {_ORDER} END AS priority FROM features WHERE feature_name IN {tuple(PREFERRED)})
    SELECT patient_id, priority, feature_name, series_id FROM ranked
    QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY priority, series_id) = 1""",
)
def preferred_series(spark, sf_dir):
    return sm.preferred_series(image_features(spark, sf_dir), PREFERRED)


SAMPLES_SQL = (
    LABELS_SQL
    + """,
images AS (
  SELECT vec_id AS patient_id, label, CASE WHEN label = 0 THEN list_transform(embedding, lambda x: CAST(-10000 AS FLOAT))
    WHEN label = 1 THEN NULL WHEN label = 2 THEN embedding[1:60] ELSE embedding END AS pixels FROM embeddings),
rows AS (SELECT i.*, pcr, rcb FROM images i LEFT JOIN records r USING (patient_id)),
judged AS (
  SELECT *, CASE WHEN pixels IS NULL THEN 'no_image' WHEN list_min(pixels) = -10000 THEN 'absent_image'
                 WHEN len(pixels) <> 64 THEN 'wrong_shape' WHEN NOT coalesce(pcr <> -1 AND rcb <> -1, FALSE) THEN 'no_label'
            END AS reason FROM rows)"""
)


def sample_rows(spark, sf_dir):
    """Embeddings as 8 x 8 images; three classes stand for absent, missing and cut images."""
    label, pixels = F.col("label"), F.col("embedding")
    image = (
        F.when(label == 0, F.transform(pixels, lambda x: F.lit(-10000.0).cast("float")))
        .when(label == 1, F.lit(None).cast("array<float>"))
        .when(label == 2, F.slice(pixels, 1, 60))
        .otherwise(pixels)
    )
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patient_id"), image.alias("pixels"))
    return images.join(records(spark, sf_dir), "patient_id", "left")


@query(
    "sample_input",
    f"""WITH {SAMPLES_SQL} SELECT patient_id, CAST(p AS INT) AS place, CAST(pixels[p + 1] AS DOUBLE) AS value,
      CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS response_group
    FROM judged, (SELECT unnest(range(64)) AS p) WHERE reason IS NULL""",
)
def sample_input(spark, sf_dir):
    """Samples written by split, read back split by split and together."""
    path = new_path(spark, "samples")
    samples = bt.split_by_key(sm.sample_input(sample_rows(spark, sf_dir), 8, 8), "patient_id")
    samples.write.partitionBy("split").parquet(path)
    train, val, test = (tables.read_split(spark, path, mode) for mode in ("train", "val", "test"))
    everything = train.unionByName(val).unionByName(test)
    return everything.select("patient_id", "response_group", F.posexplode("pixels").alias("place", "value")).select(
        "patient_id", "place", F.col("value").cast("double").alias("value"), "response_group"
    )


@query("sample_quarantine", f"WITH {SAMPLES_SQL} SELECT patient_id, reason FROM judged WHERE reason IS NOT NULL")
def sample_quarantine(spark, sf_dir):
    return sm.sample_quarantine(sample_rows(spark, sf_dir), 8, 8)


@query("sample_take", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 2")
def sample_take(spark, sf_dir):
    return sm.sample_take(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 2, "vec_id")


@query(
    "sample_shuffle",
    """SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':3')), vec_id) - 1 AS place
    FROM embeddings""",
)
def sample_shuffle(spark, sf_dir):
    return sm.sample_shuffle(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", seed=3)


@query(
    "buffered_shuffle",
    """WITH numbered AS (
      SELECT vec_id, vec_id % 7 AS shard, (row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) - 1) // 20 AS buffer FROM embeddings)
    SELECT vec_id, shard, row_number() OVER (PARTITION BY shard ORDER BY buffer, md5(concat(CAST(vec_id AS VARCHAR), ':5'))) - 1 AS place
    FROM numbered""",
)
def buffered_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("shard"))
    return sm.buffered_shuffle(rows, "vec_id", "shard", buffer=20, seed=5)


@query(
    "label_names",
    "SELECT c_custkey, c_nationkey AS label, n_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def label_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return sm.label_names(rows, names).select("c_custkey", "label", "name")


_SIMPLIFIED_SQL = f"""WITH {FEATURES_SQL}, {PATIENTS_SQL}, wanted AS (
  SELECT * FROM features WHERE feature_name IN {tuple(REQUIRED)}),
whole AS (SELECT patient_id FROM wanted GROUP BY patient_id HAVING count(DISTINCT feature_name) = {len(REQUIRED)})
SELECT w.patient_id, study_id, series_id, feature_name, pcr, CAST(rcb AS INT) AS rcb,
       CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS response_group
FROM wanted w JOIN whole USING (patient_id) JOIN patients USING (patient_id) WHERE pcr IS NOT NULL AND rcb IS NOT NULL"""


@query("simplified_records", _SIMPLIFIED_SQL)
def simplified_records(spark, sf_dir):
    patients, _ = jobs.build_patients(*patient_sides(spark, sf_dir))
    rows = jobs.simplified_records(image_features(spark, sf_dir), patients, REQUIRED)
    return rows.withColumnsRenamed({"pCR": "pcr", "RCB": "rcb"})


# Middle slices have four pixels in 2 x 2 or 4 x 1; samples are 2 x 2, so the tall
# ones are resized: a column of four becomes two rows of means.
_TRAINING_SQL = f"""WITH {SLICES_SQL}, {FEATURES_SQL}, {PATIENTS_SQL}, ranked AS (
  SELECT *, CASE feature_name {_ORDER} END AS priority FROM features WHERE feature_name IN {tuple(PREFERRED)}),
chosen AS (
  SELECT patient_id, series_id FROM ranked
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY priority, series_id) = 1),
middle AS (
  SELECT patient_id, n_rows, list_transform(pixels, lambda x: CAST(x AS DOUBLE)) AS px
  FROM placed JOIN chosen USING (series_id) WHERE z_index = n_slices // 2 AND reason IS NULL),
shaped AS (
  SELECT patient_id, CASE WHEN n_rows = 2 THEN [px[1], px[3], px[2], px[4]]
    ELSE [px[1] * 0.5 + px[2] * 0.5, px[3] * 0.5 + px[4] * 0.5, px[1] * 0.5 + px[2] * 0.5, px[3] * 0.5 + px[4] * 0.5] END
    AS px FROM middle)
SELECT patient_id, CAST(p AS INT) AS place, CAST(CAST(px[p + 1] AS FLOAT) AS DOUBLE) AS value,
       CASE WHEN pcr = 1 THEN 1 WHEN rcb <= 2 THEN 2 ELSE 3 END AS response_group
FROM shaped JOIN patients USING (patient_id), (SELECT unnest(range(4)) AS p) WHERE pcr IS NOT NULL AND rcb IS NOT NULL"""


@query("training_samples", _TRAINING_SQL)
def training_samples(spark, sf_dir):
    patients, _ = jobs.build_patients(*patient_sides(spark, sf_dir))
    samples = jobs.training_samples(
        slices(spark, sf_dir), image_features(spark, sf_dir), patients, PREFERRED, height=2, width=2
    )
    return samples.select("patient_id", "response_group", F.posexplode("pixels").alias("place", "value")).select(
        "patient_id", "place", F.col("value").cast("double").alias("value"), "response_group"
    )

"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions import text as tx
from cohortweave.operators import catalog as ct
from cohortweave.operators.shared import new_path
from cohortweave.registry.base import SERIES_SQL, query, series, slices, table
from cohortweave.sources import files, tables
from cohortweave.sources.text import read_header_csv

ROOT = "scheme://bucket/images/"
IMAGES = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]
SEGMENTS = ["5-LOW"]


@query(
    "metadata_scan",
    "SELECT o_orderkey AS series_id, o_orderpriority AS description, o_custkey AS patient_id FROM orders",
)
def metadata_scan(spark, sf_dir):
    path = new_path(spark, "metadata-csv")
    table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Patient Id"),
        F.col("o_orderstatus").alias("Modality"),
        F.col("o_orderkey").alias("Series UID"),
        F.col("o_orderpriority").alias("Series Description"),
    ).write.csv(path, header=True)
    names = {"Series UID": "series_id", "Series Description": "description", "Patient Id": "patient_id"}
    rows = read_header_csv(spark, path, names)
    return rows.select(
        F.col("series_id").cast("bigint").alias("series_id"),
        "description",
        F.col("patient_id").cast("bigint").alias("patient_id"),
    )


def _files(spark, sf_dir):
    """One row per image file, with the ids of its series and study."""
    ids = series(spark, sf_dir).select("study_id", "series_id", "patient_id", "description", "time_point")
    return slices(spark, sf_dir).select("series_id", "path").join(ids, "series_id")


@query(
    "distinct_series",
    f"WITH {SERIES_SQL} SELECT DISTINCT study_id, series_id FROM lineitem JOIN series ON l_orderkey = series_id",
)
def distinct_series(spark, sf_dir):
    return tables.distinct_series(_files(spark, sf_dir))


@query(
    "series_limit",
    f"""WITH {SERIES_SQL} SELECT DISTINCT study_id, series_id FROM lineitem JOIN series ON l_orderkey = series_id
    ORDER BY study_id, series_id LIMIT 100""",
)
def series_limit(spark, sf_dir):
    return tables.distinct_series(_files(spark, sf_dir), limit=100)


def _paths(spark, sf_dir):
    rows = series(spark, sf_dir)
    metadata = rows.select("series_id", "patient_id", "description")
    return ct.series_paths(metadata, rows.select("series_id", "study_id"), ROOT)


PATHS_SQL = SERIES_SQL + f""",
paths AS (SELECT patient_id, study_id, series_id, description, concat('{ROOT}', study_id, '/', series_id, '/') AS path
          FROM series)"""


@query("series_paths", f"WITH {PATHS_SQL} SELECT * FROM paths")
def series_paths(spark, sf_dir):
    return _paths(spark, sf_dir)


@query(
    "path_components",
    """SELECT page_id, string_split(url, '/')[3] AS bucket,
              coalesce(array_to_string(string_split(url, '/')[4:-2], '/'), '') AS prefix,
              string_split(url, '/')[-1] AS file_name, string_split(url, '/')[-2] AS parent FROM pages""",
)
def path_components(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        tx.path_bucket(url).alias("bucket"),
        tx.path_prefix(url).alias("prefix"),
        tx.path_file(url).alias("file_name"),
        tx.path_parent(url).alias("parent"),
    )


@query(
    "series_path_catalog",
    """SELECT concat('c_nationkey=', c_nationkey) AS study_id, concat('c_mktsegment=', c_mktsegment) AS series_id,
              CAST(1 AS BIGINT) AS n_files
       FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
def series_path_catalog(spark, sf_dir):
    """A tree of one file per (nation, segment), made from the customers and listed."""
    path = new_path(spark, "tree")
    (
        table(spark, sf_dir, "customer")
        .repartition("c_nationkey", "c_mktsegment")
        .select("c_name", "c_nationkey", "c_mktsegment")
        .write.partitionBy("c_nationkey", "c_mktsegment")
        .text(path)
    )
    return files.series_directories(files.list_files(spark, path, "*.txt")).drop("series_path")


@query("series_allowlist", f"WITH {PATHS_SQL} SELECT patient_id, path FROM paths WHERE description IN {tuple(IMAGES)}")
def series_allowlist(spark, sf_dir):
    metadata = series(spark, sf_dir).select("series_id", "description")
    return ct.keep_described(_paths(spark, sf_dir), metadata, IMAGES).select("patient_id", "path")


@query(
    "series_allowlist_batches",
    f"""WITH {PATHS_SQL}, ranked AS (
      SELECT patient_id, path, (row_number() OVER (PARTITION BY patient_id ORDER BY path) - 1) // 1000 AS block_no
      FROM paths WHERE description IN {tuple(IMAGES + SEGMENTS)})
    SELECT patient_id, block_no, count(*) AS n_entries, string_agg(path, ' ' ORDER BY path) AS paths
    FROM ranked GROUP BY patient_id, block_no""",
)
def series_allowlist_batches(spark, sf_dir):
    rows = series(spark, sf_dir)
    lists = ct.paths_by_patient(_paths(spark, sf_dir), rows.select("series_id", "description"), SEGMENTS + IMAGES)
    return lists.withColumn("paths", F.array_join("paths", " "))


@query(
    "series_subset",
    f"WITH {SERIES_SQL} SELECT study_id, series_id, description FROM series WHERE series_id IN (SELECT doc_id FROM labels)",
)
def series_subset(spark, sf_dir):
    subset = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("series_id"))
    return ct.series_subset(series(spark, sf_dir).select("study_id", "series_id", "description"), subset)


@query(
    "series_by_patient",
    f"""WITH {SERIES_SQL}, ranked AS (
      SELECT patient_id, series_id,
             (row_number() OVER (PARTITION BY patient_id ORDER BY series_id) - 1) // 1000 AS block_no FROM series)
    SELECT patient_id, block_no, count(*) AS n_entries, string_agg(series_id, ' ' ORDER BY series_id) AS series_ids
    FROM ranked GROUP BY patient_id, block_no""",
)
def series_by_patient(spark, sf_dir):
    lists = ct.series_by_patient(series(spark, sf_dir))
    return lists.withColumn("series_ids", F.array_join(F.col("series_ids").cast("array<string>"), " "))


@query(
    "empty_series",
    f"""WITH {SERIES_SQL} SELECT study_id, series_id, 'empty' AS status FROM series
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = series_id)""",
)
def empty_series(spark, sf_dir):
    return ct.empty_series(series(spark, sf_dir).select("study_id", "series_id"), slices(spark, sf_dir))

"""Queries over files written from the driver tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.functions.text import sibling_feature
from cohortweave.operators import catalog as ct
from cohortweave.operators.series import image_features
from cohortweave.operators.shared import new_path
from cohortweave.registry.base import SERIES_SQL, query, series, table
from cohortweave.sources import tables
from cohortweave.sources.files import AccessError, fetch_and_decode
from cohortweave.sources.slice_tree import slice_tree
from cohortweave.sources.text import read_description_counts, read_id_list


@query("sharded_read", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 20")
def sharded_read(spark, sf_dir):
    """Shards of two folders read together; a folder that is not named stays out."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    path = new_path(spark, "read-shards")
    parts = ("c_nationkey < 10", "c_nationkey BETWEEN 10 AND 19", "c_nationkey > 19")
    for i, part in enumerate(parts):
        tables.write_sharded(rows.where(part), f"{path}/{i}", 3, "c_custkey")
    return tables.read_shards(spark, [f"{path}/0", f"{path}/1"])


@query("id_list", f"WITH {SERIES_SQL} SELECT study_id, series_id FROM series WHERE series_id % 5 = 0")
def id_list(spark, sf_dir):
    """A subset given as a text file of ids, with blanks at the ends of lines."""
    path = new_path(spark, "id-list")
    ids = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("  ")).alias("value"))
    ids.write.text(path)
    subset = read_id_list(spark, path, "series_id").select(F.col("series_id").cast("bigint").alias("series_id"))
    return ct.series_subset(series(spark, sf_dir).select("study_id", "series_id"), subset)


@query("short_id_list", f"WITH {SERIES_SQL} SELECT study_id, series_id FROM series WHERE series_id IN (1, 2, 3, 7)")
def short_id_list(spark, sf_dir):
    return ct.series_subset(series(spark, sf_dir).select("study_id", "series_id"), [1, 2, 3, 7])


@query("description_counts", "SELECT p_type AS description, count(*) AS num FROM part GROUP BY p_type")
def description_counts(spark, sf_dir):
    """Counts as text in JSON files, typed when they are read."""
    path = new_path(spark, "counts-json")
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("SeriesDescription")).agg(F.count(F.lit(1)).cast("string").alias("num"))
    counted.coalesce(1).write.json(path)
    lines = spark.read.text(path).agg(F.array_join(F.collect_list("value"), ",").alias("all"))  # one row per part type
    lines.select(F.concat(F.lit("["), "all", F.lit("]")).alias("value")).coalesce(1).write.text(f"{path}-array")
    return read_description_counts(spark, f"{path}-array")


def _line_decoder(path: str, content: bytes) -> dict:
    """A stand-in for an image decoder: how many lines and bytes a file has."""
    return {"n_lines": content.count(b"\n"), "n_bytes": len(content)}


def _text_of(path: str) -> bytes:
    """Stands for a caller's own way to a file: paths carry their content here."""
    if path.endswith("missing"):
        raise AccessError("no such file")
    return path.encode()


@query(
    "fetch_status",
    """SELECT url AS path, CASE WHEN event_missing THEN NULL ELSE CAST(octet_length(encode(url)) AS BIGINT) END AS n_bytes,
      CASE WHEN event_missing THEN NULL ELSE CAST(0 AS BIGINT) END AS n_lines,
      CASE WHEN event_missing THEN 'access_error' ELSE 'ok' END AS status
    FROM (SELECT CASE WHEN page_id % 7 = 0 THEN concat(url, '/missing') ELSE url END AS url, page_id % 7 = 0 AS event_missing FROM pages)""",
)
def fetch_status(spark, sf_dir):
    """Files of a table of paths, fetched in the tasks; one in seven cannot be fetched."""
    paths = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/missing"))).otherwise(F.col("url")).alias("path"))
    schema = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_bytes", T.LongType())])
    return fetch_and_decode(paths, _line_decoder, schema, _text_of).drop("reason")


@query(
    "observed_failures",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'access_error' ELSE 'ok' END AS status FROM pages) GROUP BY status
    UNION ALL SELECT 'metadata_error', 0 UNION ALL SELECT '', count(*) FROM pages""",
)
def observed_failures(spark, sf_dir):
    """Failures counted while the rows are written."""
    counts = tables.write_counted(fetch_status(spark, sf_dir), new_path(spark, "counted"), "status", ["ok", "access_error", "metadata_error"])
    return spark.createDataFrame(list(counts.items()), "status string, n long")


@query(
    "slice_tree",
    """SELECT concat('c_nationkey=', c_nationkey) AS study_id, concat('c_mktsegment=', c_mktsegment) AS series_id,
      count(*) AS n_lines, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS n_bytes, count(DISTINCT c_custkey % 3) AS n_files
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3 GROUP BY c_nationkey, c_mktsegment""",
)
def slice_tree_of_customers(spark, sf_dir):
    """A tree made from the customers and read by a source that lists in tasks; series are named, one study is not wanted."""
    path = new_path(spark, "slice-tree")
    rows = table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_mktsegment", F.pmod("c_custkey", F.lit(3)).alias("third"))
    for third in range(3):
        part = rows.where(F.col("third") == third).drop("third").repartition("c_nationkey", "c_mktsegment")
        part.write.mode("append").partitionBy("c_nationkey", "c_mktsegment").text(path)
    wanted = slice_tree(spark, path, "*.txt", tasks=8, series=["c_mktsegment=BUILDING", "c_mktsegment=MACHINERY"])
    lines = F.size(F.split(F.decode("content", "utf-8"), "\n")) - 1
    return wanted.where("study_id <> 'c_nationkey=3'").groupBy("study_id", "series_id").agg(
        F.sum(lines).alias("n_lines"), F.sum("length").alias("n_bytes"), F.count(F.lit(1)).alias("n_files")
    )


@query(
    "sibling_features",
    f"""WITH {SERIES_SQL}, named AS (
      SELECT series_id, concat('image_', description, '/', unnest(['image', 'dx', 'dicom_id'])) AS feature_name FROM series)
    SELECT series_id, feature_name, concat(left(feature_name, length(feature_name) - 5), 'shape') AS sibling
    FROM named WHERE contains(feature_name, '/image')""",
)
def sibling_features(spark, sf_dir):
    """Only the last component of a name changes."""
    keys = F.explode(F.array(F.lit("image"), F.lit("dx"), F.lit("dicom_id"))).alias("key")
    named = series(spark, sf_dir).select("series_id", "description", keys).select(
        "series_id", F.concat(F.lit("image_"), "description", F.lit("/"), "key").alias("feature_name")
    )
    return image_features(named).withColumn("sibling", sibling_feature(F.col("feature_name"), "shape"))

"""Driver tables read as cohort tables, in Spark and in SQL.

patient = customer, study = (customer, year), series = order, slice = order line;
outcomes = labels with their documents, clinical rows = customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave import schemas as sc
from cohortweave.functions.text import description_flags, feature_name
from cohortweave.sources.text import parse_positional_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` and the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- series --------------------------------------------------------------------


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS patient_id",
        "concat_ws('-', o_custkey, year(o_orderdate)) AS study_id",
        "o_orderkey AS series_id",
        "o_orderpriority AS description",
        "o_orderstatus AS modality",
        "concat('T', quarter(o_orderdate)) AS time_point",
    )


SERIES_SQL = """
series AS (
  SELECT o_custkey AS patient_id, concat(o_custkey, '-', year(o_orderdate)) AS study_id, o_orderkey AS series_id,
         o_orderpriority AS description, o_orderstatus AS modality, concat('T', quarter(o_orderdate)) AS time_point
  FROM orders)"""

# --- slices --------------------------------------------------------------------


# Line numbers repeat within an order; with these columns a path names one line.
SLICE_PATH = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE), CAST(l_quantity AS INT),
  CAST(round(100 * l_extendedprice) AS BIGINT))"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = "l_tax = 0.08D AND l_returnflag = 'R'"
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{SLICE_PATH} AS path",
        "l_orderkey AS series_id",
        "concat('T', quarter(l_shipdate)) AS time_point",
        "CASE WHEN l_linestatus = 'F' THEN 'SEG' ELSE 'MR' END AS modality",
        "CASE WHEN l_returnflag = 'R' THEN 'R' WHEN l_returnflag = 'A' THEN '' END AS laterality",
        "CASE WHEN l_discount <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS slice_location",
        "CASE WHEN l_tax <> 0 THEN array(l_discount, l_tax, l_quantity) END AS position",
        "CASE WHEN l_linestatus = 'O' THEN array(1.0D, 0.0D, 0.0D, 0.0D, 1.0D, 0.0D) END AS orientation",
        "CASE WHEN l_returnflag <> 'A' THEN array(l_tax, l_discount) END AS pixel_spacing",
        "CASE WHEN l_returnflag = 'N' THEN l_quantity END AS slice_spacing",
        f"CASE WHEN {tall} THEN 4 ELSE 2 END AS rows",
        f"CASE WHEN {tall} THEN 1 ELSE 2 END AS cols",
        "CAST(array(l_quantity, l_extendedprice, l_discount, l_tax) AS ARRAY<FLOAT>) AS pixels",
        "CASE WHEN l_quantity = 50 AND l_discount = 0.1D THEN 'access_error' ELSE 'ok' END AS status",
    )


def slice_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices whose tags are in a map, as a decoder gives them; an absent tag has no entry."""
    tags = f"map('{sc.TAG_TIME}', time_point, '{sc.TAG_MODALITY}', modality, '{sc.TAG_LATERALITY}', laterality)"
    return slices(spark, sf_dir).selectExpr(
        "path", "series_id", f"map_filter({tags}, (tag, value) -> value IS NOT NULL) AS meta"
    )


def tagged_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices that also name their study, patient and description."""
    ids = series(spark, sf_dir).selectExpr("series_id", "study_id", "CAST(patient_id AS STRING) AS patient_id", "description")
    return slices(spark, sf_dir).join(ids, "series_id")


SLICES_SQL = """
slices AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE), CAST(l_quantity AS INTEGER), CAST(round(100 * l_extendedprice) AS BIGINT)) AS path, l_orderkey AS series_id,
         CASE WHEN l_discount <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS slice_location,
         CASE WHEN l_tax <> 0 THEN l_quantity END AS z,
         CASE WHEN l_tax <> 0 THEN [l_discount, l_tax, l_quantity] END AS position,
         CASE WHEN l_linestatus = 'O' THEN [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]::DOUBLE[] END AS orientation,
         CASE WHEN l_returnflag <> 'A' THEN [l_tax, l_discount] END AS pixel_spacing,
         CASE WHEN l_returnflag = 'N' THEN l_quantity END AS slice_spacing,
         CASE WHEN l_tax = 0.08 AND l_returnflag = 'R' THEN 4 ELSE 2 END AS n_rows,
         CASE WHEN l_tax = 0.08 AND l_returnflag = 'R' THEN 1 ELSE 2 END AS n_cols,
         [l_quantity::FLOAT, l_extendedprice::FLOAT, l_discount::FLOAT, l_tax::FLOAT] AS pixels,
         concat('T', quarter(l_shipdate)) AS tag_time,
         CASE WHEN l_linestatus = 'F' THEN 'SEG' ELSE 'MR' END AS tag_modality,
         CASE WHEN l_returnflag = 'R' THEN 'R' WHEN l_returnflag = 'A' THEN '' END AS tag_laterality,
         CASE WHEN l_quantity = 50 AND l_discount = 0.1 THEN 'access_error' ELSE 'ok' END AS status
  FROM lineitem),
facts AS (
  SELECT series_id, count(*) AS n_slices, count(slice_location) AS n_locations, count(z) AS n_positions,
         CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'failed_slice'
              WHEN min(n_rows) <> max(n_rows) OR min(n_cols) <> max(n_cols) THEN 'mixed_size' END AS reason
  FROM slices GROUP BY series_id),
placed AS (
  SELECT s.*, f.n_slices, f.reason,
         CASE WHEN n_locations = n_slices THEN 'location' WHEN n_positions = n_slices THEN 'position' ELSE 'path' END
           AS sort_source,
         row_number() OVER (PARTITION BY s.series_id ORDER BY
           CASE WHEN n_locations = n_slices THEN slice_location WHEN n_positions = n_slices THEN z END NULLS FIRST,
           path) - 1 AS z_index
  FROM slices s JOIN facts f USING (series_id))"""

MERGED_SQL = """
merged AS (
  SELECT series_id, count(*) AS n_slices,
         coalesce(min(CAST(o.patient_id AS VARCHAR)), 'UNKNOWN') AS patient_id, min(o.study_id) AS study_id,
         coalesce(min(nullif(tag_time, '')), 't-1') AS time,
         upper(translate(replace(min(o.description), 'ACRIN_6657/', ''), '.- ,', '____')) AS flags,
         coalesce(min(nullif(tag_laterality, '')), '') AS laterality, coalesce(min(nullif(tag_modality, '')), '') AS modality,
         coalesce(min(slice_spacing), -1.0) AS slice_spacing,
         coalesce(min(pixel_spacing), [-1.0, -1.0]::DOUBLE[]) AS pixel_spacing,
         coalesce(min(position), [-1.0, -1.0, -1.0]::DOUBLE[]) AS position,
         coalesce(min(orientation), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS orientation,
         CASE WHEN count(*) < 2 THEN 0.0 ELSE min(slice_location) END AS z_lo,
         CASE WHEN count(*) < 2 THEN 0.0 ELSE max(slice_location) END AS z_hi,
         max(n_rows) AS n_rows, max(n_cols) AS n_cols,
         coalesce(CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'failed_slice'
              WHEN min(n_rows) <> max(n_rows) OR min(n_cols) <> max(n_cols) THEN 'mixed_size' END, 'ok') AS status
  FROM slices s JOIN series o USING (series_id) GROUP BY series_id)"""

# --- image features of the series ------------------------------------------------


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = feature_name(
        F.col("time_point"), description_flags(F.col("description")), F.col("study_id"), F.col("series_id")
    )
    return series(spark, sf_dir).select(
        "patient_id", "study_id", "series_id", F.concat(name, F.lit("image")).alias("feature_name")
    )


FEATURES_SQL = SERIES_SQL + """,
features AS (
  SELECT patient_id, study_id, series_id,
         concat('time', substr(time_point, 2), '/', upper(translate(description, '.- ,', '____')), '/image') AS feature_name
  FROM series)"""

# --- patients --------------------------------------------------------------------


def _as_text(rows: DataFrame, fields: list[str], names: list[str]) -> DataFrame:
    return rows.selectExpr(*[f"coalesce(CAST({f} AS STRING), '') AS `{n}`" for f, n in zip(fields, names)])


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight fields of the outcome file as text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    fields = [
        "doc_id",
        "source",
        "toxic",
        "n_chars",
        "CASE WHEN NOT (quality = 0 AND toxic = 1) THEN n_chars DIV 2 END",
        "quality",
        "CASE WHEN toxic = 0 THEN quality END",
        "CASE WHEN n_chars > 5000 THEN 'n/a' ELSE CAST(n_chars % 5 AS STRING) END",
    ]
    return _as_text(table(spark, sf_dir, "labels").join(documents, "doc_id"), fields, sc.OUTCOME_COLUMNS)


def clinical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen fields of the clinical file as text; ids are padded."""
    fields = [
        "CASE WHEN c_acctbal < -500 THEN 'UNKNOWN' ELSE lpad(c_custkey, 9, '0') END",
        "''",
        "CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END",
        "c_nationkey",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END",
        "c_nationkey % 2",
        "CASE WHEN c_acctbal >= 0 THEN c_nationkey % 3 END",
        "length(c_mktsegment)",
        "c_nationkey % 4",
        "c_mktsegment",
        "''",
        "c_nationkey % 2 + 1",
        "CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 100) END",
        "CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(floor(c_acctbal) AS BIGINT) % 90 END",
        "c_nationkey + 10",
        "CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 1000) END",
    ]
    return _as_text(table(spark, sf_dir, "customer"), fields, sc.CLINICAL_COLUMNS)


def as_lines(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(f"concat_ws(',', {', '.join(f'`{c}`' for c in rows.columns)}) AS value")


def patient_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    outcomes = parse_positional_lines(as_lines(outcome_rows(spark, sf_dir)), sc.OUTCOME_COLUMNS)
    clinical = parse_positional_lines(as_lines(clinical_rows(spark, sf_dir)), sc.CLINICAL_COLUMNS)
    return outcomes, clinical


PATIENTS_SQL = """
outcomes AS (
  SELECT doc_id AS subject, source AS extract_date, toxic AS sstat, n_chars AS survival,
         CASE WHEN NOT (quality = 0 AND toxic = 1) THEN n_chars // 2 END AS rfs, quality AS rfs_ind,
         CASE WHEN toxic = 0 THEN quality END AS pcr,
         CASE WHEN n_chars <= 5000 THEN n_chars % 5 END AS rcb, n_chars > 5000 AS malformed
  FROM labels JOIN documents USING (doc_id)),
clinical AS (
  SELECT CASE WHEN c_acctbal >= -500 THEN c_custkey END AS subject,
         CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) END AS age, c_nationkey AS race,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS er, c_nationkey % 2 AS pg,
         CASE WHEN c_acctbal >= 0 THEN c_nationkey % 3 END AS hr, CAST(length(c_mktsegment) AS INT) AS her2, c_nationkey % 4 AS her3,
         c_nationkey % 2 + 1 AS side,
         CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 100) END AS ld0,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(floor(c_acctbal) AS BIGINT) % 90 END AS ld1,
         c_nationkey + 10 AS ld2,
         CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 1000) END AS ld3
  FROM customer),
joined AS (
  SELECT coalesce(CAST(o.subject AS VARCHAR), CAST(c.subject AS VARCHAR)) AS subject_id,
         coalesce(o.subject, c.subject) AS patient_id,
         o.* EXCLUDE (subject), c.* EXCLUDE (subject), o.subject AS o_subject, c.subject AS c_subject
  FROM outcomes o FULL JOIN (SELECT * FROM clinical WHERE subject IS NOT NULL) c ON o.subject = c.subject),
formatted AS (
  SELECT *, CASE WHEN c_subject IS NULL THEN 'missing_clinical' WHEN o_subject IS NULL THEN 'missing_outcome'
                 WHEN malformed THEN 'malformed_field' WHEN rfs IS NULL THEN 'missing_required' END AS reason
  FROM joined),
patients AS (SELECT * FROM formatted WHERE reason IS NULL)"""

"""Series to studies and patients, and patients to their clinical data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.ranking import list_blocks


def study_rollup(series: DataFrame) -> DataFrame:
    """Series and slices of every study, and the patient it belongs to.

    A study whose series name several patients goes to the least of them and is
    flagged.
    """
    return series.groupBy("study_id").agg(
        F.min("patient_id").alias("patient_id"),
        (F.min("patient_id") != F.max("patient_id")).alias("conflict"),
        F.count(F.lit(1)).alias("n_series"),
        F.sum("n_slices").cast("bigint").alias("n_slices"),
    )


def study_series(series: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """The series of every study as lists in blocks."""
    return list_blocks(series, ["study_id"], ["series_id"], ["series_id"], "series_ids", block_rows)


def patient_rollup(studies: DataFrame) -> DataFrame:
    return studies.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_studies"),
        F.sum("n_series").alias("n_series"),
        F.sum("n_slices").alias("n_slices"),
        F.count(F.when(F.col("conflict"), 1)).alias("n_conflicts"),
    )


def owned_series(series: DataFrame) -> DataFrame:
    """Series under the patient who owns their study, who is the least it names.

    Everything made of series by patient (batches, features, records, manifests,
    reports) starts from these, so that a study is never divided.
    """
    if "owner_conflict" in series.columns:  # done before
        return series
    owners = study_rollup(series).select("study_id", F.col("patient_id").alias("_owner"), F.col("conflict").alias("owner_conflict"))
    return series.alias("s").join(owners.alias("o"), F.expr("s.study_id <=> o.study_id")).select(
        *[F.col("_owner").alias(c) if c == "patient_id" else F.col(f"s.`{c}`") for c in series.columns], "owner_conflict"
    )


def patient_hierarchy(series: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """Manifests of every patient: (study, series, slices) in order, in blocks."""
    return list_blocks(
        owned_series(series),
        ["patient_id"],
        ["study_id", "series_id"],
        ["study_id", "series_id", "n_slices"],
        "manifest",
        block_rows,
    )


def _numeric_subject(series: DataFrame) -> DataFrame:
    return series.withColumn("patient_id", F.col("patient_id").try_cast("bigint"))


def with_subject(series: DataFrame) -> DataFrame:
    """Patient ids as numbers (``007`` is 7), with the id as it was named in ``subject``.

    An id that is no number is NULL; its series go to the unmatched report by name.
    """
    return _numeric_subject(series.withColumn("subject", F.col("patient_id").cast("string")))


def cohort_join(series: DataFrame, patients: DataFrame) -> DataFrame:
    """Series (or studies) of known patients, with the patient's data.

    Ids compare as numbers. A patient with very many series makes one partition of
    the left side large; runtime re-planning splits it, as the right side has one
    row per patient.
    """
    return _numeric_subject(series).join(patients, "patient_id")


def cohort_unmatched(series: DataFrame, patients: DataFrame) -> DataFrame:
    """Both sides without a partner: studies without a patient, patients without a study."""
    named = F.coalesce(F.col("patient_id").cast("string"), "subject") if "subject" in series.columns else F.col("patient_id")
    studies = series.select(
        F.col("patient_id").try_cast("bigint").alias("_id"), named.cast("string").alias("_named"), "study_id"
    ).distinct()
    known = patients.select("patient_id")
    lonely_studies = studies.join(known.withColumnRenamed("patient_id", "_id"), "_id", "left_anti").select(
        F.lit("study").alias("side"), F.col("_named").cast("string").alias("patient_id"), "study_id"
    )
    with_studies = studies.select(F.col("_id").alias("patient_id")).distinct()
    lonely_patients = known.join(with_studies, "patient_id", "left_anti").select(
        F.lit("patient").alias("side"),
        F.col("patient_id").cast("string").alias("patient_id"),
        F.lit(None).cast("string").alias("study_id"),
    )
    return lonely_studies.unionByName(lonely_patients)

"""Patients from outcome and clinical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.values import subject_key
from cohortweave.schemas import CLINICAL_COLUMNS, MISSING, OUTCOME_COLUMNS

KEY = "SUBJECTID"

_INT_FIELDS = {
    "race": "c.race_id",
    "ERpos": "c.ERpos",
    "Pgpos": "c.PgRpos",
    "HRpos": "c.`HR Pos`",
    "HER_two_status": "c.Her2MostPos",
    "three_level_HER": "c.HR_HER2_CATEGORY",
    "Bilateral": "c.BilateralCa",
    "Laterality": "c.Laterality",
    "ld_baseline": "c.`MRI LD Baseline`",
    "ld_post_ac": "c.`MRI LD 1-3dAC`",
    "ld_inter_reg": "c.`MRI LD InterReg`",
    "ld_pre_surgery": "c.`MRI LD PreSurg`",
    "Sstat": "o.sstat",
    "survival_duration": "o.`survDtD2 (tx)`",
    "rfs_ind": "o.rfs_ind",
    "rfs_duration": "o.RFS",
    "pCR": "o.PCR",
    "RCB": "o.RCBClass",
}
_READINGS = ["ld_baseline", "ld_post_ac", "ld_inter_reg", "ld_pre_surgery"]
_CLINICAL = ["ERpos", "Pgpos", "HRpos", "HER_two_status", "three_level_HER", "Bilateral", "Laterality"]
_REQUIRED = ["Sstat", "survival_duration", "rfs_ind", "rfs_duration"]
_OUTCOME = [*_REQUIRED, "pCR", "RCB"]


def _one_row_per_subject(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The least row of every subject, found with partial aggregates."""
    fields = ", ".join(f"`{c}`" for c in columns if c != KEY)
    return rows.groupBy(subject_key(F.col(KEY)).alias("subject_id")).agg(F.expr(f"min(struct({fields}))").alias(name))


def join_patient_rows(outcomes: DataFrame, clinical: DataFrame) -> DataFrame:
    """Outcome and clinical row of every subject; a side without a row is NULL."""
    return _one_row_per_subject(outcomes, OUTCOME_COLUMNS, "o").join(
        _one_row_per_subject(clinical, CLINICAL_COLUMNS, "c"), "subject_id", "full_outer"
    )


def _reason() -> str:
    fields = {**_INT_FIELDS, "age": "c.age"}
    malformed = " OR ".join(f"(nullif({source}, '') IS NOT NULL AND {name} IS NULL)" for name, source in fields.items())
    incomplete = " OR ".join(f"{name} IS NULL" for name in _REQUIRED)
    return f"""CASE WHEN patient_id IS NULL THEN 'bad_subject_id'
        WHEN c IS NULL THEN 'missing_clinical' WHEN o IS NULL THEN 'missing_outcome'
        WHEN {malformed} THEN 'malformed_field' WHEN {incomplete} THEN 'missing_required' END AS reason"""


def format_patients(joined: DataFrame) -> DataFrame:
    """Nested patients with a ``reason`` where a row cannot be one (else NULL).

    Empty text is a missing value. Text that is no number is a malformed field.
    """
    parsed = joined.selectExpr(
        "subject_id",
        "o",
        "c",
        "try_cast(subject_id AS BIGINT) AS patient_id",
        "try_cast(nullif(c.age, '') AS DOUBLE) AS age",
        *[f"try_cast(nullif({source}, '') AS INT) AS {name}" for name, source in _INT_FIELDS.items()],
    )
    return parsed.selectExpr(
        "subject_id",
        "patient_id",
        # The extraction date stands in both files; the clinical one wins.
        "coalesce(nullif(c.DataExtractDt, ''), nullif(o.DataExtractDt, '')) AS extract_date",
        "struct(age, race) AS demographic",
        f"struct({', '.join(_CLINICAL)}) AS clinical",
        f"array({', '.join(_READINGS)}) AS LD",
        f"struct({', '.join(_OUTCOME)}) AS outcome",
        _reason(),
    )


def valid_patients(formatted: DataFrame) -> DataFrame:
    return formatted.where(F.col("reason").isNull()).drop("reason", "subject_id")


def quarantined_patients(formatted: DataFrame) -> DataFrame:
    return formatted.where(F.col("reason").isNotNull()).select("subject_id", "reason")


def patient_features(patients: DataFrame) -> DataFrame:
    """Flat features in output form, where a missing value is -1."""
    missing = lambda source: f"coalesce({source}, {MISSING}) AS {source.split('.')[-1]}"
    return patients.selectExpr(
        "patient_id",
        missing("demographic.age"),
        missing("demographic.race"),
        *[missing(f"clinical.{c}") for c in _CLINICAL],
        *[missing(f"outcome.{c}") for c in _OUTCOME],
        f"transform(LD, x -> coalesce(x, {MISSING})) AS LD",
    )

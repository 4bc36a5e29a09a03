"""Patient queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.operators import patients as pt
from cohortweave.operators.shared import new_path
from cohortweave.plans.jobs import build_patients
from cohortweave.registry.base import PATIENTS_SQL, outcome_rows, patient_sides, query
from cohortweave.schemas import OUTCOME_COLUMNS
from cohortweave.sources.text import read_positional_csv


@query(
    "csv_positional_scan",
    f"""WITH {PATIENTS_SQL} SELECT CAST(subject AS VARCHAR) AS subject, extract_date, CAST(sstat AS VARCHAR) AS sstat,
      CAST(survival AS VARCHAR) AS survival, CAST(rfs AS VARCHAR) AS rfs, CAST(rfs_ind AS VARCHAR) AS rfs_ind,
      CAST(pcr AS VARCHAR) AS pcr, CASE WHEN malformed THEN 'n/a' ELSE CAST(rcb AS VARCHAR) END AS rcb FROM outcomes""",
)
def csv_positional_scan(spark, sf_dir):
    path = new_path(spark, "outcomes-csv")
    outcome_rows(spark, sf_dir).write.options(quote="", emptyValue="", header=True).csv(path)
    names = ["subject", "extract_date", "sstat", "survival", "rfs", "rfs_ind", "pcr", "rcb"]
    return read_positional_csv(spark, path, OUTCOME_COLUMNS).toDF(*names)


@query(
    "patient_join",
    f"""WITH {PATIENTS_SQL} SELECT subject_id, o_subject IS NOT NULL AS has_outcome, c_subject IS NOT NULL AS has_clinical
    FROM joined UNION ALL
    SELECT 'UNKNOWN', FALSE, TRUE WHERE EXISTS (SELECT 1 FROM clinical WHERE subject IS NULL)""",
)
def patient_join(spark, sf_dir):
    return pt.join_patient_rows(*patient_sides(spark, sf_dir)).select(
        "subject_id", F.col("o").isNotNull().alias("has_outcome"), F.col("c").isNotNull().alias("has_clinical")
    )


@query(
    "patient_format",
    f"""WITH {PATIENTS_SQL} SELECT patient_id, extract_date, age, race, er, pg, hr, her2, her3, CAST(NULL AS INT) AS bilateral,
      side, sstat, CAST(survival AS INT) AS survival, rfs_ind, CAST(rfs AS INT) AS rfs, pcr, CAST(rcb AS INT) AS rcb
    FROM patients""",
)
def patient_format(spark, sf_dir):
    patients, _ = build_patients(*patient_sides(spark, sf_dir))
    names = {
        "demographic.age": "age",
        "demographic.race": "race",
        "clinical.ERpos": "er",
        "clinical.Pgpos": "pg",
        "clinical.HRpos": "hr",
        "clinical.HER_two_status": "her2",
        "clinical.three_level_HER": "her3",
        "clinical.Bilateral": "bilateral",
        "clinical.Laterality": "side",
        "outcome.Sstat": "sstat",
        "outcome.survival_duration": "survival",
        "outcome.rfs_ind": "rfs_ind",
        "outcome.rfs_duration": "rfs",
        "outcome.pCR": "pcr",
        "outcome.RCB": "rcb",
    }
    return patients.select("patient_id", "extract_date", *[F.col(k).alias(v) for k, v in names.items()])


@query(
    "patient_ld_array",
    f"""WITH {PATIENTS_SQL} SELECT patient_id, p AS place, CAST(CASE p WHEN 0 THEN ld0 WHEN 1 THEN ld1 WHEN 2 THEN ld2
      ELSE ld3 END AS INT) AS reading FROM patients, (SELECT unnest([0, 1, 2, 3]) AS p)""",
)
def patient_ld_array(spark, sf_dir):
    patients, _ = build_patients(*patient_sides(spark, sf_dir))
    return patients.select("patient_id", F.posexplode("LD").alias("place", "reading"))


@query(
    "patient_features",
    f"""WITH {PATIENTS_SQL} SELECT patient_id, coalesce(age, -1) AS age, race, coalesce(hr, -1) AS hr, -1 AS bilateral,
      coalesce(pcr, -1) AS pcr, CAST(coalesce(rcb, -1) AS INT) AS rcb,
      CAST(coalesce(ld0, -1) + coalesce(ld1, -1) + coalesce(ld2, -1) + coalesce(ld3, -1) AS BIGINT) AS ld_total
    FROM patients""",
)
def patient_features(spark, sf_dir):
    patients, _ = build_patients(*patient_sides(spark, sf_dir))
    flat = pt.patient_features(patients)
    ld_total = F.aggregate("LD", F.lit(0).cast("bigint"), lambda total, x: total + x)
    return flat.select(
        "patient_id",
        "age",
        "race",
        F.col("HRpos").alias("hr"),
        F.col("Bilateral").alias("bilateral"),
        F.col("pCR").alias("pcr"),
        F.col("RCB").alias("rcb"),
        ld_total.alias("ld_total"),
    )


@query(
    "patient_quarantine",
    f"""WITH {PATIENTS_SQL} SELECT subject_id, reason FROM formatted WHERE reason IS NOT NULL UNION ALL
    SELECT 'UNKNOWN', 'bad_subject_id' WHERE EXISTS (SELECT 1 FROM clinical WHERE subject IS NULL)""",
)
def patient_quarantine(spark, sf_dir):
    _, quarantine = build_patients(*patient_sides(spark, sf_dir))
    return quarantine

import pytest
from pyspark.sql import functions as F

from cohortweave.functions import text as tx
from cohortweave.functions import values as vl
from cohortweave.operators import patients as pt
from cohortweave.plans.jobs import build_patients
from cohortweave.schemas import CLINICAL_COLUMNS, IMAGE_DESCRIPTIONS, OUTCOME_COLUMNS, PREFERRED_FEATURES


def value(spark, text, expression, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "description, flag",
    [
        ("T2-FSE-Unilat.-Sagittal", "T2_FSE_UNILAT__SAGITTAL"),
        ("ACRIN_6657/FL3D_T1_SAG_CA_", "FL3D_T1_SAG_CA_"),
        ("RT Sag FSE T2 - FatSat", "RT_SAG_FSE_T2___FATSAT"),
        ("", ""),
    ],
)
def test_description_flags(spark, description, flag):
    assert value(spark, description, tx.description_flags) == [flag]


def test_preferred_features_are_the_kept_descriptions(spark):
    df = spark.createDataFrame([(d,) for d in IMAGE_DESCRIPTIONS], "d string")
    name = F.concat(F.lit("time1/"), F.get(tx.description_flags(F.col("d")), F.lit(0)), F.lit("/image"))
    assert {r[0] for r in df.select(name).collect()} == set(PREFERRED_FEATURES)


def test_path_parts(spark):
    path = "gs://bucket/prefix/of/file.dcm"
    got = [value(spark, path, f) for f in (tx.path_bucket, tx.path_prefix, tx.path_file, tx.path_parent)]
    assert got == ["bucket", "prefix/of", "file.dcm", "of"]
    assert value(spark, "gs://bucket/prefix/of/", tx.path_prefix) == "prefix/of"
    assert value(spark, "gs://b/study/series/", tx.path_parent) == "series"
    assert value(spark, "alone", tx.path_parent) is None
    assert value(spark, "alone", tx.path_prefix) == ""


def test_series_path(spark):
    df = spark.createDataFrame([("st", 5)], "a string, b long")
    assert df.select(tx.series_path("gs://x/", F.col("a"), F.col("b"))).first()[0] == "gs://x/st/5/"


@pytest.mark.parametrize(
    "time, flags, name", [("T1", ["A", "B"], "time1/A_B/"), ("t-1", [""], "time-1//"), ("", ["A"], "st/se/"), ("T1", [], "st/se/")]
)
def test_feature_name(spark, time, flags, name):
    df = spark.createDataFrame([(time, flags, "st", "se")], "t string, f array<string>, st string, se string")
    assert df.select(tx.feature_name(F.col("t"), F.col("f"), F.col("st"), F.col("se"))).first()[0] == name


def test_sibling_feature_and_report_text(spark):
    assert value(spark, "time1/A/image", lambda c: tx.sibling_feature(c, "shape")) == "time1/A/shape"
    assert value(spark, "time1/image_2/image", lambda c: tx.sibling_feature(c, "dx")) == "time1/image_2/dx"
    assert value(spark, "a,b,c", tx.report_text) == "a b c"


def test_values(spark):
    assert value(spark, "007", vl.subject_key) == "7"
    assert value(spark, " UNKNOWN ", vl.subject_key) == "UNKNOWN"
    assert value(spark, None, vl.or_missing, "int") == -1
    assert [value(spark, v, vl.known, "int") for v in (-1, None, 0)] == [False, False, True]
    assert value(spark, ["1", "x", "2.5"], lambda c: vl.typed_list(c, "double"), "array<string>") == [1.0, None, 2.5]


OUTCOME = "{},d,1,100,50,0,1,2"
CLINICAL = "{},,44.5,2,1,0,1,2,3,status,0,1,10,,30,40"


def patients(spark, outcomes, clinical):
    frame = lambda lines, names: spark.createDataFrame([line.split(",") for line in lines], names)
    schema = lambda names: ", ".join(f"`{n}` string" for n in names)
    return build_patients(frame(outcomes, schema(OUTCOME_COLUMNS)), frame(clinical, schema(CLINICAL_COLUMNS)))


def test_patient_is_nested_and_missing_is_null(spark):
    good, bad = patients(spark, [OUTCOME.format("007")], [CLINICAL.format("7")])
    row = good.first().asDict(recursive=True)
    assert row["patient_id"] == 7 and row["extract_date"] == "d"
    assert row["demographic"] == {"age": 44.5, "race": 2}
    assert row["LD"] == [10, None, 30, 40]
    assert row["outcome"] == {"Sstat": 1, "survival_duration": 100, "rfs_duration": 50, "rfs_ind": 0, "pCR": 1, "RCB": 2}
    assert row["clinical"]["three_level_HER"] == 3 and row["clinical"]["Bilateral"] == 0
    flat = pt.patient_features(good).first()
    assert flat.LD == [10, -1, 30, 40] and flat.age == 44.5
    assert bad.isEmpty()


@pytest.mark.parametrize(
    "outcomes, clinical, reason",
    [
        ([OUTCOME.format(1)], [], "missing_clinical"),
        ([], [CLINICAL.format(2)], "missing_outcome"),
        ([OUTCOME.format("UNKNOWN")], [CLINICAL.format("UNKNOWN")], "bad_subject_id"),
        (["3,,1,2,,1,,"], [CLINICAL.format(3)], "missing_required"),
        (["3,,1,2,3.0,1,,"], [CLINICAL.format(3)], "malformed_field"),
        (["3,,1,2,3,1,yes,"], [CLINICAL.format(3)], "malformed_field"),
    ],
)
def test_quarantine_says_why(spark, outcomes, clinical, reason):
    good, bad = patients(spark, outcomes, clinical)
    assert good.isEmpty()
    assert [r.reason for r in bad.collect()] == [reason]


def test_optional_results_may_be_empty(spark):
    good, _ = patients(spark, ["7,,1,2,3,1,,"], [CLINICAL.format(7)])
    assert good.first().outcome.pCR is None
    assert pt.patient_features(good).first().pCR == -1


def test_one_row_per_subject(spark):
    good, _ = patients(spark, [OUTCOME.format(7), "07,,9,9,9,9,9,9"], [CLINICAL.format(7)])
    assert good.count() == 1

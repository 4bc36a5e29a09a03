import json
import os

import pytest
from pyspark.sql import functions as F

from cohortweave.config import EngineConfig
from cohortweave.operators import catalog as ct
from cohortweave.operators import hierarchy as hi
from cohortweave.operators import reports as rp
from cohortweave.plans import jobs
from cohortweave.schemas import CLINICAL_COLUMNS, OUTCOME_COLUMNS, TAG_DESCRIPTION, TAG_SERIES, TAG_STUDY, TAG_SUBJECT, TAG_TIME
from cohortweave.sources.files import AccessError

SERIES = [("1", "A", "s1", 3), ("1", "A", "s2", 1), ("2", "B", "s3", 2), ("3", "B", "s4", 2), ("UNKNOWN", "C", "s5", 1)]


@pytest.fixture
def series(spark):
    return spark.createDataFrame(SERIES, "patient_id string, study_id string, series_id string, n_slices long")


def test_study_of_two_patients_goes_to_the_least_and_is_flagged(series, rows):
    assert rows(hi.study_rollup(series), "study_id", "patient_id", "conflict", "n_series", "n_slices") == [
        ("A", "1", False, 2, 4), ("B", "2", True, 2, 4), ("C", "UNKNOWN", False, 1, 1),
    ]
    assert rows(hi.patient_rollup(hi.study_rollup(series)), "patient_id", "n_studies", "n_series", "n_conflicts") == [
        ("1", 1, 2, 0), ("2", 1, 2, 1), ("UNKNOWN", 1, 1, 0),
    ]


def test_manifests(series):
    got = {r.patient_id: [tuple(m) for m in r.manifest] for r in hi.patient_hierarchy(series).collect()}
    assert got == {"1": [("A", "s1", 3), ("A", "s2", 1)], "2": [("B", "s3", 2), ("B", "s4", 2)], "UNKNOWN": [("C", "s5", 1)]}


def test_join_and_what_it_leaves(spark, series, rows):
    patients = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "patient_id long, name string")
    padded = series.withColumn("patient_id", F.regexp_replace("patient_id", "^1$", "001"))
    assert rows(hi.cohort_join(padded, patients), "series_id", "name") == [("s1", "x"), ("s2", "x"), ("s3", "y")]
    assert rows(hi.cohort_unmatched(padded, patients)) == [
        ("patient", "9", None), ("study", "3", "B"), ("study", "UNKNOWN", "C"),
    ]


def test_skewed_join_is_split_at_run_time(spark, rows):
    """With small thresholds the partition of a hot patient is split by the planner."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(0, 300_000, numPartitions=8).selectExpr("IF(id % 3 = 0, 7, id % 999) AS patient_id", "uuid() AS series_id")
        patients = spark.range(0, 1000).withColumnRenamed("id", "patient_id").withColumn("age", F.lit(1))
        joined = hi.cohort_join(many, patients)
        assert len(joined.collect()) == 300_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


METADATA = [("s1", "T2 left breast", "1"), ("s2", "other", "1"), ("s3", "Breast Tissue Segmentation", "2"), ("s4", None, "2")]


def test_catalog(spark, rows):
    metadata = spark.createDataFrame(METADATA, "series_id string, description string, patient_id string")
    studies = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "B"), ("s4", "B"), ("s9", "Z")], "series_id string, study_id string")
    paths = ct.series_paths(metadata, studies, "gs://r/")
    assert rows(paths, "path")[0] == ("gs://r/A/s1/",) and paths.count() == 4
    unknown = paths.unionByName(paths.limit(1).withColumn("path", F.lit("gs://r/A/s99/")))
    assert rows(ct.keep_described(unknown, metadata), "path") == [("gs://r/A/s1/",)]
    batches = ct.paths_by_patient(paths, metadata.select("series_id", "description"))
    assert {r.patient_id: list(r.paths) for r in batches.collect()} == {"1": ["gs://r/A/s1/"], "2": ["gs://r/B/s3/"]}
    assert {r.patient_id: list(r.series_ids) for r in ct.series_by_patient(metadata).collect()} == {"1": ["s1", "s2"], "2": ["s3", "s4"]}


def test_first_description_of_a_series_counts(spark, rows):
    metadata = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "b")], "series_id string, description string")
    paths = spark.createDataFrame([("r/x/s/",), ("r/x/t/",)], "path string")
    assert rows(ct.keep_described(paths, metadata, ["b"])) == [("r/x/t/",)]


def test_subset_replaces_discovery(spark, series, rows):
    ids = lambda subset: rows(ct.series_subset(series, subset), "series_id")
    assert ids(None) == [("s1",), ("s2",), ("s3",), ("s4",), ("s5",)]
    assert ids(["s2"]) == [("s2",)]
    assert ids([]) == []
    assert ids(spark.createDataFrame([("s3",)], "series_id string")) == [("s3",)]


def test_empty_series_are_named(spark, series, rows):
    slices = spark.createDataFrame([(s,) for s in ("s1", "s2", "s3", "s4")], "series_id string")
    assert rows(ct.empty_series(series, slices), "series_id", "status") == [("s5", "empty")]


def test_reports(spark, rows):
    files = spark.createDataFrame(
        [("a,b", "p1", "s1", "T1"), ("a,b", "p1", "s2", "T1"), ("a,b", "p2", "s3", "T1"), ("c", "p1", "s4", "T1"), ("c", "p3", "s5", "T2")],
        "description string, patient_id string, series_id string, time_point string",
    )
    counts = rp.patients_by_description(files, time_point="T1")
    assert rows(counts) == [("a,b", 2), ("c", 1)]
    assert rp.total(counts).first().total == 3
    assert rows(rp.description_ranking(counts), "rank", "line") == [(1, "a b, 2"), (2, "c, 1")]
    assert rows(rp.description_ranking(counts, descending=False), "rank", "num") == [(1, 1), (2, 2)]
    assert rp.total(counts.limit(0)).first().total == 0
    assert rows(rp.metadata_distribution(files, ["time_point"])) == [("time_point", "T1", 4), ("time_point", "T2", 1)]
    flat = spark.createDataFrame([([2.0, 2.0],)], "pixels array<float>")
    assert rows(rp.pixel_histogram(flat)) == [(0, 2)]
    ramp = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "pixels array<float>")
    assert rows(rp.pixel_histogram(ramp, bins=3)) == [(0, 1), (1, 1), (2, 2)]


# --- the whole job ------------------------------------------------------------------


def json_decoder(path, content):
    """Test files are JSON texts that stand for decoded images."""
    tags = json.loads(content)
    if tags.get("broken"):
        raise AccessError("broken")
    return {**tags, "pixels": [float(p) for p in tags["pixels"]]}


def put(folder, path, text):
    path = os.path.join(folder, path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def tree(folder):
    def image(study, series, i, patient, description="T2 left breast", **more):
        meta = {TAG_STUDY: study, TAG_SERIES: series, TAG_SUBJECT: patient, TAG_TIME: "T1", TAG_DESCRIPTION: description}
        tags = {"meta": meta, "slice_location": float(i), "rows": 2, "cols": 2, "pixels": [i, 1, 2, 3], **more}
        put(folder, f"images/{study}/{series}/{i}.dcm", json.dumps(tags))

    for i in range(3):
        image("A", "s1", i, "001")
        image("A", "s2", i, "001", "T1 left breast")
        image("B", "s3", i, "2")
        image("C", "s4", i, "2", "not wanted")
        image("D", "s5", i, "77")
    image("D", "s6", 0, "1", broken=True)
    descriptions = {"s1": "T2 left breast", "s2": "T1 left breast", "s3": "T2 left breast", "s4": "not wanted", "s5": "T2 left breast", "s6": "T2 left breast"}
    put(folder, "meta.csv", "Series UID,Series Description\n" + "".join(f"{k},{v}\n" for k, v in descriptions.items()))
    put(folder, "o.csv", ",".join(OUTCOME_COLUMNS) + "\n1,d,1,100,50,0,1,2\n2,d,1,100,50,0,0,3\n3,d,1,1,1,1,1,1\n4,d,,,,,,\n")
    clinical = "{},,44,2,1,0,1,2,3,st,0,1,10,20,30,40\n"
    put(folder, "c.csv", ",".join(CLINICAL_COLUMNS) + "\n" + "".join(clinical.format(i) for i in (1, 2, 3, 4)))
    return EngineConfig(
        outcomes_path=f"{folder}/o.csv", clinical_path=f"{folder}/c.csv", metadata_path=f"{folder}/meta.csv",
        studies_root=f"{folder}/images", output_path=f"{folder}/out", file_pattern="*.dcm", batch_size=2, num_shards=2, decode_tasks=4,
    )


def test_cohort_from_files_to_samples(spark, tree, rows):
    counts = {}
    out = jobs.build_cohort(spark, tree, json_decoder, counts=counts)
    read = lambda name: spark.read.parquet(out[name])
    assert rows(read("patients"), "patient_id") == [(1,), (2,), (3,)]
    assert rows(read("patient_quarantine")) == [("4", "missing_required")]
    assert rows(read("slices").groupBy("series_id").count()) == [("s1", 3), ("s2", 3), ("s3", 3), ("s5", 3), ("s6", 1)]
    assert rows(read("series_quarantine"), "series_id", "reason") == [("s6", "failed_slice")]
    by_status = {r.status: r["count"] for r in read("slices").groupBy("status").count().collect()}
    assert counts["slices"] == dict.fromkeys(jobs.SLICE_STATUSES, 0) | by_status | {"": 13}
    assert counts["series_quarantine"] == {"": 1, "failed_slice": 1, "mixed_size": 0, "repeated_path": 0}
    assert ("patient", "3", None) in rows(read("unmatched")) and ("study", "77", "D") in rows(read("unmatched"))
    assert rows(read("volumes"), "series_id", "block_no", "shape") == [(s, 0, [3, 2, 2]) for s in ("s1", "s2", "s3", "s5")]
    assert {r.patient_id: [m.series_id for m in r.manifest] for r in read("manifest").collect()} == {
        1: ["s1", "s2"], 2: ["s3"], 77: ["s5"],
    }
    records = read("records")
    assert rows(records.select("patient_id", "batch_id").distinct()) == [(1, 0), (2, 1)]
    images = records.where(F.col("feature_name").contains("/image"))
    assert rows(images, "patient_id", "feature_name", "series_id", "age") == [
        (1, "time1/T1_LEFT_BREAST/image", "s2", 44.0), (1, "time1/T2_LEFT_BREAST/image", "s1", 44.0),
        (2, "time1/T2_LEFT_BREAST/image", "s3", 44.0),
    ]
    wide = jobs.wide_records(records, ["time1/T1_LEFT_BREAST/dx", "time1/T2_LEFT_BREAST/dx"])
    assert wide.count() == 2 and len(wide.columns) == 3

    simple = jobs.simplified_records(records.select("patient_id", "feature_name", "series_id"), read("patients"), ["time1/T1_LEFT_BREAST/image"])
    assert rows(simple, "patient_id", "series_id", "response_group") == [(1, "s2", 1)]

    jobs.write_simplified(simple, f"{tree.output_path}/simple")
    assert rows(spark.read.parquet(f"{tree.output_path}/simple"), "patient_id", "shard_id") == [(1, 0)]

    features = images.select("patient_id", "feature_name", "series_id")
    jobs.write_samples(jobs.training_samples(read("slices"), features, read("patients"), height=4, width=4), f"{tree.output_path}/samples")
    samples = spark.read.parquet(f"{tree.output_path}/samples").collect()
    got = {r.patient_id: (r.height, r.width, len(r.pixels), r.response_group, list(r.label)) for r in samples}
    assert got == {1: (4, 4, 16, 1, [1.0, 0.0, 0.0]), 2: (4, 4, 16, 3, [0.0, 0.0, 1.0])}
    assert {r.patient_id: r.pixels[0] for r in samples} == {1: 1.0, 2: 1.0}


def test_a_smaller_run_leaves_no_batch_of_an_earlier_one(spark, tree, rows):
    """Started from a table of paths, so nothing is listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree.studies_root).select("path")
    paths = spark.createDataFrame([tuple(r) for r in files.collect()], "path string")
    out = jobs.build_cohort(spark, tree, json_decoder, paths=paths)
    assert rows(spark.read.parquet(out["records"]).select("batch_id").distinct()) == [(0,), (1,)]
    few = paths.where("path LIKE '%/s3/%'")
    out = jobs.build_cohort(spark, tree, json_decoder, paths=few)
    assert rows(spark.read.parquet(out["records"]).select("batch_id").distinct()) == [(0,)]


def test_ids_compare_as_numbers_and_a_study_has_one_owner(spark, rows):
    from cohortweave.operators import hierarchy as hi

    data = [("a", "A", "007"), ("b", "A", "7"), ("c", "B", "10"), ("d", "B", "9"), ("e", "C", "nobody")]
    owned = hi.owned_series(hi.with_subject(spark.createDataFrame(data, "series_id string, study_id string, patient_id string").selectExpr("*", "1L AS n_slices")))
    assert rows(owned, "series_id", "patient_id", "owner_conflict") == [
        ("a", 7, False), ("b", 7, False), ("c", 9, True), ("d", 9, True), ("e", None, None),
    ]
    known = spark.createDataFrame([(7,), (9,)], "patient_id long")
    assert rows(hi.cohort_unmatched(owned, known)) == [("study", "nobody", "C")]


def test_a_subset_stands_in_place_of_the_allow_list(spark, tree, rows):
    out = jobs.build_cohort(spark, tree, json_decoder, subset=["s4"])
    assert rows(spark.read.parquet(out["series"]), "series_id") == [("s4",)]

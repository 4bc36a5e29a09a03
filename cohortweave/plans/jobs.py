"""Whole jobs made of operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.config import EngineConfig
from cohortweave.functions.values import or_missing
from cohortweave.operators import batching, catalog, hierarchy
from cohortweave.operators import patients as pt
from cohortweave.operators import samples as sm
from cohortweave.operators import series as sr
from cohortweave.operators.shared import written
from cohortweave.schemas import (
    CLINICAL_COLUMNS,
    IMAGE_DESCRIPTIONS,
    OUTCOME_COLUMNS,
    PREFERRED_FEATURES,
    REQUIRED_FEATURES,
    SAMPLE_HEIGHT,
    SAMPLE_WIDTH,
    SLICES,
)
from cohortweave.sources import files as files_source
from cohortweave.sources.slice_tree import slice_tree
from cohortweave.sources.tables import write_batches, write_counted, write_fixed_shards
from cohortweave.sources.text import read_header_csv, read_positional_csv

COHORT_TABLES = [
    "patients",
    "patient_quarantine",
    "slices",
    "series",
    "series_quarantine",
    "volumes",
    "unmatched",
    "manifest",
    "records",
]

SLICE_STATUSES = ["ok", "access_error", "metadata_error", "unknown_error", "pixel_count"]
SERIES_FAULTS = ["failed_slice", "mixed_size", "repeated_path"]


def build_patients(outcomes: DataFrame, clinical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid patients and the quarantine, from the rows of the two files."""
    formatted = pt.format_patients(pt.join_patient_rows(outcomes, clinical))
    return pt.valid_patients(formatted), pt.quarantined_patients(formatted)


def build_cohort(
    spark: SparkSession,
    config: EngineConfig,
    decoder: Callable[[str, bytes], dict],
    subset: DataFrame | Sequence | None = None,
    descriptions: Sequence[str] = tuple(IMAGE_DESCRIPTIONS),
    paths: DataFrame | None = None,
    counts: dict[str, dict[str, int]] | None = None,
) -> dict[str, str]:
    """Read the patient files and the image tree, and write every table of the cohort.

    Series are those with an allowed description, or exactly those of ``subset``.
    The tree is listed by tasks; ids given as a list decide before a folder of theirs is listed.
    ``paths``, a table with a ``path`` column, takes the place of a listing.
    Files are filtered by their paths first, then fetched and decoded in the tasks;
    ``decoder(path, content)`` gives the columns of ``schemas.SLICES``. Rows that fail
    go to quarantine tables. An image feature of the records names the series whose
    voxels are in the volume table. Returns the path of every table. ``counts`` is given the rows of
    slices and of faulty series by status or reason, counted while they are written.
    """
    out = {name: f"{config.output_path}/{name}" for name in COHORT_TABLES}

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(out[name])
        return spark.read.parquet(out[name])

    def save_counted(df: DataFrame, name: str, by: str, values: Sequence[str]) -> DataFrame:
        found = write_counted(df, out[name], by, values)
        if counts is not None:
            counts[name] = found
        return spark.read.parquet(out[name])

    outcomes = read_positional_csv(spark, config.outcomes_path, OUTCOME_COLUMNS)
    clinical = read_positional_csv(spark, config.clinical_path, CLINICAL_COLUMNS)
    good, rejected = build_patients(outcomes, clinical)
    patients = save(good, "patients")
    save(rejected, "patient_quarantine")

    if paths is None:
        named = None if subset is None or isinstance(subset, DataFrame) else [str(s) for s in subset]
        files = slice_tree(spark, config.studies_root, config.file_pattern, content=False, series=named)
    else:
        files = files_source.files_of_paths(paths)
    listed = files_source.series_directories(files).withColumnRenamed("series_path", "path")
    if subset is not None:
        wanted = catalog.series_subset(listed, subset)
    else:
        names = {"Series UID": "series_id", "Series Description": "description"}
        metadata = read_header_csv(spark, config.metadata_path, names)
        wanted = catalog.keep_described(listed, metadata, descriptions)
    if config.series_limit is not None:
        wanted = wanted.orderBy("study_id", "series_id").limit(config.series_limit)

    chosen = files.join(wanted.select("study_id", "series_id"), ["study_id", "series_id"], "left_semi")
    # Paths are tiny and decoding is not: spread them without regard to their bytes.
    tasks = config.decode_tasks or spark.sparkContext.defaultParallelism * 4
    decoded = files_source.fetch_and_decode(chosen.select("path").repartition(tasks, "path"), decoder, SLICES)
    parts = F.split("path", "/")
    tagged = sr.tag_columns(decoded).withColumns(
        {
            "series_id": F.coalesce("series_id", F.element_at(parts, -2)),
            "study_id": F.coalesce("study_id", F.element_at(parts, -3)),
        }
    )
    slices = save_counted(sr.check_pixels(tagged), "slices", "status", SLICE_STATUSES)
    series = save(sr.series_metadata(slices), "series")
    save(sr.volume_blocks(slices, config.max_voxels), "volumes")
    # Ids are numbers and studies have one owner before anything is made by patient.
    faulty = save_counted(sr.series_quarantine(slices), "series_quarantine", "reason", SERIES_FAULTS).select("series_id")
    valid = series.where("status = 'ok'").join(faulty, "series_id", "left_anti")
    owned = written(hierarchy.owned_series(hierarchy.with_subject(valid)), "owned-series")
    save(hierarchy.cohort_unmatched(owned, patients), "unmatched")
    save(hierarchy.patient_hierarchy(owned, config.block_rows), "manifest")

    batched = batching.batched_cohort(owned, "patient_id", config.batch_size)
    features = sr.feature_dedup(sr.feature_long(sr.series_features(owned)))
    # One row per patient on this side, so the features are joined once only.
    batches = batched.select("patient_id", "batch_id").distinct()
    own = hierarchy.cohort_join(batches, pt.patient_features(patients))
    records = hierarchy.cohort_join(features, own)
    write_batches(records, out["records"], num_shards=config.num_shards, spread="series_id", whole=True)
    return out


def cohort_manifest(slices: DataFrame, series: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per patient with studies: counts, bounds, age and response group.

    Slices are reduced to their series before anything is joined, and no pixels are
    read.
    """
    per_series = slices.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.min("slice_location").alias("z_lo"),
        F.max("slice_location").alias("z_hi"),
    )
    per_study = (
        series.select("patient_id", "study_id", "series_id")
        .join(per_series, "series_id")
        .groupBy("patient_id", "study_id")
        .agg(
            F.count(F.lit(1)).alias("n_series"),
            F.sum("n_slices").alias("n_slices"),
            F.min("z_lo").alias("z_lo"),
            F.max("z_hi").alias("z_hi"),
        )
    )
    per_patient = per_study.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_studies"),
        F.sum("n_series").alias("n_series"),
        F.sum("n_slices").alias("n_slices"),
        F.min("z_lo").alias("z_lo"),
        F.max("z_hi").alias("z_hi"),
    )
    known = patients.select(
        "patient_id",
        or_missing(F.col("demographic.age")).alias("age"),
        sm.response_group(F.col("outcome.pCR"), F.col("outcome.RCB")).alias("response_group"),
    )
    return hierarchy.cohort_join(per_patient, known)


def wide_records(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """A column per named feature, for few names that are known beforehand."""
    return features.groupBy("patient_id").pivot("feature_name", list(names)).agg(F.first("value"))


def simplified_records(
    features: DataFrame, patients: DataFrame, required: Sequence[str] = tuple(REQUIRED_FEATURES)
) -> DataFrame:
    """Labelled patients with every required feature: their group and those features."""
    labels = sm.labelled_only(
        patients.select("patient_id", F.col("outcome.pCR").alias("pCR"), F.col("outcome.RCB").alias("RCB"))
    ).withColumn("response_group", sm.response_group(F.col("pCR"), F.col("RCB")))
    return hierarchy.cohort_join(sm.required_series(features, required), labels)


def training_samples(
    slices: DataFrame,
    features: DataFrame,
    patients: DataFrame,
    preferred: Sequence[str] = tuple(PREFERRED_FEATURES),
    height: int = SAMPLE_HEIGHT,
    width: int = SAMPLE_WIDTH,
) -> DataFrame:
    """One sample per labelled patient: the middle slice of the preferred series, at one size.

    The series is chosen first, so only its slices are ordered, by their keys alone;
    then one slice per patient has its pixels fetched.
    """
    # One small row per patient, used three times below.
    chosen = written(sm.preferred_series(features, preferred).select("patient_id", "series_id"), "chosen-series")
    own = slices.join(chosen.select("series_id"), "series_id", "left_semi")
    middle = sr.middle_slices(own).select("series_id", "path").join(chosen, "series_id")
    images = sr.fetch_pixels(middle, slices).select(
        F.col("patient_id").try_cast("bigint").alias("patient_id"),
        "pixels",
        F.col("rows").alias("height"),
        F.col("cols").alias("width"),
    )
    labels = patients.select("patient_id", F.col("outcome.pCR").alias("pCR"), F.col("outcome.RCB").alias("RCB"))
    labelled = sm.labelled_only(images.join(labels, "patient_id"))
    # Slices lie (row, column); samples lie (column, row).
    return sm.sample_input(sm.resized(labelled, height, width, swap=True), height, width)


def write_simplified(records: DataFrame, path: str, shard_size: int = EngineConfig.shard_size) -> None:
    """Simplified records in numbered shards of ``shard_size`` patients."""
    keys = records.select("patient_id").distinct()
    shards = batching.fixed_size_shards(keys, "patient_id", shard_size).select("patient_id", "shard_id")
    write_fixed_shards(records.join(shards, "patient_id"), path)


def write_samples(samples: DataFrame, path: str, seed: int = 0) -> None:
    """Samples in a folder per split; a patient is in one split."""
    split = batching.split_by_key(samples, "patient_id", seed)
    split.write.mode("overwrite").partitionBy("split").parquet(path)

"""Which series there are and which are wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.text import path_parent, series_path
from cohortweave.operators.ranking import least_values, list_blocks
from cohortweave.schemas import IMAGE_DESCRIPTIONS, SEGMENTATION_DESCRIPTIONS


def series_paths(metadata: DataFrame, studies: DataFrame, root: str = "") -> DataFrame:
    """Metadata joined with the study of every series, and the path of the series."""
    return metadata.join(studies.select("series_id", "study_id"), "series_id").select(
        "patient_id",
        "study_id",
        "series_id",
        "description",
        series_path(root, F.col("study_id"), F.col("series_id")).alias("path"),
    )


def first_descriptions(metadata: DataFrame) -> DataFrame:
    """One description per series; of several, the least. Series without one drop."""
    return least_values(metadata, ["series_id"], "description").select("series_id", "description")


def keep_described(
    paths: DataFrame, metadata: DataFrame, descriptions: Sequence[str] = tuple(IMAGE_DESCRIPTIONS)
) -> DataFrame:
    """Paths whose series has an allowed description; an unknown series drops.

    The series id is read from the path. The list is short, so it is a literal
    filter; the join is planned from the sizes of both sides.
    """
    wanted = first_descriptions(metadata).where(F.col("description").isin(list(descriptions)))
    keyed = paths.withColumn("_series", path_parent(F.col("path")))
    ids = wanted.select(F.col("series_id").cast("string").alias("_series"))
    return keyed.join(ids, "_series", "left_semi").drop("_series")


def paths_by_patient(
    paths: DataFrame,
    descriptions: DataFrame,
    wanted: Sequence[str] = tuple(SEGMENTATION_DESCRIPTIONS + IMAGE_DESCRIPTIONS),
    block_rows: int = 1_000,
) -> DataFrame:
    """Path lists of every patient over the series with a wanted description."""
    ids = descriptions.where(F.col("description").isin(list(wanted))).select("series_id")
    kept = paths.join(ids, "series_id", "left_semi")
    return list_blocks(kept, ["patient_id"], ["path"], ["path"], "paths", block_rows)


def series_by_patient(metadata: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """Series ids of every patient."""
    pairs = metadata.select("patient_id", "series_id").distinct()
    return list_blocks(pairs, ["patient_id"], ["series_id"], ["series_id"], "series_ids", block_rows)


def series_subset(discovered: DataFrame, subset: DataFrame | Sequence | None) -> DataFrame:
    """The series named by ``subset`` instead of all; an empty subset means none.

    A given subset also stands in place of the allow-list. A list is meant to be
    short; a long one belongs in a table.
    """
    if subset is None:
        return discovered
    if not isinstance(subset, DataFrame):
        id_type = discovered.schema["series_id"].dataType.simpleString()
        subset = discovered.sparkSession.createDataFrame([(s,) for s in subset], f"series_id {id_type}")
    return discovered.join(subset.select("series_id"), "series_id", "left_semi")


def empty_series(discovered: DataFrame, slices: DataFrame) -> DataFrame:
    """Series that are listed but have no file."""
    return discovered.join(slices.select("series_id"), "series_id", "left_anti").withColumn("status", F.lit("empty"))

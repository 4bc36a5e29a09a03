"""Counts and distributions over a cohort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.pixels import argmax
from cohortweave.functions.text import report_text
from cohortweave.operators.ranking import global_row_number


def patients_by_description(
    files: DataFrame, only: DataFrame | None = None, time_point: str | None = None
) -> DataFrame:
    """Distinct patients of every description, over some series and one time point.

    Files are reduced before they are joined, and the distinct step runs on
    (description, patient), so a frequent description is counted by many tasks.
    """
    rows = files if time_point is None else files.where(F.col("time_point") == time_point)
    if only is not None:
        rows = rows.select("series_id", "description", "patient_id").distinct()
        rows = rows.join(only.select("series_id"), "series_id", "left_semi")
    return rows.groupBy("description").agg(F.count_distinct("patient_id").alias("num"))


def patient_sketches(files: DataFrame, lg_k: int = 12) -> DataFrame:
    """A sketch of the patients of every description and time point, of at most about ``2 ** lg_k`` bytes each.

    Kept as a table, sketches take in new files without the old ones: :func:`merged_sketches`.
    Files without a patient count in ``n_files`` alone.
    """
    return files.groupBy("description", "time_point").agg(
        F.hll_sketch_agg(F.col("patient_id").cast("string"), F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n_files")
    )


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """One table of sketches for the files of all parts, whether or not they share patients or files."""
    return reduce(DataFrame.unionByName, parts).groupBy("description", "time_point").agg(
        F.hll_union_agg("sketch", True).alias("sketch"), F.sum("n_files").alias("n_files")
    )


def sketched_patients(sketches: DataFrame, time_point: str | None = None) -> DataFrame:
    """About how many patients every description has, over all time points or at one.

    The relative error is ``1.04 / sqrt(2 ** lg_k)`` as a standard deviation at most: 1.6 % for 12.
    """
    rows = sketches if time_point is None else sketches.where(F.col("time_point") == time_point)
    return rows.groupBy("description").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("num"))


def total(counts: DataFrame) -> DataFrame:
    """Sum of the counts; a patient counts once per description."""
    return counts.agg(F.coalesce(F.sum("num"), F.lit(0)).cast("bigint").alias("total"))


def description_ranking(counts: DataFrame, descending: bool = True) -> DataFrame:
    """Counts in order with their rank and a printable line; ties go by description."""
    sign = -1 if descending else 1
    keyed = counts.withColumn("_key", F.col("num") * sign)
    ranked = global_row_number(keyed, ["_key", "description"], "rank").drop("_key")
    return ranked.withColumn("line", F.concat_ws(", ", report_text(F.col("description")), F.col("num").cast("string")))


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """Samples per class of a one-hot label."""
    return samples.groupBy(argmax(F.col(label)).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


def pixel_histogram(images: DataFrame, pixels: str = "pixels", bins: int = 30) -> DataFrame:
    """Pixels per equal-width bin between the least and the greatest value of all.

    Tasks count their images' pixels by numpy, so that no row per pixel is made; both
    ends come from a subquery of the same plan.
    """
    ends = images.agg(
        F.min(F.array_min(pixels)).cast("double").alias("low"), F.max(F.array_max(pixels)).cast("double").alias("high")
    )
    rows = images.select(
        F.col(pixels).alias("v"), ends.select("low").scalar().alias("low"), ends.select("high").scalar().alias("high")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, dtype=np.int64)
        for batch in batches:
            values = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(values):
                low, high = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
                at = np.floor((values - low) / (high - low) * bins) if high > low else np.zeros(len(values))
                total += np.bincount(np.clip(at, 0, bins - 1).astype(np.int64), minlength=bins)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bin", "n"])

    return rows.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def pixel_sketch(images: DataFrame, *keys: str, pixels: str = "pixels", k: int = 800) -> DataFrame:
    """A mergeable quantile sketch of the pixels, per combination of ``keys`` or of all, made in one scan.

    ``k`` sets size and error: ranks are off by about 0.4 % for 800. Least and greatest are exact.
    """
    values = images.select(*keys, F.explode(pixels).alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return values.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col("_v").cast("double"), F.lit(k)).alias("sketch"))


def merged_pixel_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of parts as one, or as one per combination of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


_GRID = 2_000  # quantiles a sketch is asked for


def sketched_histogram(sketches: DataFrame, *keys: str, bins: int = 30) -> DataFrame:
    """About how many pixels lie in each of ``bins`` equal ranges, as :func:`pixel_histogram` counts them exactly.

    Each of 2,000 evenly spaced quantiles stands for as many pixels.
    """
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", q)
    grid = quantile(F.array(*[F.lit((i + 0.5) / _GRID) for i in range(_GRID)]))
    filled = sketches.where(F.kll_sketch_get_n_double("sketch") > 0)
    asked = filled.select(
        *keys, quantile(F.lit(0.0)).alias("low"), quantile(F.lit(1.0)).alias("high"), F.kll_sketch_get_n_double("sketch").alias("total"), F.explode(grid).alias("v")
    )
    share = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    place = F.when(F.col("high") > F.col("low"), F.least(share, F.lit(bins - 1))).otherwise(0).cast("long").alias("bin")
    met = asked.groupBy(*keys, "total", place).agg(F.count(F.lit(1)).alias("_n"))
    return met.select(*keys, "bin", F.round(F.col("_n") * F.col("total") / _GRID).cast("long").alias("n"))


def metadata_distribution(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of every given column, all counted in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return rows.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))

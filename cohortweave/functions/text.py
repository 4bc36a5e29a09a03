"""Text expressions: paths, descriptions and feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.schemas import DESCRIPTION_MARKS, DESCRIPTION_PREFIX


def series_path(root: str, study: Column, series: Column) -> Column:
    """``root/study/series/``; a root that is not empty must end in a slash."""
    return F.concat(F.lit(root), study.cast("string"), F.lit("/"), series.cast("string"), F.lit("/"))


def path_bucket(path: Column) -> Column:
    """Authority part of ``scheme://bucket/prefix/file``."""
    return F.get(F.split(path, "/"), F.lit(2))


def path_prefix(path: Column) -> Column:
    """What lies between the bucket and the last component."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 4, F.lit(0))), "/")


def path_file(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def path_parent(path: Column) -> Column:
    """Next-to-last component: the series id of a series path or of a file in it."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def description_flags(description: Column) -> Column:
    """One-element list with the description as an upper-case tag."""
    bare = F.replace(description, F.lit(DESCRIPTION_PREFIX), F.lit(""))
    return F.array(F.upper(F.translate(bare, DESCRIPTION_MARKS, "_" * len(DESCRIPTION_MARKS))))


def dicom_id(study: Column, series: Column) -> Column:
    return F.concat(study.cast("string"), F.lit("/"), series.cast("string"), F.lit("/"))


def feature_name(time: Column, flags: Column, study: Column, series: Column) -> Column:
    """``time<t>/<FLAGS>/`` where a time point and flags exist, else the ids."""
    named = F.concat(F.lit("time"), F.substr(time, F.lit(2)), F.lit("/"), F.array_join(flags, "_"), F.lit("/"))
    return F.when((F.length(time) > 0) & (F.size(flags) > 0), named).otherwise(dicom_id(study, series))


def sibling_feature(name: Column, key: str) -> Column:
    """Name of another feature of the series that owns an ``…/image`` feature: the last component changes."""
    return F.regexp_replace(name, F.lit("image$"), F.lit(key.replace("\\", "\\\\").replace("$", "\\$")))


def report_text(text: Column) -> Column:
    """Text safe to print between commas."""
    return F.replace(text, F.lit(","), F.lit(" "))

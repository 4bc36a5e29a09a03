"""Slices to series: order, volumes and merged metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortweave.functions.text import description_flags, dicom_id, feature_name
from cohortweave.functions.values import present
from cohortweave.operators.ranking import changed_rows, joined_to, least_values, rank_within, value_codes
from cohortweave.operators.shared import written
from cohortweave.schemas import (
    DEFAULT_ORIENTATION,
    DEFAULT_POSITION,
    DEFAULT_SUBJECT,
    DEFAULT_TIME,
    MISSING,
    TAG_DESCRIPTION,
    TAG_LATERALITY,
    TAG_MODALITY,
    TAG_PIXELS,
    TAG_SERIES,
    TAG_STUDY,
    TAG_SUBJECT,
    TAG_TIME,
)


def _doubles(values: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)}D' for v in values)})")


def _z() -> Column:
    return F.get("position", F.lit(2))


def check_pixels(slices: DataFrame) -> DataFrame:
    """Mark, at ingestion, slices whose pixel count is not rows times columns."""
    wrong = (F.col("status") == "ok") & ~F.coalesce(F.size("pixels") == F.col("rows") * F.col("cols"), F.lit(False))
    return slices.withColumn("status", F.when(wrong, "pixel_count").otherwise(F.col("status")))


_NUMBERS = [("rows_min", "min", "rows"), ("rows_max", "max", "rows"), ("cols_min", "min", "cols"), ("cols_max", "max", "cols")]


def _paths(slices: DataFrame, z: Column | None = None) -> DataFrame:
    """One narrow row per path, so that a path which comes twice is seen; pixels are not read."""
    z = _z() if z is None else z
    return slices.groupBy("series_id", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("slice_location").alias("n_locations"),
        F.count(z).alias("n_positions"),
        F.min("slice_location").alias("location"),
        F.min(z).alias("z"),
        F.expr("count_if(status <> 'ok')").alias("n_failed"),
        *[getattr(F, kind)(c).alias(name) for name, kind, c in _NUMBERS],
    )


def _written_paths(slices: DataFrame) -> DataFrame:
    """The rows of :func:`_paths`, written in ranges of series.

    One shuffle of narrow rows serves the aggregate and lays a series together. So facts are counted
    where its slices are, before they shuffle, and paths that begin alike stand together and are squeezed well.
    """
    narrow = slices.select("series_id", "path", "slice_location", _z().alias("_z"), "status", "rows", "cols")
    ranged = _paths(narrow.repartitionByRange("series_id", "path"), F.col("_z")).select("series_id", "path", *_KEPT_OF_PATHS)
    return written(ranged.sortWithinPartitions("series_id", "path"), "paths")


def _facts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("series_id").agg(
        F.sum("n").alias("n_slices"),
        F.sum("n_locations").alias("n_locations"),
        F.sum("n_positions").alias("n_positions"),
        *[getattr(F, kind)(name).alias(name) for name, kind, _ in _NUMBERS],
        F.sum("n_failed").alias("n_failed"),
        F.max("n").alias("n_of_a_path"),
        *[getattr(F, kind)(c).alias(f"{c}_{kind}") for c in ("location", "z") for kind in ("min", "max")],
    )


def series_facts(slices: DataFrame) -> DataFrame:
    """Counts per series from which its order and validity follow; pixels are not read."""
    return _facts(_paths(slices))


def _metadata_facts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_slices"),
        F.min("rows").alias("rows_min"),
        F.max("rows").alias("rows_max"),
        F.min("cols").alias("cols_min"),
        F.max("cols").alias("cols_max"),
        F.expr("count_if(status <> 'ok') AS n_failed"),
    ]


def _fault(repeats: str = "n_of_a_path > 1") -> Column:
    return F.expr(
        f"""CASE WHEN n_failed > 0 THEN 'failed_slice'
                 WHEN rows_min <> rows_max OR cols_min <> cols_max THEN 'mixed_size'
                 WHEN {repeats} THEN 'repeated_path' END"""
    )


def series_quarantine(slices: DataFrame) -> DataFrame:
    """Series that cannot be one volume, with the reason."""
    return series_facts(slices).select("series_id", "n_slices", _fault().alias("reason")).where("reason is not null")


def _source() -> Column:
    by_location, by_position = F.col("n_locations") == F.col("n_slices"), F.col("n_positions") == F.col("n_slices")
    return F.when(by_location, "location").when(by_position, "position").otherwise("path")


def _of_source(location: str, z: str) -> Column:
    return F.when(F.col("sort_source") == "location", F.col(location)).when(F.col("sort_source") == "position", F.col(z))


def slice_order(slices: DataFrame) -> DataFrame:
    """Place of every slice in its series, from 0. Only keys are sorted and shuffled.

    Slices sort by location where all slices of the series have one, else by the z
    position where all have that, else by path; the path also settles ties. A path
    names one file: a series with a path that comes twice is quarantined, and its
    rows of one path have one place, that of the least key.

    The slices are read to one narrow row per path, after a sample of their keys; facts and order come from those.
    """
    paths = _written_paths(slices)
    facts = _facts(paths).select("series_id", "n_slices", _fault().alias("reason"), _source().alias("sort_source"))
    keyed = paths.select("series_id", "path", "location", "z").join(facts, "series_id").select(
        "series_id", "path", "n_slices", "reason", "sort_source", _of_source("location", "z").alias("sort_key")
    )
    ranked = rank_within(keyed, ["series_id"], ["sort_key", "path"], "_rank")
    return ranked.withColumn("z_index", F.col("_rank") - 1).drop("_rank")


_KEPT_OF_PATHS = ["n", "n_locations", "n_positions", "location", "z", "n_failed", *[name for name, _, _ in _NUMBERS]]

_RANGE_SLICES, _MOST_RANGES = 256, 4_096  # slices a range of keys is meant to hold; ranges of one series


def middle_slices(slices: DataFrame) -> DataFrame:
    """The slice at place n div 2 of every valid series, without ordering the others.

    The keys of a series are counted in equal ranges between the least and the greatest; the counts tell
    which range has the middle and how many slices come before it. Only slices of that range are ranked. Where
    all keys fall into one range (equal keys, or an order by path) that is the whole series, with the same result.
    A series of one range is not counted: all its slices are ranked, and they shuffle no further for it.
    """
    paths = _written_paths(slices)
    facts = _facts(paths).withColumn("sort_source", _source()).where(_fault().isNull()).select(
        "series_id",
        "n_slices",
        "sort_source",
        F.expr("n_slices div 2").alias("middle"),
        F.least(F.ceil(F.col("n_slices") / _RANGE_SLICES), F.lit(_MOST_RANGES)).alias("ranges"),
        _of_source("location_min", "z_min").alias("low"),
        _of_source("location_max", "z_max").alias("high"),
    )
    facts = written(facts, "middle-facts")
    narrow = paths.select("series_id", "path", "location", "z")
    # Only series of several ranges are counted; they are few, one per _RANGE_SLICES slices at most.
    several = written(facts.where("ranges > 1"), "several-ranges")
    upto = Window.partitionBy("series_id").orderBy("range")  # at most _MOST_RANGES rows of a series
    counts = _ranged(narrow.join(several, "series_id")).groupBy("series_id", "middle", "range").agg(F.count(F.lit(1)).alias("n"))
    met = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).where("before <= middle AND middle < before + n")
    met = written(met.select("series_id", F.col("range").alias("_range"), "before"), "middle-ranges")
    keyed = _ranged(narrow.join(facts, "series_id")).join(met, "series_id", "left")
    near = keyed.where("ranges <= 1 OR range = _range").withColumn("before", F.coalesce("before", F.lit(0)))
    ranked = rank_within(near.select("series_id", "path", "n_slices", "middle", "before", "sort_key"), ["series_id"], ["sort_key", "path"], "_rank")
    return ranked.where(F.col("before") + F.col("_rank") - 1 == F.col("middle")).select("series_id", "path", "n_slices", F.col("middle").alias("z_index"))


def _ranged(keyed: DataFrame) -> DataFrame:
    """Adds the key a slice sorts by, and its range among those of its series."""
    wide = F.col("high") - F.col("low")
    share = (F.col("sort_key") - F.col("low")) / wide * F.col("ranges")
    ranged = F.when((wide > 0) & (wide < float("inf")), F.least(F.floor(share), F.col("ranges") - 1)).otherwise(0)
    return keyed.withColumn("sort_key", _of_source("location", "z")).withColumn("range", F.coalesce(ranged, F.lit(0)))


def fetch_pixels(selected: DataFrame, slices: DataFrame) -> DataFrame:
    """Pixels of selected slices, found by path; the planner chooses the join by the sizes it sees."""
    return slices.select("path", "rows", "cols", "pixels").join(selected, "path")


def volume_blocks(slices: DataFrame, max_voxels: int = 2_097_152) -> DataFrame:
    """Volumes of the valid series, slice after slice in row-major order.

    A volume of up to ``max_voxels`` voxels is one row. A larger one has as many
    rows as it needs, each with whole slices, its first slice and its number. Slices
    are ordered by their keys alone; pixels then meet their places, and go sorted to the task
    that joins their block. There they stream by, so a task holds one block at a time.
    """
    placed = slice_order(slices).where("reason is null").select("series_id", "path", "n_slices", "z_index")
    area = F.greatest(F.col("rows") * F.col("cols"), F.lit(1))
    per_block = F.greatest(F.floor(F.lit(max_voxels) / area), F.lit(1))
    cut = (
        slices.select("series_id", "path", "rows", "cols", "pixels")
        .join(placed, ["series_id", "path"])
        .select(
            "series_id",
            F.floor(F.col("z_index") / per_block).cast("bigint").alias("block_no"),
            F.col("z_index").cast("bigint").alias("z_start"),
            F.array(F.col("n_slices").cast("int"), "rows", "cols").alias("shape"),
            F.col("pixels").alias("voxels"),
        )
    )
    key = ["series_id", "block_no"]
    return _joined_blocks(cut.repartition(*key).sortWithinPartitions(*key, "z_start"))


def _joined_blocks(slices: DataFrame) -> DataFrame:
    """Sorted slices to blocks: the voxels of rows with one series and block, one after another."""
    arrow = to_arrow_schema(slices.schema)
    return slices.mapInArrow(lambda batches: _blocks_of(batches, arrow), slices.schema)


def _blocks_of(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The blocks of sorted slices, batch by batch, without a loop over rows; only the open block is carried on."""
    kind = arrow.field("voxels").type
    head: pa.RecordBatch | None = None  # first row of the block that is open
    parts: list[pa.Array] | None = []  # its voxels so far; None once a slice has none

    def blocks(first: pa.RecordBatch, border: np.ndarray, flat: pa.Array, empty: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), flat, mask=pa.array(empty))
        return pa.RecordBatch.from_arrays([*first.columns[:4], lists.cast(kind)], schema=arrow)

    def closed() -> pa.RecordBatch:
        flat = pa.concat_arrays([pa.array([], kind.value_type), *(parts or [])])
        return blocks(head, np.array([0, len(flat)]), flat, np.array([parts is None]))

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(4)
        absent = own.is_null().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        border = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = own.flatten()  # without the absent ones
        starts = np.flatnonzero(changed_rows(batch, [0, 1], head))
        # Rows before the first start go on with the open block, those from the last one open the next.
        upto = int(starts[0]) if len(starts) else batch.num_rows
        if absent[:upto].any():
            parts = None
        elif parts is not None and upto:
            parts.append(flat.slice(0, border[upto]))
        if not len(starts):
            continue
        if head is not None:
            yield closed()
        last = int(starts[-1])
        if len(starts) > 1:
            missing = np.logical_or.reduceat(absent[:last], starts[:-1])
            yield blocks(batch.select([0, 1, 2, 3]).take(pa.array(starts[:-1])), border[starts], flat, missing)
        head = batch.slice(last, 1)
        parts = None if absent[last:].any() else [flat.slice(border[last])]
    if head is not None:
        yield closed()


def z_bounds(slices: DataFrame) -> DataFrame:
    """Least and greatest location; a series of one slice is bounded by (0, 0)."""
    return slices.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_slices"), *_bound_aggregates()
    ).select("series_id", "n_slices", _z_bound().alias("z_bound"))


def _bound_aggregates() -> list[Column]:
    return [F.min("slice_location").alias("_lo"), F.max("slice_location").alias("_hi")]


def _z_bound() -> Column:
    single = F.col("n_slices") < 2
    return F.struct(
        F.when(single, F.lit(0.0)).otherwise(F.col("_lo")).alias("lo"),
        F.when(single, F.lit(0.0)).otherwise(F.col("_hi")).alias("hi"),
    )


def metadata_keys(slices: DataFrame) -> DataFrame:
    """Every tag that some slice of the series has."""
    return slices.select("series_id", F.explode(F.map_keys("meta")).alias("tag")).distinct()


def representative_values(slices: DataFrame) -> DataFrame:
    """One value per series and tag: the least that is not empty. Zero is a value."""
    values = slices.select("series_id", F.explode("meta").alias("tag", "value"))
    return least_values(values.withColumn("value", present(F.col("value"))), ["series_id", "tag"], "value")


def metadata_map(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Tags of a JSON column without the pixel tag and without values that are absent."""
    tags = F.from_json(json, "map<string,string>")
    kept = F.map_filter(tags, lambda tag, value: (tag != TAG_PIXELS) & value.isNotNull())
    return rows.select(key, kept.alias("meta"))


def tag_columns(slices: DataFrame) -> DataFrame:
    """Tags of the map that every series is described by, as columns; absent ones are NULL."""
    tags = {
        "patient_id": TAG_SUBJECT,
        "study_id": TAG_STUDY,
        "series_id": TAG_SERIES,
        "time_point": TAG_TIME,
        "description": TAG_DESCRIPTION,
        "modality": TAG_MODALITY,
        "laterality": TAG_LATERALITY,
    }
    return slices.withColumns({name: present(F.col("meta")[tag]) for name, tag in tags.items()})


def series_metadata(slices: DataFrame) -> DataFrame:
    """One row per series with its merged tags, typed values, bounds and shape.

    A merged value is the least that is not empty. All come from one aggregate over
    narrow columns, so slices shuffle once, as partial results. Absent values get
    their defaults here.
    """
    least = {"_time": "time_point", "_description": "description", "_study": "study_id", "_subject": "patient_id"}
    least |= {"_laterality": "laterality", "_modality": "modality"}
    merged = slices.groupBy("series_id").agg(
        *_metadata_facts(),
        *_bound_aggregates(),
        *[F.expr(f"min(nullif({column}, '')) AS {name}") for name, column in least.items()],
        F.min("slice_spacing").alias("_dz"),
        F.min("pixel_spacing").alias("_spacing"),
        F.min("position").alias("_position"),
        F.min("orientation").alias("_orientation"),
    )
    return merged.select(
        F.coalesce("_subject", F.lit(DEFAULT_SUBJECT)).alias("patient_id"),
        F.coalesce("_study", F.lit("")).alias("study_id"),
        "series_id",
        F.coalesce("_time", F.lit(DEFAULT_TIME)).alias("time"),
        description_flags(F.coalesce("_description", F.lit(""))).alias("flags"),
        F.coalesce("_laterality", F.lit("")).alias("laterality"),
        F.coalesce("_modality", F.lit("")).alias("modality"),
        F.coalesce("_dz", F.lit(float(MISSING))).alias("slice_spacing"),
        F.coalesce("_spacing", _doubles([MISSING, MISSING])).alias("pixel_spacing"),
        F.coalesce("_position", _doubles(DEFAULT_POSITION)).alias("position"),
        F.coalesce("_orientation", _doubles(DEFAULT_ORIENTATION)).alias("orientation"),
        _z_bound().alias("z_bound"),
        F.expr("array(CAST(n_slices AS INT), rows_max, cols_max) AS shape"),
        "n_slices",
        F.coalesce(_fault("false"), F.lit("ok")).alias("status"),
    )


def series_features(series: DataFrame) -> DataFrame:
    """Feature columns of every valid series and the name they go under."""
    ids = dicom_id(F.col("study_id"), F.col("series_id"))
    return series.where(F.col("status") == "ok").select(
        "patient_id",
        "study_id",
        "series_id",
        feature_name(F.col("time"), F.col("flags"), F.col("study_id"), F.col("series_id")).alias("feature_name"),
        ids.alias("dicom_id"),
        F.get("pixel_spacing", F.lit(0)).alias("dx"),
        F.get("pixel_spacing", F.lit(1)).alias("dy"),
        F.col("slice_spacing").alias("dz"),
        (F.col("modality") == "SEG").cast("int").alias("is_seg"),
        (F.col("laterality") == "R").cast("int").alias("right"),
        "shape",
        "position",
        "orientation",
        "z_bound",
    )


def _value(i: str = "NULL", f: str = "NULL", s: str = "NULL") -> str:
    return f"named_struct('i', CAST({i} AS ARRAY<BIGINT>), 'f', CAST({f} AS ARRAY<DOUBLE>), 's', CAST({s} AS STRING))"


def feature_long(features: DataFrame) -> DataFrame:
    """One row per feature, its name led by the name of the series.

    ``image`` holds the id of the series whose voxels it stands for; voxels stay in
    the volume table.
    """
    values = {
        "image": _value(s="series_id"),
        "dx": _value(f="array(dx)"),
        "dy": _value(f="array(dy)"),
        "dz": _value(f="array(dz)"),
        "is_seg": _value(i="array(is_seg)"),
        "right": _value(i="array(`right`)"),
        "shape": _value(i="shape"),
        "dicom_id": _value(s="dicom_id"),
        "Image Position (Patient)": _value(f="position"),
        "Image Orientation (Patient)": _value(f="orientation"),
        "z_bound": _value(f="array(z_bound.lo, z_bound.hi)"),
    }
    entries = ", ".join(f"named_struct('key', '{key}', 'value', {value})" for key, value in values.items())
    exploded = features.selectExpr(
        "patient_id", "study_id", "series_id", "feature_name", f"inline(array({entries})) AS (_key, value)"
    )
    return exploded.selectExpr(
        "patient_id", "study_id", "series_id", "concat(feature_name, _key) AS feature_name", "value"
    )


def image_features(features: DataFrame) -> DataFrame:
    return features.where(F.col("feature_name").contains("/image"))


def feature_dedup(features: DataFrame) -> DataFrame:
    """One value per patient and feature name: that of the greatest (study, series).

    ``n_collisions`` counts the values that gave way. Rows that are alike in all columns count, and give one value.
    """
    source, name = ["study_id", "series_id"], ["patient_id", "feature_name"]
    coded = joined_to(features.select(*name, *source, "value"), value_codes(features, source), source)
    best = coded.groupBy(*name).agg(F.max("_code").alias("_code"), (F.count(F.lit(1)) - 1).alias("n_collisions"))
    kept = joined_to(coded, best, [*name, "_code"])
    return kept.select(*name, *source, "value", "n_collisions").distinct()

"""Labelled, fixed-shape samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.functions import pixels as px
from cohortweave.functions.values import drawn, known
from cohortweave.operators.ranking import global_row_number, joined_to, least_values
from cohortweave.schemas import (
    MAX_ROTATION,
    NOISE_STDDEV,
    PREFERRED_FEATURES,
    REQUIRED_FEATURES,
    RESPONSE_GROUPS,
    SAMPLE_HEIGHT,
    SAMPLE_WIDTH,
)

# Pixels handed back by a Python task at a time.
_BATCH_PIXELS = 4_194_304


def labelled_only(records: DataFrame) -> DataFrame:
    """Records whose id and both results are there."""
    return records.where(known(F.col("patient_id")) & known(F.col("pCR")) & known(F.col("RCB")))


def response_group(pcr: Column, rcb: Column) -> Column:
    """1: complete response; 2: residual burden up to 2; 3: more."""
    return F.when(pcr == 1, 1).when(rcb <= 2, 2).otherwise(3).cast("int")


def one_hot(group: Column, depth: int = RESPONSE_GROUPS) -> Column:
    """All zeros for a group outside 1..depth."""
    return F.array(*[(group == g).cast("float") for g in range(1, depth + 1)])


def has_required_features(
    features: DataFrame, required: Sequence[str] = tuple(REQUIRED_FEATURES), key: str = "patient_id"
) -> DataFrame:
    """Keys that have every required feature, counted after the names are filtered."""
    names = features.where(F.col("feature_name").isin(list(required))).select(key, "feature_name").distinct()
    return names.groupBy(key).agg(F.count(F.lit(1)).alias("n_required")).where(
        F.col("n_required") == len(set(required))
    )


def required_series(
    features: DataFrame, required: Sequence[str] = tuple(REQUIRED_FEATURES), key: str = "patient_id"
) -> DataFrame:
    """Required features of the keys that have them all; other features drop."""
    whole = has_required_features(features, required, key).select(key)
    return features.where(F.col("feature_name").isin(list(required))).join(whole, key, "left_semi")


def preferred_series(
    features: DataFrame, preferred: Sequence[str] = tuple(PREFERRED_FEATURES), key: str = "patient_id"
) -> DataFrame:
    """The first feature of the list that a key has, with its series; of several series, the least.

    Keys find their least place in the list, a number; the series of that place alone are compared.
    """
    places = F.create_map(*[F.lit(v) for pair in ((n, i) for i, n in enumerate(preferred)) for v in pair])
    listed = features.where(F.col("feature_name").isin(list(preferred))).select(key, "series_id", places[F.col("feature_name")].alias("priority"))
    first = listed.groupBy(key).agg(F.min("priority").alias("priority"))
    of_first = joined_to(listed, first, [key, "priority"])
    if isinstance(features.schema["series_id"].dataType, T.NumericType):
        least = of_first.groupBy(key, "priority").agg(F.min("series_id").alias("series_id"))
    else:
        least = least_values(of_first, [key, "priority"], "series_id")
    names = F.array(*[F.lit(n) for n in preferred])
    return least.select(key, "priority", F.get(names, F.col("priority")).alias("feature_name"), "series_id")


def sample_fault(height: int, width: int) -> Column:
    """Why a row is no sample; NULL for a good one."""
    return (
        F.when(F.col("pixels").isNull(), "no_image")
        .when(F.size("pixels") == 0, "no_image")
        .when(px.is_absent_image(F.col("pixels")), "absent_image")
        .when(F.size("pixels") != height * width, "wrong_shape")
        .when(~(known(F.col("pCR")) & known(F.col("RCB"))), "no_label")
    )


def sample_input(rows: DataFrame, height: int = SAMPLE_HEIGHT, width: int = SAMPLE_WIDTH) -> DataFrame:
    """Samples of one fixed shape with their one-hot label."""
    group = response_group(F.col("pCR"), F.col("RCB"))
    return rows.where(sample_fault(height, width).isNull()).select(
        "patient_id",
        "pixels",
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        group.alias("response_group"),
        one_hot(group).alias("label"),
    )


def sample_quarantine(rows: DataFrame, height: int = SAMPLE_HEIGHT, width: int = SAMPLE_WIDTH) -> DataFrame:
    return rows.select("patient_id", sample_fault(height, width).alias("reason")).where("reason is not null")


def sample_take(samples: DataFrame, n: int, *order: str) -> DataFrame:
    return samples.orderBy(*order).limit(n)


def sample_shuffle(samples: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A full shuffle that is the same for the same seed, and each row's place in it.

    Rows are ordered by a digest of key and seed, numbered over range partitions.
    """
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    numbered = global_row_number(samples.withColumn("_draw", drawn), ["_draw", key], "place", start=0)
    return numbered.drop("_draw").orderBy("place")


def buffered_shuffle(samples: DataFrame, key: str, shard: str, buffer: int = 1_000, seed: int = 0) -> DataFrame:
    """Samples of every shard in a shuffled order, and their ``place`` in it.

    A shard is read in key order through a buffer: ``buffer`` samples after another are put in the order of a
    digest of key and seed, so a sample moves by less than ``buffer`` places and no table is sorted as a whole. The
    order depends on key and seed alone, hence is the same after a retry. A task holds one buffer.
    """
    drawn = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    ordered = samples.withColumn("_draw", drawn).repartition(shard).sortWithinPartitions(shard, key)
    schema = T.StructType([*samples.schema, T.StructField("place", T.LongType())])
    at_shard = samples.columns.index(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # samples of the shard at hand that are not handed on
        start = 0

        def shuffled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            order = pc.sort_indices(rows.column("_draw"))
            made = rows.drop_columns(["_draw"]).take(order).append_column("place", pa.array(np.arange(start, start + len(rows))))
            yield from made.combine_chunks().to_batches()

        for batch in batches:
            column = batch.column(at_shard)
            same = pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False) if len(column) > 1 else pa.array([], pa.bool_())
            both = pc.and_(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, max(len(column) - 1, 0))))
            cuts = [0, *(np.flatnonzero(~pc.or_(same, both).to_numpy(zero_copy_only=False)) + 1).tolist(), len(column)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if held is not None and not held.column(at_shard)[0].equals(part.column(at_shard)[0]):
                    yield from shuffled(held)
                    held, start = None, 0
                held = part if held is None else pa.concat_tables([held, part])
                while len(held) > buffer:
                    yield from shuffled(held.slice(0, buffer))
                    held, start = held.slice(buffer), start + buffer
        if held is not None:
            yield from shuffled(held)

    return ordered.mapInArrow(run, schema)


def label_names(samples: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Names of class labels; a label without a name keeps its row."""
    return samples.join(names.select(label, "name"), label, "left")


def _with_images(part: pa.RecordBatch, images: np.ndarray) -> pa.RecordBatch:
    """The batch with other images, one per row."""
    n, height, width = images.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (height * width)
    kind = part.schema.field("pixels").type
    flat = pa.array(np.ascontiguousarray(images, dtype=np.float32).reshape(-1))
    new = {
        "pixels": pa.ListArray.from_arrays(pa.array(offsets), flat, type=kind),
        "height": pa.array(np.full(n, height, dtype=np.int32)),
        "width": pa.array(np.full(n, width, dtype=np.int32)),
    }
    columns = [new.get(name, part.column(i)) for i, name in enumerate(part.schema.names)]
    return pa.RecordBatch.from_arrays(columns, schema=part.schema)


def _map_images(samples: DataFrame, apply: Callable, pixels_out: int = 0) -> DataFrame:
    """Give images to numpy in parts of one shape and of bounded size, without leaving Arrow.

    ``apply(images, part)`` returns the new images, or None to keep the rows as they
    are. Rows without an image pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("pixels").is_valid().to_numpy(zero_copy_only=False)
            if not there.all():
                yield batch.filter(pa.array(~there))
                batch = batch.filter(pa.array(there))
            shapes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width")], axis=1)
            for height, width in np.unique(shapes, axis=0):
                same = np.flatnonzero((shapes == (height, width)).all(axis=1))
                step = max(1, _BATCH_PIXELS // max(pixels_out, int(height * width), 1))
                for at in range(0, len(same), step):
                    part = batch.take(pa.array(same[at : at + step]))
                    flat = part.column("pixels").flatten().to_numpy(zero_copy_only=False)
                    images = apply(flat.reshape(part.num_rows, height, width), part)
                    yield part if images is None else _with_images(part, images)

    return samples.mapInArrow(run, samples.schema)


def resized(samples: DataFrame, height: int = SAMPLE_HEIGHT, width: int = SAMPLE_WIDTH, swap: bool = False) -> DataFrame:
    """Images brought to one size; those of that size already stay as they are.

    With ``swap`` rows and columns change places first.
    """

    def apply(images: np.ndarray, part: pa.RecordBatch) -> np.ndarray | None:
        if swap:
            images = np.swapaxes(images, 1, 2)
        if images.shape[1:] == (height, width):
            return images if swap else None
        return px.resize_batch(images.astype(np.float64), height, width)

    return _map_images(samples, apply, height * width)


def rotated(samples: DataFrame, angle: str) -> DataFrame:
    """Images turned by the angle of their row, in radians."""

    def apply(images: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        return px.rotate_batch(images, part.column(angle).to_numpy(zero_copy_only=False).astype(np.float64))

    return _map_images(samples, apply)


def augmented(samples: DataFrame, key: str = "patient_id", seed: int = 0) -> DataFrame:
    """Random turn, noise and flips, decided by the key and the seed alone.

    Half of the images turn by up to 0.2 radians. Half get noise, a clip to 0..1 and,
    half of those again, an up-down flip. Half of all flip left to right. What happens to
    a row is drawn by expressions; its pixels are worked on in one pass over Arrow batches.
    """
    chance = lambda stream: px.unit_hash(F.col(key), seed * 16 + stream)
    drawn_row = samples.withColumns(
        {
            "_angle": F.when(chance(0) > 0.5, (chance(1) * 2 - 1) * MAX_ROTATION).otherwise(0.0),
            "_noisy": chance(2) > 0.5,
            "_up": chance(3) > 0.5,
            "_mirrored": chance(7) > 0.5,
            "_base": F.pmod(drawn(F.col(key), seed * 16 + 4, 8), F.lit(px.NOISE_MODULUS).cast("bigint")),
        }
    )

    def apply(images: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        angle, base = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_angle", "_base"))
        noisy, up, mirrored = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_noisy", "_up", "_mirrored"))
        images = px.rotate_batch(images, angle.astype(np.float64)).copy()
        images[noisy] = px.noisy_batch(images[noisy], base[noisy], NOISE_STDDEV)
        images[noisy & up] = images[noisy & up][:, ::-1]
        images[mirrored] = images[mirrored][:, :, ::-1]
        return images

    return _map_images(drawn_row, apply).select(*samples.columns)

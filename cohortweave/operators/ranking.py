"""Row numbers over whole tables and within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.operators.shared import written

# monotonically_increasing_id keeps the partition above bit 33 and the row below.
_ROW_BITS = 33


def _same_group(keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two sides named ``l`` and ``r``."""
    return reduce(and_, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])


def joined_to(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, which then equal each other; the keys come once."""
    more = [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), _same_group(keys)).select(*[F.col(f"l.`{c}`") for c in left.columns], *more)


def global_row_number(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """``row_number() over (order by order)`` without a one-task window.

    ``order`` must name a unique key. Rows are range-partitioned on it, numbered
    in their partition, and shifted by the rows of the partitions before.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = written(ranged, "numbered")
    part = F.shiftright("_at", _ROW_BITS)
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per range partition, so the window and the broadcast stay small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(part.alias("_part"))
        .agg((F.max(row) + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .select(*df.columns, (row + F.col("_shift") + F.lit(start)).alias(out))
    )


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number() over (partition by group order by order)`` for groups of any size.

    ``group`` and ``order`` together must be a unique key. Range partitions, which split a large group, are
    sorted and numbered in one pass, anew for every group. Only a group that goes on from the partition
    before needs more: the rows it had so far, of which there is one number per partition.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = _numbered_in_place(ranged.withColumn("_part", F.spark_partition_id()), group)
    placed = written(numbered, "ranked", "zstd")
    # One row per range partition: its last group, and the rows of that group up to here.
    ends = placed.where("_last").select("_part", *group, "_in")
    so_far = Window.partitionBy(*group).orderBy("_part")
    carried = ends.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_part"), *group, F.sum("_in").over(so_far).alias("_before")
    )
    same = reduce(and_, [_same_group(group), F.col("l._part") == F.col("r._part")])
    return (
        placed.alias("l")
        .join(F.broadcast(carried).alias("r"), same, "left")
        .select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._in") + F.coalesce("r._before", F.lit(0))).alias(out))
    )


def _numbered_in_place(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``_in``, the number of a row within its run of equal groups, and ``_last``, whether a partition ends with it."""
    schema = T.StructType([*df.schema, T.StructField("_in", T.LongType()), T.StructField("_last", T.BooleanType())])
    places = [df.columns.index(c) for c in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the row before the batch at hand, with its number
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = changed_rows(batch, places, held)
            at = np.arange(batch.num_rows)
            carried = 0 if held is None or changed[0] else held.column(len(schema) - 2)[0].as_py()
            changed[0] = True
            first = np.maximum.accumulate(np.where(changed, at, 0))
            within = at - first + 1 + np.where(first == 0, carried, 0)
            flags = pa.array(np.zeros(batch.num_rows, dtype=bool))
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(within), flags], schema.names)
            if held is not None:
                yield held
            yield made.slice(0, batch.num_rows - 1)
            held = made.slice(batch.num_rows - 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array([True])], schema.names)

    return df.mapInArrow(number, schema)


def changed_rows(batch: pa.RecordBatch, places: Sequence[int], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row differs, in the columns at ``places``, from the one ahead of it: ``before`` for the first, if any."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = before is None
    for i in places:
        column = batch.column(i)
        changed[1:] |= ~_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
        if before is not None:
            changed[0] |= not _equal(column.slice(0, 1), before.column(i))[0]
    return changed


def _equal(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Null-safe equality, row by row."""
    same = pc.fill_null(pc.equal(left, right), False)
    return pc.or_(same, pc.and_(pc.is_null(left), pc.is_null(right))).to_numpy(zero_copy_only=False)


def value_codes(values: DataFrame, columns: Sequence[str], out: str = "_code") -> DataFrame:
    """A dictionary: every different combination of ``columns`` and its number in their order, from 1.

    Least and greatest values of text, lists and structs can then be found as numbers, which
    hash aggregation keeps in place; the values themselves would be sorted by key first.
    """
    return global_row_number(values.select(*columns).distinct(), columns, out)


def least_values(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least non-null ``value`` per combination of ``keys``, and ``n_distinct`` of them, without sorting the rows.

    Rows are reduced to different values per key first, so the dictionary and both joins see only those.
    """
    once = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("_once")).drop("_once"), "values")
    codes = value_codes(once, [value])
    least = once.join(codes, value).groupBy(*keys).agg(F.min("_code").alias("_code"), F.count(F.lit(1)).alias("n_distinct"))
    return least.join(codes, "_code").select(*keys, value, "n_distinct")


def list_blocks(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    out: str,
    block_rows: int = 1_000,
) -> DataFrame:
    """Ordered lists per group, in numbered blocks of at most ``block_rows`` entries.

    A short group has one block, which is its whole list; a long group has as
    many as it needs, so no task ever holds more than ``block_rows`` entries.
    """
    needed = list(dict.fromkeys([*group, *order, *values]))
    ranked = rank_within(df.select(*needed), group, order, "_rank")
    entry = F.struct("_rank", *values)
    item = (lambda x: x[values[0]]) if len(values) == 1 else (lambda x: F.struct(*[x[v].alias(v) for v in values]))
    return (
        ranked.withColumn("block_no", F.floor((F.col("_rank") - 1) / block_rows).cast("bigint"))
        .groupBy(*group, "block_no")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(*group, "block_no", "n_entries", F.transform("_entries", item).alias(out))
    )

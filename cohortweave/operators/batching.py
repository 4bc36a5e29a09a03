"""Bounded batches, fixed-size shards and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.values import bucket_of
from cohortweave.operators.ranking import global_row_number
from cohortweave.operators.shared import written


def _prefix(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _fits_until(prefix: np.ndarray, start: int, room: int) -> int:
    """First group after ``start`` that no longer fits into ``room``."""
    return int(np.searchsorted(prefix, prefix[start] + room, side="right")) - 1


def _batch_starts(prefix: np.ndarray, start: int, limit: int) -> list[int]:
    """Where batches start, the first at ``start``; an oversize group is alone."""
    starts, n = [], len(prefix) - 1
    while start < n:
        starts.append(start)
        start = max(_fits_until(prefix, start, limit), start + 1)
    return starts


def _chunk_outcomes(chunk: int, sizes: np.ndarray, limit: int) -> pd.DataFrame:
    """What a chunk does to the batch that is open before it, for every case.

    ``head`` is how much of the chunk still enters the open batch. Then ``opened``
    batches start and the last has a fill of ``fill``; with none opened, the chunk
    adds ``fill`` to the open batch.
    """
    prefix, n = _prefix(sizes), len(sizes)
    after = np.maximum(np.searchsorted(prefix, prefix[:-1] + limit, side="right") - 1, np.arange(1, n + 1))
    # Pointer doubling: jumps of 1, 2, 4, ... batches at a time.
    opened, last, jump = np.ones(n + 1, dtype=np.int64), np.arange(n + 1), np.append(after, n)
    opened[n] = 0
    while (jump[:n] < n).any():
        more = jump < n
        opened += np.where(more, opened[jump], 0)
        last = np.where(more, last[jump], last)
        jump = jump[jump]
    opened, last = opened[:n], last[:n]
    heads = np.arange(_fits_until(prefix, 0, limit - 1) + 1)
    whole = heads == n
    at = np.minimum(heads, n - 1)
    return pd.DataFrame(
        {
            "chunk": chunk,
            "head": prefix[heads],
            "opened": np.where(whole, 0, opened[at]),
            "fill": np.where(whole, prefix[n], prefix[n] - prefix[last[at]]),
        }
    )


def _enter_chunks(outcomes: pd.DataFrame, limit: int, fill: int = 0, opened: int = 0) -> pd.DataFrame:
    """Fill of the open batch and batches opened before every chunk, from those before the first."""
    rows = []
    for chunk, cases in outcomes.sort_values(["chunk", "head"]).groupby("chunk", sort=True):
        rows.append((int(chunk), fill, opened))
        # A full batch, or none at all yet, takes nothing of the chunk.
        room = 0 if opened == 0 else max(limit - fill, 0)
        case = cases.iloc[int(np.searchsorted(cases["head"].to_numpy(), room, side="right")) - 1]
        fill = int(case["fill"]) + (fill if case["opened"] == 0 else 0)
        opened += int(case["opened"])
    return pd.DataFrame(rows, columns=["chunk", "fill", "opened"])


def _assign_chunk(groups: pd.DataFrame, fill: int, opened: int, limit: int) -> np.ndarray:
    prefix = _prefix(groups["n"].to_numpy())
    room = 0 if opened == 0 else max(limit - fill, 0)
    starts = _batch_starts(prefix, _fits_until(prefix, 0, room), limit)
    return opened - 1 + np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(groups)), side="right")


def pack_groups(
    sizes: DataFrame, key: str, size: str, limit: int = 20, chunk_rows: int = 100_000, fill: int = 0, opened: int = 0
) -> DataFrame:
    """Put whole groups, in key order, into batches of at most ``limit`` members.

    A batch closes when the next group would overflow it; a group above the limit
    has a batch of its own. The result is that of one pass over all groups, but no
    task makes that pass: chunks of ``chunk_rows`` groups first work out their
    outcome for every fill they may meet (at most ``limit`` rows each), these
    outcomes are chained, and every chunk then numbers its groups by itself. A NULL
    key names no group and is left out. ``opened`` batches may be there already, the last
    with ``fill`` members: then packing goes on from there.
    """
    known = sizes.where(F.col(key).isNotNull())
    numbered = global_row_number(
        known.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")), ["k"], "at", start=0
    )
    numbered = written(numbered.withColumn("chunk", F.floor(F.col("at") / chunk_rows).cast("bigint")), "groups")
    counted = numbered.select("at", "n", "chunk")  # keys of any type and size stay out of Python

    def outcomes(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("at")
        return _chunk_outcomes(int(groups["chunk"].iloc[0]), groups["n"].to_numpy(), limit)

    def chain(cases: pd.DataFrame) -> pd.DataFrame:
        return _enter_chunks(cases, limit, fill, opened)

    def assign(groups: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("at")
        batch = _assign_chunk(groups, int(entry["fill"].iloc[0]), int(entry["opened"].iloc[0]), limit)
        return pd.DataFrame({"at": groups["at"].to_numpy(), "batch_id": batch})

    entries = (
        counted.groupBy("chunk")
        .applyInPandas(outcomes, "chunk bigint, head bigint, opened bigint, fill bigint")
        .groupBy()
        .applyInPandas(chain, "chunk bigint, fill bigint, opened bigint")
    )
    placed = counted.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInPandas(assign, "at bigint, batch_id bigint")
    return numbered.join(placed, "at").select(F.col("k").alias(key), F.col("n").alias(size), "batch_id")


def batched_cohort(series: DataFrame, key: str = "patient_id", limit: int = 20, chunk_rows: int = 100_000) -> DataFrame:
    """Series with the batch of their patient; every patient is in one batch.

    Series without a patient keep their rows, with no batch.
    """
    sizes = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return series.join(pack_groups(sizes, key, "n", limit, chunk_rows).select(key, "batch_id"), key, "left")


def continued_batches(
    series: DataFrame, log: DataFrame, key: str = "patient_id", limit: int = 20, chunk_rows: int = 100_000
) -> DataFrame:
    """Log rows ``key, n, batch_id`` of the patients that ``log`` does not have yet.

    ``log`` holds the patients of earlier runs, as this function or :func:`pack_groups` gave them; it may be empty.
    The new ones go, in key order, into the batch that was left open and those after it, so where their keys
    come after the old ones, runs one after another give the batches of a single run. A patient of the log keeps
    its batch, whatever is new about it.
    """
    sizes = series.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    new = sizes.join(log.select(key), key, "left_anti")
    fills = log.groupBy("batch_id").agg(F.sum("n").alias("fill"))
    last = fills.agg(F.max(F.struct("batch_id", "fill")).alias("last")).select("last.*").first()  # one row
    fill, opened = (0, 0) if last["batch_id"] is None else (last["fill"], last["batch_id"] + 1)
    return pack_groups(new, key, "n", limit, chunk_rows, fill, opened)


def _with_number(records: DataFrame, key: str, out: str) -> DataFrame:
    """Number records from 0 in the order of a unique key.

    Keys alone are numbered and joined back, so pixels shuffle once at most and
    are not written a second time.
    """
    return records.join(global_row_number(records.select(key), [key], out, start=0), key)


def fixed_size_shards(records: DataFrame, key: str = "patient_id", shard_size: int = 8) -> DataFrame:
    """Valid records numbered in key order and cut into shards; the last may be short."""
    numbered = _with_number(records, key, "record_no")
    return numbered.withColumn("shard_id", F.floor(F.col("record_no") / shard_size).cast("bigint"))


def sample_batches(samples: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Batches of ``batch_size`` samples in key order."""
    numbered = _with_number(samples, key, "_no")
    return numbered.withColumn("batch_id", F.floor(F.col("_no") / batch_size).cast("bigint")).drop("_no")


def split_by_key(
    samples: DataFrame, key: str, seed: int = 0, train: int = 80, val: int = 10, bucket: Column | None = None
) -> DataFrame:
    """Split by a repeatable bucket (0..99) of the key, so a patient is in one split only."""
    at = bucket_of(F.col(key), 100, seed) if bucket is None else bucket
    name = F.when(at < train, "train").when(at < train + val, "val").otherwise("test")
    return samples.withColumn("split", name)


def split_by_position(samples: DataFrame, key: str, train: int = 80, val: int = 10) -> DataFrame:
    """The first ``train`` percent of the rows in key order, the next ``val``, the rest."""
    numbered = _with_number(samples, key, "_no")
    total = samples.count()
    name = (
        F.when(F.col("_no") < total * train // 100, "train")
        .when(F.col("_no") < total * (train + val) // 100, "val")
        .otherwise("test")
    )
    return numbered.withColumn("split", name).drop("_no")


"""Harmonic packing of token sequences with fixed counts per bin (operator 5).

Pieces are sorted into classes by reciprocals of the capacity: class j holds lengths in
``(capacity / (j + 1), capacity / j]``, and a bin of class j takes exactly j pieces, whatever they
are. So no bin depends on another: every worker numbers the pieces of a class as it meets them,
the numbers are shifted by the counts of the workers before (a table of workers times classes),
and piece r of class j lies in bin ``r div j``.

Documents are cut so that little is wasted: whole capacities first, then the largest reciprocal
``capacity div j`` that still fits, until at most ``SMALL`` ids are left; a rest that fills its
class to within ``SLACK`` of a bin stays whole. Bins then lack a few ids at most, but for those of
the small rests, which lack a seventeenth at most.

The last, unfinished bin of each class is taken apart, and these pieces (less than j for class j,
some thousands whatever the input) are packed first fit decreasing in one task.

Pieces get their numbers when they are written to the shared folder, so a task that runs again
cannot change them. Edge cases: a null text is empty and is a piece of the end id alone; rows with
equal ids are packed one by one; an empty table gives an empty one; texts may be of any length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm import bpe
from cohortweave.llm.rowmaps import PART_BYTES, column
from cohortweave.operators.shared import written

CAPACITY = 1024
END_ID = 0
SMALL = 64
SLACK = 16


def cut_lengths(n: int, capacity: int = CAPACITY, small: int = SMALL, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > small and capacity - (capacity // rest) * rest > slack:
        lengths.append(capacity // -(-capacity // rest))
        rest -= lengths[-1]
    return lengths + [rest] * (rest > 0)


def cut_documents(docs: DataFrame, key: str, text: str, end: int, vocabulary: str | None, capacity: int, with_ids: bool) -> DataFrame:
    """One row per piece with its class, the task that made it and its number there."""
    source = docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text"))
    key_type = source.schema["_key"].dataType.simpleString()
    schema = f"_key {key_type}, start long, length long, ids_crc32 long, doc_tokens long, class int, part long, number long"
    schema += ", ids array<int>" if with_ids else ""
    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "number"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), Counter()
        tool = bpe.encoder(vocabulary)
        for batch in batches:
            owners, rows, ids_out = [], [], []
            for i, content in enumerate(batch.column(1).to_pylist()):
                ids = tool.array(content, end)
                start = 0
                for length in cut_lengths(len(ids), capacity):
                    piece, j = ids[start : start + length], capacity // length
                    rows.append((start, length, zlib.crc32(piece.tobytes()), len(ids), j, part, met[j]))
                    owners.append(i)
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    met[j] += 1
                    start += length
            table = np.array(rows, dtype=np.int64).reshape(-1, 7)
            arrays = [batch.column(0).take(pa.array(owners, pa.int64()))]
            arrays += [pa.array(table[:, c].astype(np.int32 if c == 4 else np.int64)) for c in range(7)]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place of each length; the longest are put first."""
    free: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bin_no = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if bin_no == len(free):
            free.append(capacity)
        out[i] = (bin_no, capacity - free[bin_no])
        free[bin_no] -= lengths[i]
    return out


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END_ID,
    vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key, ``start, length, ids_crc32, doc_tokens, sequence_id, offset, class``.

    ``with_ids`` adds the ids themselves, which ``sequences`` then puts together.
    """
    pieces = written(cut_documents(docs, key, text, end, vocabulary, capacity, with_ids), "pieces", batch_bytes=PART_BYTES)
    counts = written(pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # Rows of this table: tasks times classes. A class's window is over the tasks.
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shift"))
    # One row per class, of which there are fewer than ``capacity``.
    bins = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("_full"))
    over = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("class", "_full", F.coalesce(F.sum("_full").over(over), F.lit(0)).alias("_base"))
    total = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("f")).agg(F.sum("f")).first()[0] or 0

    placed = pieces.join(shifts, ["class", "part"]).join(F.broadcast(bins), "class")
    placed = placed.withColumn("_rank", F.col("number") + F.col("_shift")).withColumn("_bin", F.expr("_rank div class"))
    body, tail = placed.where("_bin < _full"), placed.where("_bin >= _full")
    inside = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumn("sequence_id", F.col("_base") + F.col("_bin")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "class", "_rank"], ascending=[False, True, True], kind="stable")
        spots = first_fit_decreasing(frame["length"].tolist(), capacity)
        return pd.DataFrame({"class": frame["class"], "_rank": frame["_rank"], "_in": [b for b, _ in spots], "offset": [o for _, o in spots]})

    spots = tail.select("class", "_rank", "length").groupBy().applyInPandas(fill, "class int, _rank long, _in long, offset long")
    tail = tail.join(spots, ["class", "_rank"]).withColumn("sequence_id", F.col("_in") + F.lit(total))
    columns = [F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id")]
    columns += [F.col("offset").cast("long").alias("offset"), "class"] + ["ids"] * with_ids
    return body.select(*columns).unionByName(tail.select(*columns))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence put together (at most one capacity of ids)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

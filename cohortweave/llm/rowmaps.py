"""Small helpers the operators share: Arrow passes, free column names, settings of the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PART_BYTES = 4 << 20  # of a batch that are worked on and handed back at once


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until no column has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(
    df: DataFrame,
    text: str,
    make: Callable[[pa.Array], dict[str, pa.Array]],
    added: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns computed from the texts, batch by batch, beside the columns kept (all by default).

    ``make`` gets an Arrow array of texts and returns one array of the same length for each
    field of ``added``. A failed task computes the same rows again. Texts that are kept are sent once, and
    go back in parts of about ``PART_BYTES``.
    """
    kept = list(df.columns if keep is None else keep)
    own = kept.index(text) if text in kept and df.schema[text].dataType == T.StringType() else None
    sent = [column(c).alias(f"_k{i}") for i, c in enumerate(kept)]
    source = df.select(*sent, *([column(text).cast("string").alias("_of")] if own is None else []))
    schema = T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + list(added))
    at = len(kept) if own is None else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
            for low in range(0, max(batch.num_rows, 1), step):
                part = batch.slice(low, step)
                made = make(part.column(at))
                arrays = list(part.columns[: len(kept)]) + [made[f.name] for f in added]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in added])


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Lists cut out of one array by n + 1 borders."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or of more than ``most`` about that many, and no more: those of the least hash of their key.

    Rows above the share that is wanted are dropped where they are, so that what the limit
    then gathers does not grow with the table.
    """
    total = rows.count()
    drawn = F.pmod(F.xxhash64(column(key)), F.lit(1 << 30))
    below = int(min(1.0, most / max(total, 1)) * (1 << 30))
    return rows.where(drawn < below).orderBy(drawn, column(key)).limit(most)

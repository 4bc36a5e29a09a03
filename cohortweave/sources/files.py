"""File trees ``root/study/series/file`` on any file system Spark can reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortweave.functions.text import path_file, path_parent

class AccessError(Exception):
    """A file could not be read or decoded."""


class MetadataError(Exception):
    """The tags of a file could not be understood."""


STATUS_OF_ERROR = {AccessError: "access_error", MetadataError: "metadata_error"}


def _files(spark: SparkSession, root: str, pattern: str | None) -> DataFrame:
    """Files exactly two directories below ``root``, each with its place in the tree.

    The recursive listing fans out over the cluster where there are many folders.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    place = F.regexp_extract(F.col("path"), r"^(.*)/[^/]+/[^/]+/[^/]+$", 1)
    return reader.load(root).where(bare(place) == bare(F.lit(root.rstrip("/"))))


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """One row per file ``root/study/series/file``; contents are not read.

    ``root`` is absolute. ``pattern`` is a name pattern such as ``*.dcm``. Files at
    any other depth are not listed. The list of files passes through the driver, as
    with every file source; beyond some millions of files start from a table of
    paths instead (:func:`fetch_and_decode`).
    """
    return _placed(_files(spark, root, pattern), "length")


def _placed(files: DataFrame, *more: str) -> DataFrame:
    path = F.col("path")
    return files.select(
        "path",
        F.try_element_at(F.split(path, "/"), F.lit(-3)).alias("study_id"),
        path_parent(path).alias("series_id"),
        path_file(path).alias("file_name"),
        *more,
    )


def files_of_paths(paths: DataFrame) -> DataFrame:
    """The same rows for a table of paths ``…/study/series/file``; nothing is listed or opened."""
    return _placed(paths.select(F.col("path").cast("string").alias("path")).where("path IS NOT NULL").distinct())


def series_directories(files: DataFrame) -> DataFrame:
    """The series a listing holds, each with its files counted.

    Grouped on the whole directory, so an id that starts another id stays apart.
    """
    return files.groupBy("study_id", "series_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.regexp_replace(F.min("path"), r"[^/]+$", "").alias("series_path"),
    )


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Paths and contents, to be decoded after any filter on the paths."""
    return _files(spark, root, pattern).select("path", "content")


def open_uri(path: str) -> bytes:
    """Contents of one file, read where the task runs."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as stream:
        return stream.read()


def fetch_and_decode(
    paths: DataFrame,
    decoder: Callable[[str, bytes], dict],
    schema: T.StructType,
    fetch: Callable[[str], bytes] = open_uri,
) -> DataFrame:
    """Decode the files of a table of paths. Tasks fetch them, a few at a time.

    A caller may pass its own ``fetch(path)``. A file that cannot be fetched keeps its
    row as an access error.
    """

    def fetch_then_decode(path: str, content: bytes) -> dict:
        try:
            content = fetch(path)
        except Exception as error:
            raise AccessError(str(error)) from error
        return decoder(path, content)

    empty = F.lit(b"").alias("content")
    return decode_files(paths.select("path", empty), fetch_then_decode, schema)


def decode_files(files: DataFrame, decoder: Callable[[str, bytes], dict], schema: T.StructType) -> DataFrame:
    """Apply a caller's decoder to every file; a failed file keeps its row and says why.

    ``decoder(path, content)`` gives the values of ``schema`` by name. The output
    has ``path``, those columns, ``status`` and ``reason``.
    """
    fields = [f for f in schema if f.name not in ("path", "status", "reason")]
    names = [f.name for f in fields]
    out = (
        T.StructType([T.StructField("path", T.StringType())] + [T.StructField(f.name, f.dataType) for f in fields])
        .add("status", T.StringType())
        .add("reason", T.StringType())
    )

    arrow = to_arrow_schema(out)
    value_types = [arrow.field(n).type for n in names]

    def failed(path: str, error: Exception) -> list:
        status = next((s for kind, s in STATUS_OF_ERROR.items() if isinstance(error, kind)), "unknown_error")
        return [path, *[None] * len(names), status, str(error)]

    def one(path: str, content: bytes) -> list:
        """A row of one-element arrays; pixels go from the decoder's numpy array to Arrow as they are."""
        try:
            if content is None:
                raise AccessError("no content")
            values = decoder(path, content)
            return [path, *[_arrow_value(values.get(n), kind) for n, kind in zip(names, value_types)], "ok", None]
        except Exception as error:  # the row goes on with its reason
            return failed(path, error)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few files at a time: decoded pixels are far larger than their files.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [one(p, c) for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                columns = [_arrow_column([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(decode, out)


def _arrow_value(value: object, kind: pa.DataType) -> pa.Array | None:
    if value is None:
        return None
    if pa.types.is_map(kind) and isinstance(value, dict):
        value = list(value.items())
    return pa.array([value], type=kind)


def _arrow_column(values: list, kind: pa.DataType) -> pa.Array:
    """One array of plain values, or of one-element arrays and None."""
    if not any(isinstance(v, pa.Array) for v in values):
        return pa.array(values, type=kind)
    return pa.concat_arrays([pa.nulls(1, kind) if v is None else v for v in values])

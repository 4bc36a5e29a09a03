"""Tables written once and read several times within a job."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of this machine is only made where the session is local.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="cohortweave-")
    return _local_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Bounds the bytes of an Arrow batch that goes to Python, for jobs run meanwhile; the session's own bound, if less, stays.

    By rows alone, batches of long texts take hundreds of megabytes of a small executor, in the JVM and in Python.
    """
    before = spark.conf.get(ARROW_BYTES, None)
    if most is None or (before is not None and _bytes(before) <= most):
        yield
        return
    spark.conf.set(ARROW_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before) if before is not None else spark.conf.unset(ARROW_BYTES)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for jobs run meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _bytes(size: str) -> int:
    """``67108864``, ``64m`` and the like in bytes."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else sys.maxsize


def written(df: DataFrame, name: str, compression: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """The same rows, read from a table in the shared folder.

    Row numbers given to a shuffled table are only stable once it is written: a
    lost executor may otherwise bring rows back in another order. ``batch_bytes``
    bounds the Arrow batches of its Python steps.
    """
    path = new_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession, batch_bytes):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job in the shared folder, each removed when nothing reads it any more."""

    def __init__(self, spark: SparkSession, batch_bytes: int | None = None):
        self.spark, self.batch_bytes, self.paths = spark, batch_bytes, {}

    def write(self, name: str, *parts: DataFrame, **options: str) -> DataFrame:
        """The rows of all parts, as ``written`` has them; a part's shuffle files go before the next part begins."""
        path = self.paths[name] = new_path(self.spark, name)
        with arrow_batches(self.spark, self.batch_bytes), setting(self.spark, FREE_SHUFFLES, "true"):
            for part in parts:
                part.write.mode("append").options(**options).parquet(path)
        return self.spark.read.schema(parts[0].schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Deletes these tables. What was made from them must have been written."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

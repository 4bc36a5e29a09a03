"""Parquet tables: sample shards in, patient and sample shards out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortweave.functions.values import bucket_of
from cohortweave.operators.shared import setting

SUFFIX = "*.parquet"
LIST_TASKS = 8  # per core, to list folders


def distinct_series(files: DataFrame, only: Sequence | DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The (study, series) pairs of a table with one row per image file.

    ``only`` keeps some series ids: a short list becomes a pushed-down filter, a
    table becomes a semi join. ``limit`` takes the first pairs in id order.
    """
    # Files are reduced to pairs before the join; a small table is joined earlier still
    # by the optimizer.
    pairs = files.select("study_id", "series_id").distinct()
    if isinstance(only, DataFrame):
        pairs = pairs.join(only.select("series_id"), "series_id", "left_semi").select("study_id", "series_id")
    elif only is not None:
        pairs = pairs.where(F.col("series_id").isin(list(only)))
    return pairs if limit is None else pairs.orderBy("study_id", "series_id").limit(limit)


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of the given files and of the shard files right inside the given folders."""
    return spark.read.option("pathGlobFilter", SUFFIX).parquet(*paths)


def read_split(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """One split of a table partitioned by ``split``; any other mode means test."""
    split = mode if mode in ("train", "val") else "test"
    return spark.read.parquet(root).where(F.col("split") == split)


def split_batch_size(mode: str, train_batch_size: int, eval_batch_size: int) -> int:
    return {"train": train_batch_size, "val": eval_batch_size}.get(mode, 1)


def write_sharded(records: DataFrame, path: str, num_shards: int, *keys: str | Column) -> None:
    """Write ``num_shards`` files. Rows with equal ``keys`` share a file.

    A patient's long lists come in blocks: with the block number among the keys
    a patient with very many series is spread over the files.
    """
    records.repartition(num_shards, *keys).write.mode("overwrite").parquet(path)


def write_fixed_shards(records: DataFrame, path: str, shard: str = "shard_id") -> None:
    """One folder per numbered shard.

    Rows of a shard meet in one task, many small shards share a task, and the planner
    splits a shard that a very large patient has made large.
    """
    records.hint("rebalance", F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def write_batches(
    records: DataFrame, path: str, batch: str = "batch_id", num_shards: int = 1, spread: str | None = None, whole: bool = False
) -> None:
    """Write a folder per batch, of ``num_shards`` files that the ``spread`` column decides on.

    A batch that is run again replaces its own folder only; a ``whole`` cohort
    replaces all that was there, so that no batch of an earlier run stays. Batches are
    spread over all tasks, and the planner splits a file that would be much larger
    than others.
    """
    shard = F.lit(0) if spread is None else bucket_of(F.col(spread), num_shards)
    (
        records.withColumn("_shard", shard)
        .hint("rebalance", F.col(batch), F.col("_shard"))
        .drop("_shard")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(batch)
        .parquet(path)
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches that ``write_batches`` wrote. Folders are listed by ``LIST_TASKS`` tasks per core, not by a task each."""
    tasks = LIST_TASKS * spark.sparkContext.defaultParallelism
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks)):
        return spark.read.parquet(path)


def write_bucketed(records: DataFrame, name: str, path: str, key: str = "patient_id", buckets: int = 64) -> DataFrame:
    """A table in buckets by ``key``, under ``path`` and a name of the catalog; returns it as it is read back.

    Tables with as many buckets of one key are joined and grouped by it without a shuffle, run after run. Rows meet in
    their bucket before they are written, so a bucket is one file.
    """
    spark = records.sparkSession
    dealt = records.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_counted(rows: DataFrame, path: str, by: str, values: Sequence[str], mode: str = "overwrite") -> dict[str, int]:
    """Write rows and count them on the way: all (``""``), and those with each of the ``values`` in column ``by``.

    The counts come with the write, so nothing is read a second time.
    """
    seen = Observation(f"counts of {by}")
    counts = [F.count_if(F.col(by) == v).alias(f"n{i}") for i, v in enumerate(values)]
    rows.observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.mode(mode).parquet(path)
    found = seen.get
    return {"": int(found["n"])} | {v: int(found[f"n{i}"]) for i, v in enumerate(values)}


def shard_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records per shard file, from the file footers alone where possible."""
    return (
        read_shards(spark, [path])
        .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard_file"))
        .groupBy("shard_file")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def write_report(lines: DataFrame, path: str, line: str = "line") -> None:
    """Printable lines as text files."""
    lines.select(line).write.mode("overwrite").text(path)

"""Settings of a cohort build and the session it runs in."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    outcomes_path: str | None = None
    clinical_path: str | None = None
    metadata_path: str | None = None
    studies_root: str = ""
    output_path: str | None = None
    file_pattern: str | None = None  # such as *.dcm
    decode_tasks: int | None = None  # four per core when None
    series_limit: int | None = None  # no limit when None
    batch_size: int = 20  # series per batch
    num_shards: int = 1  # shards of the patient records
    shard_size: int = 8  # valid records per simplified shard
    block_rows: int = 1_000  # entries per block of a long list
    max_voxels: int = 2_097_152  # voxels per volume block


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with runtime re-planning on; ``master`` is for local runs only."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once, unless their path already has it.

    Needed where the library is neither installed on the workers nor on their PYTHONPATH.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    named = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in named or "site-packages" in root or getattr(spark.sparkContext, "_cohortweave_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cohortweave-"), "cohortweave-lib.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    imported_from = list(sys.path)
    spark.sparkContext.addPyFile(path)
    sys.path[:] = imported_from  # the driver keeps its own copy
    spark.sparkContext._cohortweave_shipped = True

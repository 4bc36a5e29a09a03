"""File trees ``root/study/series/file`` as a Spark data source that lists and selects in its tasks.

    slice_tree(spark, root, "*.dcm", series=["1.2.3", "1.2.4"])

The driver lists nothing: it only plans tasks. A task looks at the studies that a checksum of their name
gives it, or, where studies are named, at its share of those. Ids that are named decide before a folder is
listed or a file is opened; without ``content`` no file is opened at all.

Ids are options of the source, not filters pushed by the planner: Spark 4.1 keeps the filters of one query in the
relation, so another query on the same DataFrame would miss rows. A filter on the result is right, but comes late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FIELDS = [("path", pa.string()), ("study_id", pa.string()), ("series_id", pa.string()), ("file_name", pa.string()), ("length", pa.int64())]
_BATCH_BYTES, _BATCH_FILES = 16 << 20, 256


class SliceTreeSource(DataSource):
    """Options: ``root``, ``pattern`` (of file names), ``tasks`` (64), ``content`` (true), ``studies``, ``series`` (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return "slice_tree"

    def schema(self) -> str:
        columns = "path string, study_id string, series_id string, file_name string, length long"
        return columns + (", content binary" if _with_content(self.options) else "")

    def reader(self, schema) -> SliceTreeReader:
        ids = [json.loads(self.options[name]) if name in self.options else None for name in ("studies", "series")]
        tasks = int(self.options.get("tasks", 64))
        return SliceTreeReader(self.options["root"], self.options.get("pattern"), tasks, _with_content(self.options), *ids)


def _with_content(options) -> bool:
    return str(options.get("content", "true")).lower() != "false"


@dataclass
class _Share(InputPartition):
    """Studies named, or those that fall to ``number`` of ``total``."""

    number: int
    total: int
    studies: tuple[str, ...] | None = None

    def __init__(self, number: int, total: int, studies: tuple[str, ...] | None = None):
        self.number, self.total, self.studies = number, total, studies

    def has(self, study: str) -> bool:
        return study in self.studies if self.studies is not None else crc32(study.encode()) % self.total == self.number


@dataclass
class SliceTreeReader(DataSourceReader):
    root: str
    pattern: str | None
    tasks: int
    content: bool
    studies: list[str] | None = None
    series: list[str] | None = None

    def __post_init__(self):
        self._series = None if self.series is None else set(self.series)

    def partitions(self) -> list[InputPartition]:
        if self.studies is None:
            return [_Share(k, self.tasks) for k in range(self.tasks)]
        named = sorted({s for s in self.studies if s})
        total = max(1, min(self.tasks, len(named)))
        return [_Share(k, total, tuple(named[k::total])) for k in range(total)]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        top, named = top.rstrip("/"), self.root.rstrip("/")
        rows: list[tuple] = []
        held = 0
        for study, series, info in self._files(system, top, partition):
            content = self._opened(system, info.path) if self.content else None
            rows.append((f"{named}/{study}/{series}/{info.base_name}", study, series, info.base_name, info.size, content))
            held += len(content or b"")
            if len(rows) >= _BATCH_FILES or held >= _BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, system: fs.FileSystem, top: str, share: _Share) -> Iterator[tuple[str, str, fs.FileInfo]]:
        studies = share.studies if share.studies is not None else [i.base_name for i in _listed(system, top) if i.type == fs.FileType.Directory]
        for study in studies:
            if not share.has(study):
                continue
            for series in _listed(system, f"{top}/{study}"):
                if series.type != fs.FileType.Directory or (self._series is not None and series.base_name not in self._series):
                    continue
                for info in _listed(system, f"{top}/{study}/{series.base_name}"):
                    fits = self.pattern is None or fnmatchcase(info.base_name, self.pattern)
                    if info.type != fs.FileType.Directory and fits:
                        yield study, series.base_name, info

    def _opened(self, system: fs.FileSystem, path: str) -> bytes | None:
        """Contents, or None: the decoding step makes an access error of that."""
        try:
            with system.open_input_stream(path) as stream:
                return stream.read()
        except OSError:
            return None

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        fields = _FIELDS + ([("content", pa.binary())] if self.content else [])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def slice_tree(
    spark: SparkSession,
    root: str,
    pattern: str | None = None,
    tasks: int = 64,
    content: bool = True,
    studies: Sequence[str] | None = None,
    series: Sequence[str] | None = None,
) -> DataFrame:
    """The files of a tree, of the named studies and series if any are named, listed by tasks.

    ``root`` is a path or URI that all tasks reach. Ids are lists of bounded length; against a table of ids join
    the listing without content, then fetch: :func:`cohortweave.sources.files.fetch_and_decode`.
    """
    spark.dataSource.register(SliceTreeSource)
    reader = spark.read.format("slice_tree").options(root=root, tasks=str(tasks), content=str(content).lower())
    for name, value in (("pattern", pattern), ("studies", studies), ("series", series)):
        if value is not None:
            reader = reader.option(name, value if name == "pattern" else json.dumps(list(value)))
    return reader.load()

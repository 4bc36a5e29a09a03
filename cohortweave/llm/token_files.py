"""Token ids in binary files that readers decompress document by document (operator 3).

File format, all numbers little-endian:

* One independent zstandard frame per block of consecutive documents: their ids as unsigned 32-bit
  integers. A block closes at ``BLOCK_TOKENS``; a longer document is split over several frames, so
  that no reader holds more than one frame of bounded size.
* At the end a zstandard skippable frame (magic 0x184D2A5E) with the seek table: per frame its
  compressed size, its decompressed size and the low 32 bits of the xxhash64 of its content; then
  the number of frames (4 bytes), a descriptor byte (0x80: with checksums) and the seekable magic
  0x8F92EAB1. It is the seekable format of zstandard, which every zstandard decoder can read whole.
* Beside each file stand the ids and sizes of its documents, from which the index follows.

Files follow each other in ascending order of document ids. Documents are dealt by range, and each
task cuts its range into files of bounded size. A file is a binary value of a table in the shared
folder, so any store that Spark reaches will do, and only files of committed tasks are in it.

Edge cases: a null text is empty and has the end id only; an empty table gives no file. Rows with
equal ids stay, in an order that follows from their texts; null ids come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm import bpe
from cohortweave.llm.rowmaps import column
from cohortweave.operators.shared import written

END_ID = 2
BLOCK_TOKENS = 1 << 16
FILE_TOKENS = 1 << 22  # a file closes after the block that reaches this
LEVEL = 3

SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80


class SeekableWriter:
    """Builds one file from blocks of ids."""

    def __init__(self) -> None:
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
        frame = self._compressor.compress(raw)
        self.frames.append(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> bytes:
        body = b"".join(struct.pack("<III", *entry) for entry in self.table)
        foot = struct.pack("<IBI", len(self.table), _CHECKSUMS, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(foot)) + body + foot


class SeekableReader:
    """Reads ranges of ids from one file; decompresses only the frames that hold them, and checks each."""

    def __init__(self, file: bytes):
        self._file = memoryview(file)
        count, descriptor, magic = struct.unpack("<IBI", self._file[-9:])
        if magic != SEEKABLE_MAGIC or not descriptor & _CHECKSUMS:
            raise ValueError("no seek table with checksums")
        entries = np.frombuffer(self._file[len(file) - 9 - 12 * count : len(file) - 9], dtype="<u4").reshape(count, 3)
        self._sums = entries[:, 2]
        self._at = np.concatenate([[0], np.cumsum(entries[:, 0].astype(np.int64))])
        self._ids = np.concatenate([[0], np.cumsum(entries[:, 1].astype(np.int64) // 4)])
        self._decompressor = zstandard.ZstdDecompressor()
        self._cached: tuple[int, np.ndarray] | None = None

    def _frame(self, i: int) -> np.ndarray:
        if self._cached is None or self._cached[0] != i:
            raw = self._decompressor.decompress(self._file[self._at[i] : self._at[i + 1]])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._sums[i]:
                raise ValueError(f"checksum of frame {i} differs")
            self._cached = (i, np.frombuffer(raw, dtype="<u4"))
        return self._cached[1]

    def read(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The ids ``first`` to ``first + count``, in pieces of at most one frame."""
        last = first + count
        i = int(np.searchsorted(self._ids, first, side="right")) - 1
        while first < last:
            upto = min(last, int(self._ids[i + 1]))
            yield self._frame(i)[first - int(self._ids[i]) : upto - int(self._ids[i])]
            first, i = upto, i + 1


def write_files(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Token files of all documents, a row each, written to the shared folder.

    ``file_id`` (ascending with the ids), ``file``, ``n_file_tokens``, and the ``keys`` and ``sizes`` of its documents.
    """
    ordered = docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]  # the hash parts an id that many rows share
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "_text").withColumn("_part", F.spark_partition_id())
    key_type = ordered.schema["_key"].dataType.simpleString()
    schema = f"file_id long, file binary, n_file_tokens long, keys array<{key_type}>, sizes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        writer, keys, sizes, pending, waiting = SeekableWriter(), [], [], [], 0
        part = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, writer, keys, sizes
            frame = pd.DataFrame(
                {"file_id": [(part << 32) + number], "file": [writer.finish()], "n_file_tokens": [sum(sizes)], "keys": [keys], "sizes": [sizes]}
            )
            number, writer, keys, sizes = number + 1, SeekableWriter(), [], []
            return pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

        for batch in batches:
            arrow = pa.schema([("file_id", pa.int64()), ("file", pa.binary()), ("n_file_tokens", pa.int64()), ("keys", pa.list_(batch.schema.field(0).type)), ("sizes", pa.list_(pa.int64()))])
            for one, content, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = bpe.encoder(vocabulary).array(content, end)
                keys.append(one)
                sizes.append(len(ids))
                while waiting + len(ids) >= BLOCK_TOKENS:
                    cut = BLOCK_TOKENS - waiting
                    writer.add(np.concatenate([*pending, ids[:cut]]))
                    ids, pending, waiting = ids[cut:], [], 0
                if len(ids):
                    pending.append(ids)
                    waiting += len(ids)
                if sum(s[1] for s in writer.table) >= 4 * FILE_TOKENS:
                    if pending:
                        writer.add(np.concatenate(pending))
                        pending, waiting = [], 0
                    yield closed()
        if pending:
            writer.add(np.concatenate(pending))
        if keys:
            yield closed()

    return written(ordered.mapInArrow(run, schema), "token-files")


def document_index(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each document lies: the key, ``file_id, at`` (first id in the file), ``n_tokens``."""
    docs = files.select("file_id", F.posexplode(F.arrays_zip("keys", "sizes")).alias("_i", "_doc"))
    earlier = Window.partitionBy("file_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)  # bounded by a file
    return docs.select(
        F.col("_doc.keys").alias(key), "file_id", F.coalesce(F.sum("_doc.sizes").over(earlier), F.lit(0)).alias("at"), F.col("_doc.sizes").alias("n_tokens")
    )


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, from the files alone.

    Files do not move: each task reads whole ones, one at a time, document by document.
    """
    key_type = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = SeekableReader(batch.column(1)[i].as_py())
                keys, n = batch.column(2)[i].values, np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                at = np.cumsum(n) - n
                sums = []
                for first, count in zip(at.tolist(), n.tolist()):
                    crc = 0
                    for piece in reader.read(first, count):
                        crc = zlib.crc32(piece.tobytes(), crc)
                    sums.append(crc)
                file_id = pa.array(np.full(len(n), batch.column(0)[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [keys, file_id, pa.array(at), pa.array(n), pa.array(sums, pa.int64())], ["_key", "file_id", "at", "n_tokens", "ids_crc32"]
                )

    schema = f"_key {key_type}, file_id long, at long, n_tokens long, ids_crc32 long"
    found = files.select("file_id", "file", "keys", "sizes").mapInArrow(run, schema)
    # One row per file of millions of ids: a small table, numbered by a running sum.
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file_id", F.coalesce(F.sum("n_file_tokens").over(before), F.lit(0)).alias("_before"))
    return found.join(starts, "file_id").select(F.col("_key").alias(key), (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    files = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return read_documents(files)

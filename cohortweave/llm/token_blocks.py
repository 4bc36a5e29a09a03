"""Texts as blocks of word numbers, each with a dictionary of its words' hashes, and packed arrays.

A block holds whole texts of about ``BLOCK_TOKENS`` words and stands in one row of a table. What is read
several times is tokenized once, and takes two to three bytes a word on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm import wordspans
from cohortweave.llm.rowmaps import column
from cohortweave.operators.shared import Scratch

BLOCK_TOKENS = 1 << 20  # a longer text is a block of its own
_BLOCK_ROWS = 1 << 16

PARTS = ["_sizes", "_codes", "_hashes", "_rows", "_words"]  # columns of a block beside its number and those kept


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, without the high ones that are zero in all, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.empty((width, len(values)), dtype=np.uint8)
    for i in range(width):
        planes[i] = values >> values.dtype.type(8 * i)
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    """The ``n`` numbers that were packed."""
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], n * width, codec="zstd", asbytes=True) if n else b"", np.uint8).reshape(width, n)
    out = planes[0].astype(kind)
    for i in range(1, width):
        out |= planes[i].astype(kind) << kind(8 * i)
    return out


@dataclass
class Encoded:
    """Blocks of a table's texts: ``_block`` (a number), ``PARTS``, and the columns kept, as lists ``_k0, _k1, ...``."""

    blocks: DataFrame
    kept: list[tuple[str, str]]  # names and types

    def union(self, other: Encoded) -> Encoded:
        """The texts of both."""
        parts = [x.blocks.withColumn("_block", F.col("_block") * 2 + i) for i, x in enumerate((self, other))]
        return Encoded(parts[0].unionByName(parts[1]), self.kept)


def encoded(scratch: Scratch, name: str, docs: DataFrame, text: str, keep: list[str]) -> Encoded:
    """The texts of a table, null as an empty one, written as blocks."""
    source = docs.select(column(text).cast("string").alias("_text"), *[column(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kept = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    types = "".join(f", _k{i} array<{kind}>" for i, (_, kind) in enumerate(kept))
    rows = source.mapInArrow(_encode, "_sizes binary, _codes binary, _hashes binary, _rows long, _words long" + types)
    return Encoded(scratch.write(name, rows.withColumn("_block", F.monotonically_increasing_id()), compression="uncompressed"), kept)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]] = []
    rows = tokens = 0
    for batch in batches:
        for at, chunk in wordspans.chunks(wordspans.of_array(batch.column(0))):
            for low in range(0, len(chunk), _BLOCK_ROWS):
                bounds = chunk.bounds[low : low + _BLOCK_ROWS + 1]
                part = wordspans.Texts(chunk.data[bounds[0] : bounds[-1]], bounds - bounds[0])
                found = wordspans.words(part.lowered())
                if held and (tokens + len(found.hashes) > BLOCK_TOKENS or rows + len(part) > _BLOCK_ROWS):
                    yield _block(held)
                    held, rows, tokens = [], 0, 0
                held.append((found.hashes, found.counts(), [c.slice(at + low, len(part)) for c in batch.columns[1:]]))
                rows, tokens = rows + len(part), tokens + len(found.hashes)
    if held:
        yield _block(held)


def _block(held: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]]) -> pa.RecordBatch:
    hashes, sizes = (np.concatenate(x) for x in list(zip(*held))[:2])
    named = pa.array(hashes).dictionary_encode()
    data = [packed(sizes), packed(named.indices.to_numpy(zero_copy_only=False)), named.dictionary.to_numpy(zero_copy_only=False).tobytes()]
    arrays = [*[pa.array([x], pa.binary()) for x in data], pa.array([len(sizes)], pa.int64()), pa.array([len(hashes)], pa.int64())]
    for own in zip(*(x[2] for x in held)):
        values = pa.concat_arrays(list(own))
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(arrays, PARTS + [f"_k{i}" for i in range(len(arrays) - len(PARTS))])


@dataclass
class Block:
    """Texts of a block, each led by a start and closed by an end."""

    words: np.ndarray  # hashes of the different words, with the end and the start after them
    ids: np.ndarray  # of all tokens: places in ``words``
    bounds: np.ndarray  # of the texts among the tokens

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The texts of these tokens."""
        return np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))[at]


def decoded(batch: pa.RecordBatch, start: np.uint64, end: np.uint64) -> Iterator[tuple[int, Block]]:
    """The blocks of a batch, whose first columns are ``PARTS``, each with its place in the batch."""
    for i in range(batch.num_rows):
        sizes, codes, hashes, rows, n_words = (batch.column(c)[i].as_py() for c in range(len(PARTS)))
        words = np.append(np.frombuffer(hashes, np.uint64), [end, start])
        bounds = np.concatenate([[0], np.cumsum(unpacked(sizes, rows) + 2)])
        ids, inside = np.empty(bounds[-1], dtype=np.int32), np.ones(bounds[-1], dtype=bool)
        ids[bounds[:-1]], ids[bounds[1:] - 1] = len(words) - 1, len(words) - 2
        inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
        ids[inside] = unpacked(codes, n_words, np.int32)
        yield i, Block(words, ids, bounds)


def ordered(keys: np.ndarray) -> np.ndarray:
    """An order that sorts hashes: numbers of which the high bits are the hash and the low ones the place sort faster than places."""
    bits = np.uint64(len(keys).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = keys.min() if len(keys) else np.uint64(0)
    up = np.uint64(64 - int(keys.max() - least).bit_length()) if len(keys) else np.uint64(0)  # hashes of one part are near each other
    high = (keys - least) << min(up, np.uint64(63))
    at = (np.sort((high & ~mask) | np.arange(len(keys), dtype=np.uint64)) & mask).astype(np.int64)
    found = keys[at]
    return at if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")

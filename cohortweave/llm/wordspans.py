"""Words, lines and their hashes for whole Arrow batches of texts, without a loop over words.

A text is a run of UTF-8 bytes. Words end at ASCII white space (x09-x0D, x20), which never
occurs inside a longer UTF-8 sequence, so bytes are enough. Words and lines are numbered exactly,
and each different one is hashed as a whole (``span_hashes``). ``RunHashes`` is cheaper, but texts can be
made that it takes for equal: it only serves where a later step looks at the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20  # texts are handled in pieces of this size; a longer text is a piece of its own

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if size > 4 * CHUNK_BYTES:  # of one very long text; not kept
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


class RunHashes:
    """Hashes of runs of bytes from prefix sums of a polynomial over 2**64. Equal runs have equal ones; not the reverse."""

    def __init__(self, values: np.ndarray):
        """``values``: one 64-bit value per element, such as ``byte_values`` gives."""
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


@dataclass
class Texts:
    """Texts of some rows, one after another: ``data`` their bytes, ``bounds`` their n + 1 borders."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> str:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes().decode("utf-8")

    def lowered(self) -> Texts:
        """A-Z in lower case."""
        return Texts(_LOWER[self.data], self.bounds)


def of_array(texts: pa.Array) -> Texts:
    """All texts of an Arrow array; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(body[bounds[0] : bounds[-1]], bounds - bounds[0])


def chunks(texts: Texts, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """Consecutive texts of about ``size`` bytes together, each with the number of its first."""
    at, n = 0, len(texts)
    while at < n:
        upto = int(np.searchsorted(texts.bounds, texts.bounds[at] + size, side="right")) - 1
        upto = min(max(upto, at + 1), n)
        low, high = texts.bounds[at], texts.bounds[upto]
        yield at, Texts(texts.data[low:high], texts.bounds[at : upto + 1] - low)
        at = upto


@dataclass
class Words:
    """Words of some texts: byte borders, hashes, and the number of words before each text."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    before: np.ndarray  # n + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.before) - 1), self.counts())


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values that don't cross a border."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.zeros(n + 1, dtype=bool)  # a text begins here
    fresh[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """Spans of ``data``, which are in order and don't overlap, as one dictionary."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end] -= 1
    body = pa.py_buffer(np.ascontiguousarray(data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), body]).dictionary_encode()


def exact_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per span of ``data``, in their order; equal spans, and only they, have equal numbers."""
    return _named(data, start, end).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, worked out once for each different span."""
    named = _named(data, start, end)
    body, offsets = memoryview(named.dictionary.buffers()[2] or b""), np.frombuffer(named.dictionary.buffers()[1], np.int64)
    low = offsets[named.dictionary.offset : named.dictionary.offset + len(named.dictionary) + 1].tolist()
    hashed = np.array([xxhash.xxh3_64_intdigest(body[a:b], _SEED) for a, b in zip(low[:-1], low[1:])], dtype=np.uint64)
    return hashed[named.indices.to_numpy(zero_copy_only=False)] if len(start) else np.empty(0, np.uint64)


_SEED = 0x51ED270B


def words(texts: Texts) -> Words:
    start, end = spans(~_SPACE[texts.data], texts.bounds)
    return Words(start, end, span_hashes(texts.data, start, end), np.searchsorted(start, texts.bounds))


_STEP = np.uint64(0xA24BAED4963EE407)


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the word each begins with."""
    n = len(found.hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined = found.hashes[:n].copy()
    for k in range(1, size):
        joined *= _STEP
        joined ^= joined >> np.uint64(29)
        joined += found.hashes[k : n + k]
    owner = found.owner()
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(joined[first]), first


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of words."""
    value = len(hashes)
    for h in hashes.tolist():
        value = ((value * 0x9FB21C651E98DF25) ^ (value >> 29)) + h & _MASK
    return int(mix(np.array([value], dtype=np.uint64))[0])


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]

"""Periodic runs of words: stretches that repeat a passage of q words at least four times over.

Method: maximal pairs from the tree of LCP intervals. Words are numbered exactly. Positions whose next
five words occur once in their text are in no pair that matters (a run of at least six words over four
periods is a pair with five or more equal words) and take no part; the others, with the five positions after each,
are ranked by prefix doubling, which gives a suffix array of them and the common prefix of neighbours. The
intervals are then walked bottom-up. A node holds its positions as class lists, one sorted list per word to
the left, and the smaller side of a union asks the larger one for partners, so that a position moves a
logarithmic number of times.

A pair of equal stretches of ``l`` words at distance ``d`` that grows neither to the left (other class) nor to
the right (other child) is a run of ``l + d`` words with period ``d``, no further growth needed; it counts if
``l + d >= max(6, 4 d)``, so only partners within ``l / 3`` are asked for. There all occurrences but the
first one are led by the same word, the last of the period: one look at the first position in reach and one
at the nearest partner to the right tell all classes in reach, so no class is walked in vain. The pair of
least distance of a stretch is its run; the others are multiples of the period.

Every text is done by itself, whole, in linear space and about ``n log n`` steps, so a job is one pass without
a shuffle. Null, empty and white texts have no words and no runs. Repeated rows give repeated results; an
empty table gives an empty one. A text without an id is taken as it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import wordspans as ws
from cohortweave.llm.rowmaps import column, read_table

MIN_LENGTH = 6  # words of a run
MIN_PERIODS = 4  # periods of a run
_SEED = MIN_LENGTH - 1  # equal words that any pair has at least
_FIRST = 8  # words compared at once before ranks are doubled


def runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of numbers, by start, then period.

    A run has at least ``min_length`` elements and ``min_periods`` (two or more) times its smallest period.
    """
    seed = max(1, min(min_length - 1, (min_length * (min_periods - 1) + min_periods - 1) // min_periods))
    found: dict[tuple[int, int], int] = {}
    for order, common in _repeats(np.asarray(codes, dtype=np.int64), seed):
        for start, length, distance in _pairs(order, common, codes, min_length, min_periods - 1):
            known = found.get((start, length))
            if known is None or distance < known:
                found[start, length] = distance
    return sorted(((s, n, d) for (s, n), d in found.items()), key=lambda r: (r[0], r[2]))


def _repeats(codes: np.ndarray, seed: int) -> Iterator[tuple[list[int], list[int]]]:
    """Groups of suffixes that share ``seed`` elements: their order, and the common prefix with the one before."""
    n = len(codes)
    if n <= seed:
        return
    ends = np.concatenate([codes, -1 - np.arange(_FIRST)])  # nothing matches beyond the end
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(seed):
        gram = ws.mix(gram + ends[k : k + n].astype(np.uint64))
    at = np.argsort(gram, kind="stable")
    same = gram[at[1:]] == gram[at[:-1]]
    often = np.zeros(n + seed, dtype=bool)
    often[at[1:][same]] = True
    often[at[:-1][same]] = True
    if not often.any():
        return
    reach = often.copy()
    for k in range(1, seed + 1):
        reach[k:] |= often[:-k]
    places = np.flatnonzero(reach[:n])
    index = np.full(n + 1, -1)
    index[places] = np.arange(len(places))

    first = np.stack([ends[np.minimum(places + k, n + _FIRST - 1)] for k in range(_FIRST)])
    past = places[None, :] + np.arange(_FIRST)[:, None] >= n
    first = np.where(past, -1 - places[None, :], first)
    order = np.lexsort(first[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (first[:, order[1:]] != first[:, order[:-1]]).any(axis=0)
    levels, h = [], _FIRST
    while True:
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        levels.append((h, rank))
        tied = np.zeros(len(order), dtype=bool)
        tied[:-1] |= ~fresh[1:]
        tied |= ~fresh
        if not tied.any():
            break
        slots = np.flatnonzero(tied)
        who = order[slots]
        target = places[who] + h
        after = index[np.minimum(target, n)]
        second = np.where(after >= 0, rank[after], -1 - places[who])
        again = np.lexsort((second, rank[who]))
        order[slots] = who[again]
        a, b = rank[who[again]], second[again]
        fresh[slots[1:]] |= (slots[1:] == slots[:-1] + 1) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        h *= 2

    left, right = places[order[:-1]].copy(), places[order[1:]].copy()
    common = np.zeros(len(left), dtype=np.int64)
    for h, rank in reversed(levels):
        i, j = index[np.minimum(left, n)], index[np.minimum(right, n)]
        equal = (i >= 0) & (j >= 0)
        equal[equal] = rank[i[equal]] == rank[j[equal]]
        step = np.where(equal, h, 0)
        common, left, right = common + step, left + step, right + step
    live = np.ones(len(left), dtype=bool)
    for _ in range(_FIRST - 1):
        live &= (left < n) & (right < n)
        live[live] = codes[left[live]] == codes[right[live]]
        common, left, right = common + live, left + live, right + live
    ordered = places[order].tolist()
    low = np.flatnonzero(np.concatenate([[True], common < seed, [True]]))
    common = common.tolist()
    for a, b in zip(low[:-1].tolist(), low[1:].tolist()):
        if b - a > 1:
            yield ordered[a:b], common[a : b - 1]


class _Node:
    """Positions below a node: all, sorted, and the same as one sorted list per word to the left."""

    __slots__ = ("all", "classes")

    def __init__(self, position: int, left: int):
        self.all = [position]
        self.classes = {left: [position]}

    def add(self, position: int, left: int) -> None:
        insort(self.all, position)
        mine = self.classes.get(left)
        if mine is None:
            self.classes[left] = [position]
        else:
            insort(mine, position)


def _pairs(
    order: list[int], common: list[int], codes: np.ndarray, min_length: int, ratio: int
) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs of one group that are runs or multiples of runs, as ``(start, length, distance)``."""

    def left(p: int) -> int:
        return int(codes[p - 1]) if p else -1

    def united(one: _Node, other: _Node, length: int) -> Iterator[tuple[int, int, int]]:
        large, small = (one, other) if len(one.all) >= len(other.all) else (other, one)
        reach, least = length // ratio, min_length - length
        for x in small.all:
            mine = left(x)
            at = bisect_left(large.all, x)
            if at:
                y = large.all[bisect_left(large.all, x - reach)] if large.all[at - 1] >= x - reach else None
                if y is not None and left(y) != mine and x - y >= least:
                    yield y, length + x - y, x - y
            if at < len(large.all) and large.all[at] <= x + reach:
                theirs = left(large.all[at])
                if theirs != mine:
                    listed = large.classes[theirs]
                    for z in listed[bisect_left(listed, x) : bisect_right(listed, x + reach)]:
                        if z - x >= least:
                            yield x, length + z - x, z - x

    def joined(one: _Node, other: _Node) -> _Node:
        large, small = (one, other) if len(one.all) >= len(other.all) else (other, one)
        for x in small.all:
            large.add(x, left(x))
        return large

    stack: list[list] = []  # common prefix, node
    for k, p in enumerate(order):
        node = _Node(p, left(p))
        length = common[k] if k < len(common) else -1
        while stack and stack[-1][0] > length:
            above, waiting = stack.pop()
            yield from united(waiting, node, above)
            node = joined(waiting, node)
        if stack and stack[-1][0] == length:
            yield from united(stack[-1][1], node, length)
            stack[-1][1] = joined(stack[-1][1], node)
        else:
            stack.append([length, node])


# --- texts -----------------------------------------------------------------------


@dataclass
class _Text:
    """Words of one text as spans of its bytes, numbered exactly."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray

    def rearranged(self, index: np.ndarray) -> _Text:
        return _Text(self.data, self.start[index], self.end[index], self.codes[index])

    def joined(self, kept: np.ndarray | None = None) -> bytes:
        data = self.data.tobytes()
        start, end = (self.start, self.end) if kept is None else (self.start[kept], self.end[kept])
        return b" ".join([data[a:b] for a, b in zip(start.tolist(), end.tolist())])


def word_codes(texts: ws.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of all words and an exact number per word."""
    start, end = ws.spans(~ws._SPACE[texts.data], texts.bounds)
    return start, end, ws.exact_numbers(texts.data, start, end)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the index that turns the end of a text of ``n`` words into repeats of one passage."""
    if doc_id is None or n == 0:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def _longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; ties by start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_FIELDS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", repeat_some: bool = False) -> DataFrame:
    """Runs per row of ``docs``: their number, the strongest, all of them, and digests of runs and collapsed text.

    ``collapsed`` is the text without the words that a run repeats: every word of a run after its first
    period. ``repeat_some`` first plants repeats in one id of ten, see ``planted``.
    """
    source = docs.select(column(key).cast("long").alias("_key"), column(text).cast("string").alias("_text"))
    schema = "_key long, " + _FIELDS
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def one(doc_id: int | None, words: _Text) -> tuple:
        index = planted(doc_id, len(words.codes)) if repeat_some else None
        if index is not None:
            words = words.rearranged(index)
        found = runs(words.codes)
        best = _longest(found)
        kept = None
        if found:
            kept = np.ones(len(words.codes), dtype=bool)
            for s, length, period in found:
                kept[s + period : s + length] = False
        listed = "".join(f"{s},{length},{period}\n" for s, length, period in found)
        strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = (sha256(listed.encode()).hexdigest(), sha256(words.joined(kept)).hexdigest())
        return (doc_id, len(words.codes), len(found), *strongest, *digests, [dict(zip(("start", "length", "period"), r)) for r in found])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [run_type]
        names = ["_key", *[f.split(" ")[0] for f in _FIELDS.split(", ")]]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for at, chunk in ws.chunks(ws.of_array(batch.column(1))):
                start, end, codes = word_codes(chunk)
                cut = np.searchsorted(start, chunk.bounds)
                for i in range(len(chunk)):
                    a, b, low, high = cut[i], cut[i + 1], chunk.bounds[i], chunk.bounds[i + 1]
                    rows.append(one(ids[at + i], _Text(chunk.data[low:high], start[a:b] - low, end[a:b] - low, codes[a:b])))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return source.mapInArrow(work, schema).withColumnRenamed("_key", key)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one id in ten with planted repeats."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), repeat_some=True)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    return found.select(*[F.col(c) for c in columns])

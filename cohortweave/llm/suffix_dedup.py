"""Passages that stand in an earlier document already, byte by byte, by suffix arrays of shards.

A byte of a document goes if a string of ``size`` bytes that covers it also starts in a document of a lesser id.

1. Documents are dealt into blocks by a hash of their id: the one shuffle of whole texts, used three times.
2. Every string of ``size`` bytes is filed under the least hash of its grams of ``GRAM`` bytes; equal strings have equal
   ones. Strings that follow one another share theirs, about fourteen at a time. A block sends its distinct ones,
   sorted and cut to the bits that matter, to ranges of hashes, and hears which of them another document has as
   well, and which are very common.
3. Stretches of strings whose hash is shared travel, each different one once per block, to the shard of that hash; those
   of a very common hash travel string by string under a hash of their whole, so no gram makes a shard large.
4. A shard joins its stretches, sorts their suffixes by induced sorting (``induced_sorting``) and takes permuted common
   prefixes: neighbours that share ``size`` bytes are one group, whose least document keeps its bytes.
5. Spans go back to the blocks and are cut out of the texts.

Hashes only decide where bytes meet: what is removed is decided on bytes. Null texts are empty; texts shorter than
``size`` are kept; rows that share an id remove nothing of each other; rows without an id are kept whole and
remove nothing; an empty table gives an empty one. A very long text is worked on in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import wordspans as ws
from cohortweave.llm.induced_sorting import permuted_common_prefixes, suffix_array
from cohortweave.llm.rowmaps import column, read_table

SIZE = 50  # bytes of a string
GRAM = 24
BLOCK_BYTES = 4 << 20
PIECE = 1 << 15  # strings looked at at once
COMMON = 4_000  # stretches of one hash above which its strings travel one by one
_SEPARATOR = 0xFF  # in no UTF-8 text

_VALUES = ws.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _least_grams(data: np.ndarray, size: int) -> np.ndarray:
    """For each string of ``size`` bytes the least hash of its grams."""
    h = _VALUES[data]
    for k, step in zip((1, 2, 4, 8), _STEPS):
        h = h[:-k] * step + h[k:]
    h = ws.mix(h[:-8] * _STEPS[4] + (h[8:] ^ (h[8:] >> np.uint64(31))))  # 24 bytes
    left, wide = size - GRAM + 1, 1
    while 2 * wide <= left:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[: len(h) - (left - wide)], h[left - wide :]) if left > wide else h


@dataclass
class _Stretches:
    """Runs of strings with one least gram: hash, row, first byte (of the block), number of strings."""

    key: np.ndarray
    row: np.ndarray
    start: np.ndarray
    strings: np.ndarray


def _stretches(texts: ws.Texts, size: int) -> _Stretches:
    parts = []
    n = len(texts.data)
    for low in range(0, max(n - size + 1, 0), PIECE):
        least = _least_grams(texts.data[low : low + PIECE + size - 1], size)
        at = low + np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        first = texts.bounds[np.searchsorted(texts.bounds, low, side="left") : np.searchsorted(texts.bounds, low + len(least), side="left")]
        at = np.union1d(at, first)  # a text begins a stretch
        row = np.searchsorted(texts.bounds, at, side="right") - 1
        until = np.append(at[1:], low + len(least))
        until = np.minimum(until, texts.bounds[row + 1] - size + 1)  # strings end in their text
        fits = until > at
        # Least hashes are small ones; mixed, they fill all ranges alike.
        parts.append((ws.mix(least[at[fits] - low]), row[fits], at[fits], (until - at)[fits]))
    if not parts:
        return _Stretches(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return _Stretches(*[np.concatenate(c) for c in zip(*parts)])


def _with_ids(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, ws.Texts, np.ndarray]:
    """Ids, texts and row numbers of the rows that have an id."""
    rows = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
    taken = pa.array(rows)
    return ids.take(taken).to_numpy(zero_copy_only=False).astype(np.int64), ws.of_array(texts.take(taken)), rows


def _places(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Numbers of a block's rows by id and text; they don't depend on the order the rows come in."""
    order = np.lexsort((marks, ids))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[order[1:]] != ids[order[:-1]]) | (marks[order[1:]] != marks[order[:-1]])
    places = np.empty(len(ids), dtype=np.int32)
    places[order] = np.cumsum(fresh) - 1
    return places


def _joined(array: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        return pa.concat_arrays([c.cast(pa.large_string()) if pa.types.is_string(c.type) else c for c in array.chunks]) if array.num_chunks else pa.array([], array.type)
    return array


def _block_keys(ids: np.ndarray, found: _Stretches, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a block cut to ``bits``, whether several documents have each, and how many stretches."""
    key = found.key >> np.uint64(64 - bits)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], ids[found.row[order]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if not len(key):
        return key, np.empty(0, bool), first
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    return key[first], several, np.diff(np.append(first, len(key)))


def _by_range(key: np.ndarray, bits: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges a block's sorted hashes fall into, and the borders between them."""
    part = (key >> np.uint64(bits - range_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return part[first], np.append(first, len(part))


def _among(values: np.ndarray, sorted_ones: np.ndarray) -> np.ndarray:
    if not len(sorted_ones):
        return np.zeros(len(values), dtype=bool)
    return sorted_ones[np.minimum(np.searchsorted(sorted_ones, values), len(sorted_ones) - 1)] == values


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(**kinds: str) -> tuple[str, pa.Schema]:
    arrow = {"long": pa.int64(), "binary": pa.binary()}
    return ", ".join(f"{n} {k}" for n, k in kinds.items()), pa.schema([(n, arrow[k]) for n, k in kinds.items()])


_SENT, _SENT_ARROW = _schema(part="long", block="long", keys="binary", several="binary", often="binary")
_HEARD, _HEARD_ARROW = _schema(part="long", block="long", shared="binary", common="binary")
_PIECES, _PIECES_ARROW = _schema(shard="long", block="long", text="binary", lengths="binary", string="binary", doc="binary", place="binary", start="binary")
_SPANS, _SPANS_ARROW = _schema(block="long", place="binary", start="binary", end="binary")


def repeated_spans(docs: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """``key, n_bytes, kept (binary), spans`` per row of ``docs``: the bytes that stay, and the runs that go."""
    if size < GRAM:
        raise ValueError(f"size is {GRAM} or more")
    total = docs.agg(F.sum(F.octet_length(column(text).cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    range_bits = max(1, (blocks - 1).bit_length() - 2)  # a range hears about four blocks' share
    bits = min(64, range_bits + 32)
    shards = 4 * blocks

    named = docs.select(column(key).cast("long").alias("doc"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    dealt = F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")
    placed = named.select(dealt, "doc", F.xxhash64("text").alias("mark"), "text").repartition(blocks, "block")

    def send(table: pa.Table) -> pa.Table:
        rows = []
        if len(table):
            ids, texts, _ = _with_ids(_joined(table["doc"]), _joined(table["text"]))
            keys, several, often = _block_keys(ids, _stretches(texts, size), bits)
            parts, border = _by_range(keys, bits, range_bits)
            block = table["block"][0].as_py()
            short = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            many = np.minimum(often, 255).astype(np.uint8)
            for p, a, b in zip(parts.tolist(), border[:-1].tolist(), border[1:].tolist()):
                rows.append((p, block, _bytes(short[a:b]), _bytes(np.packbits(several[a:b])), _bytes(many[a:b])))
        return pa.Table.from_batches([_batch(_SENT_ARROW, rows)])

    def hear(table: pa.Table) -> pa.Table:
        part, block = table["part"].to_pylist(), table["block"].to_pylist()
        keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for s, k in zip(table["several"].to_pylist(), keys)]
        often = np.concatenate([np.frombuffer(o, np.uint8) for o in table["often"].to_pylist()]).astype(np.int64)
        joined = np.concatenate(keys)
        order = np.argsort(joined, kind="stable")
        ranked = joined[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        holders = np.diff(np.append(first, len(ranked)))
        shared = np.logical_or.reduceat(np.concatenate(several)[order], first) | (holders > 1)
        frequent = np.add.reduceat(often[order], first) > common
        back = np.zeros((2, len(joined)), dtype=bool)
        back[0, order], back[1, order] = np.repeat(shared, holders), np.repeat(shared & frequent, holders)
        border = np.cumsum([0, *map(len, keys)])
        rows = [(p, b, *[_bytes(k[f[x:y]]) for f in back]) for p, b, k, x, y in zip(part, block, keys, border[:-1], border[1:])]
        return pa.Table.from_batches([_batch(_HEARD_ARROW, rows)])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return pa.Table.from_batches([_batch(_PIECES_ARROW, [])])
        ids, texts, rows = _with_ids(_joined(table["doc"]), _joined(table["text"]))
        places = _places(ids, table["mark"].to_numpy()[rows])
        found = _stretches(texts, size)
        parts = answers["part"].to_pylist()
        shared, frequent = (
            np.sort(np.concatenate([np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(p << 32) for p, x in zip(parts, answers[c].to_pylist())]))
            for c in ("shared", "common")
        )
        travels = _among(found.key >> np.uint64(64 - bits), shared)
        found = _Stretches(*[c[travels] for c in (found.key, found.row, found.start, found.strings)])
        found = _split_common(texts, found, _among(found.key >> np.uint64(64 - bits), frequent), size)
        block = table["block"][0].as_py()
        return pa.Table.from_batches([_batch(_PIECES_ARROW, list(_packed(texts, found, ids, places, block, shards, size)))])

    def judge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(_SPANS_ARROW, list(_shard_spans(table, size)))])

    def remove(table: pa.Table, spans: pa.Table) -> pa.Table:
        return _without(table, spans)

    sent = placed.groupBy("block").applyInArrow(send, _SENT)
    heard = sent.groupBy("part").applyInArrow(hear, _HEARD)
    pieces = placed.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(cut, _PIECES)
    spans = pieces.groupBy("shard").applyInArrow(judge, _SPANS)
    kept = placed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, _KEPT)
    return kept.withColumnRenamed("doc", key)


def _split_common(texts: ws.Texts, found: _Stretches, common: np.ndarray, size: int) -> _Stretches:
    """Stretches of very common hashes give way to their single strings, under a hash of each."""
    if not common.any():
        return found
    stay, go = np.flatnonzero(~common), np.flatnonzero(common)
    n = found.strings[go]
    start = np.repeat(found.start[go] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    whole = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        whole = (whole ^ _VALUES[texts.data[start + k]]) * _STEPS[k % 5]
        whole ^= whole >> np.uint64(29)
    ones = np.ones(len(start), dtype=np.int64)
    made = (ws.mix(whole), np.repeat(found.row[go], n), start, ones)
    old = (found.key, found.row, found.start, found.strings)
    return _Stretches(*[np.concatenate([a[stay], b]) for a, b in zip(old, made)])


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans, one after another, and their borders."""
    border = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=border[1:])
    return data[np.repeat(start - border[:-1], length) + np.arange(border[-1])], border


def _numbered(body: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per byte string (equal ones agree), and where each number first stands."""
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(border) - 1, [None, pa.py_buffer(border), pa.py_buffer(body)]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.full(len(coded.dictionary), len(number), dtype=np.int64)
    np.minimum.at(first, number, np.arange(len(number)))
    return number, first


def _packed(texts: ws.Texts, found: _Stretches, ids: np.ndarray, places: np.ndarray, block: int, shards: int, size: int) -> Iterator[tuple]:
    """A row per shard: its different stretches, and where in which document each stands."""
    squeeze = zstandard.ZstdCompressor(level=3)
    shard = (ws.mix(found.key) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        mine = order[a:b]
        start = found.start[mine]
        body, border = _gathered(texts.data, start, found.strings[mine] + size - 1)
        number, first = _numbered(body, border)
        body, border = _gathered(body, border[first], (border[1:] - border[:-1])[first])
        row = found.row[mine]
        yield (
            int(shard[mine[0]]), block, squeeze.compress(_bytes(body)), _bytes(np.diff(border).astype(np.int32)), _bytes(number.astype(np.int32)),
            _bytes(ids[row]), _bytes(places[row]), _bytes((start - texts.bounds[row]).astype(np.int32)),
        )


def _shard_spans(table: pa.Table, size: int) -> Iterator[tuple]:
    """Spans of the stretches of one shard that a document of a lesser id has as well, per block and document."""
    raw = {c: table[c].to_pylist() for c in table.column_names}
    arrays = lambda c, kind: [np.frombuffer(x, kind) for x in raw[c]]
    unsqueeze = zstandard.ZstdDecompressor()
    raw["text"] = [unsqueeze.decompress(x) for x in raw["text"]]
    lengths = arrays("lengths", np.int32)
    counts = [len(x) for x in lengths]
    before = np.cumsum([0, *counts])
    length = np.concatenate(lengths).astype(np.int64)
    border = np.concatenate([[0], np.cumsum(length)])
    number, first = _numbered(np.frombuffer(b"".join(raw["text"]), np.uint8), border)
    string = number[np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + b for x, b in zip(raw["string"], before[:-1])])]
    doc = np.concatenate(arrays("doc", np.int64))
    place, start = (np.concatenate(arrays(c, np.int32)).astype(np.int64) for c in ("place", "start"))
    block = np.repeat(raw["block"], [len(x) // 4 for x in raw["string"]])

    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc)
    flat = np.frombuffer(b"".join(raw["text"]), np.uint8)
    size_of = length[first]
    body, edges = _gathered(flat, border[first], size_of)
    taken = np.repeat(np.arange(len(first)), size_of)
    data = np.full(len(body) + len(first), _SEPARATOR, dtype=np.uint8)
    data[np.arange(len(body)) + taken] = body
    ends = edges[1:] + np.arange(len(first))
    end_of = np.repeat(ends, size_of + 1)
    owner = np.repeat(np.arange(len(first)), size_of + 1)

    sa = suffix_array(data, 256)
    shared = permuted_common_prefixes(data, sa, end_of)
    fits = end_of[sa] - sa >= size
    group_start = ~(shared[sa] >= size)
    ranked = sa[fits]
    opens = np.flatnonzero(group_start[fits] | np.concatenate([[True], np.diff(np.flatnonzero(fits)) > 1]))
    earliest = np.minimum.reduceat(least[owner[ranked]], opens) if len(ranked) else ranked
    first_doc = np.full(len(data), np.iinfo(np.int64).max)
    first_doc[ranked] = np.repeat(earliest, np.diff(np.append(opens, len(ranked))))
    gone = first_doc < least[owner]

    # stretches of a string by their documents: above the least one they go as a whole
    whole = doc > least[string]
    gone_at = np.flatnonzero(gone)
    runs = np.flatnonzero(np.concatenate([[True], (np.diff(gone_at) > 1) | (np.diff(owner[gone_at]) > 0)])) if len(gone_at) else gone_at
    run_low = gone_at[runs]
    run_high = gone_at[np.append(runs[1:], len(gone_at)) - 1] + size if len(runs) else run_low
    run_owner = owner[run_low]
    base = ends - size_of
    order = np.argsort(string, kind="stable")
    part = order[~whole[order]]
    low, high = np.searchsorted(run_owner, string[part]), np.searchsorted(run_owner, string[part], side="right")
    n = high - low
    which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    who = np.repeat(part, n)
    found_at = np.concatenate([start[whole], start[who] + run_low[which] - base[string[who]]])
    found_end = np.concatenate([start[whole] + size_of[string[whole]], start[who] + run_high[which] - base[string[who]]])
    rows = np.concatenate([np.flatnonzero(whole), who])
    if not len(rows):
        return
    b, p = block[rows], place[rows]
    order = np.lexsort((found_at, p, b))
    b, p, found_at, found_end = (x[order].astype(np.int32) for x in (b, p, found_at, found_end))
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
        yield int(b[x]), _bytes(p[x:y]), _bytes(found_at[x:y]), _bytes(found_end[x:y])


_KEPT = "doc long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def _without(table: pa.Table, spans: pa.Table) -> pa.Table:
    """The rows of a block without their spans."""
    places = np.full(len(table), -1, dtype=np.int64)
    named = np.flatnonzero(_joined(table["doc"]).is_valid().to_numpy(zero_copy_only=False))
    ids = table["doc"].take(pa.array(named)).to_numpy().astype(np.int64)
    places[named] = _places(ids, table["mark"].to_numpy()[named])
    of, low, high = (np.concatenate([np.frombuffer(x, np.int32) for x in spans[c].to_pylist()] or [np.empty(0, np.int32)]) for c in ("place", "start", "end"))
    order = np.lexsort((low, of))
    of, low, high = of[order], low[order], high[order]
    bound = np.searchsorted(of, np.arange(places.max(initial=-1) + 2))
    rows = []
    for d, at, text in zip(table["doc"].to_pylist(), places.tolist(), table["text"].to_pylist()):
        data = text.encode()
        cut: list[tuple[int, int]] = []
        if at >= 0 and bound[at] < bound[at + 1]:
            starts, ends = low[bound[at] : bound[at + 1]], np.maximum.accumulate(high[bound[at] : bound[at + 1]])
            opens = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
            cut = list(zip(starts[opens].tolist(), ends[np.append(opens[1:], len(starts)) - 1].tolist()))
        stays = [0, *[x for c in cut for x in c], len(data)]
        kept = b"".join([data[a:b] for a, b in zip(stays[::2], stays[1::2])])
        rows.append((d, len(data), kept, [{"start": a, "end": b} for a, b in cut]))
    kinds = [pa.int64(), pa.int64(), pa.large_binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
    arrays[2] = arrays[2].cast(pa.binary()) if arrays[2].nbytes < 1 << 31 else arrays[2]
    return pa.Table.from_arrays(arrays, ["doc", "n_bytes", "kept", "spans"])


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that no document of a lesser id has in a string of 50."""
    made = repeated_spans(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""Phrases of two and three words that belong together, by dynamic itemset counting.

Method: the rows are dealt into ``shards`` by a hash of their id, and the shards are scanned in a cycle. Words
are counted from the first scan on. As soon as the counts so far say that a word occurs ``min_count`` times,
phrases of two such words are activated: they are counted from the next scan on, beside the words, and for one
full cycle. Phrases of three words are activated once both their pairs reach the threshold, again for one full
cycle. So lengths are counted interleaved, a phrase is complete after ``shards`` scans, and after three cycles
at most all are. A phrase with ``min_count`` occurrences has parts with as many, so it is activated in time,
and each of its occurrences is counted once.

Which scan activates a phrase is known in the tasks from two arrays of ``2 ** SLOT_BITS`` bytes, whose size does
not grow with the data: the first scan for which a word, or a pair, of that hash is ready. Several keys of one
slot share the earliest scan; what is then counted in excess still is counted for one full cycle, so counts
stay exact, only work is added. Counts are summed before they leave a task, and travel as rows of packed arrays: a key
has a slice, from its upper half, and its lower 32 bits there, so a hot word, phrase or language costs a few bytes per task.
Counts go up to the threshold, and keys taken for one another only add work. Each scan's counts are added to
those before it, slice by slice. A last scan takes the phrases that
reached the threshold and counts them by their words, so two phrases of one key are told apart.

Rows without an id or text, empty texts, repeated rows (each counts), very long texts and an empty table need
no care; a language that is null is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.llm import wordspans as ws
from cohortweave.llm.rowmaps import column, read_table
from cohortweave.operators.shared import written

SLOT_BITS = 24
NEVER = 255
FLUSH = 1_000_000  # keys a task holds before it sums them
SCAN_BYTES = 1 << 18  # bytes of texts whose phrases are counted together
SPELL_BYTES = 1 << 19  # bytes of texts whose phrases are spelled out and counted together
SPELL_ROWS = 1 << 14  # phrases that are spelled at once
HELD_ROWS = 250_000  # spelled phrases a task holds before it sums them
BATCH_BYTES = 2 << 20  # of texts that go to Python at once
PACKED = "words byte, slice int, keys binary, n binary"

_PIECE_ENDS = np.zeros(256, dtype=bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD_ENDS = _PIECE_ENDS.copy()
_WORD_ENDS[[9, 32]] = True
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class _Words:
    """Words of a chunk of texts with their keys; ``joined[i]`` says that word i and the next stand in one piece."""

    def __init__(self, texts: ws.Texts, langs: np.ndarray):
        self.texts = texts.lowered()
        data = self.texts.data
        self.start, self.end = ws.spans(~_WORD_ENDS[data], texts.bounds)
        owner = np.searchsorted(texts.bounds, self.start, side="right") - 1
        ended = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_PIECE_ENDS[data], out=ended[1:])
        piece = ended[self.start] + owner
        self.joined = piece[1:] == piece[:-1]
        self.lang = langs[owner]
        hashes = ws.RunHashes(ws.byte_values(data)).of(self.start, self.end)
        self.keys = ws.mix(hashes + self.lang.astype(np.uint64) * _A)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words and keys of all pairs, then of all triples."""
        k = self.keys
        two = np.flatnonzero(self.joined)
        pairs = ws.mix(k[two] * _A + k[two + 1] * _B + np.uint64(2))
        at = np.full(len(k) + 1, -1)
        at[two] = np.arange(len(two))
        follow = at[two + 1]
        firsts = np.flatnonzero(follow >= 0)
        triples = ws.mix(pairs[firsts] * _B + pairs[follow[firsts]] * _A + np.uint64(3))
        self.halves = (firsts, follow[firsts])
        return two, pairs, two[firsts], triples


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _lang_numbers(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number per row's language that depends on the language alone, and the languages."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, names


def _lang_hash(name: str) -> int:
    value = 0
    for b in name.encode():
        value = (value * 0x100000001B3 ^ b) & 0x7FFFFFFF
    return value


def _packed(keys: np.ndarray, n: np.ndarray, words: int, slices: int, least: int) -> pa.RecordBatch:
    """Sorted keys with their counts, as a row per slice that has any; counts go up to ``least``, which is all that is asked."""
    part = (keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    first = np.flatnonzero(np.diff(part, prepend=np.uint64(slices)))
    bounds = np.append(first, len(keys)).astype(np.int32)
    counts = np.minimum(n, least).astype(_count_type(least))
    blobs = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds * v.itemsize), pa.py_buffer(v)]) for v in (keys.astype(np.uint32), counts)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), words, np.int8)), pa.array(part[first].astype(np.int32)), *blobs], ["words", "slice", "keys", "n"])


def _count_type(least: int) -> np.dtype:
    return np.min_scalar_type(max(least, 0))


def _unpacked(blobs: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in blobs])


def _summed(least: int):
    """Group pass: the counts of one slice and length, summed, and the slots of the keys that reach ``least``."""

    def run(rows: pa.Table) -> pa.Table:
        keys, n = _unpacked(rows["keys"], np.uint32), _unpacked(rows["n"], _count_type(least))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        total = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
        keys = keys[first]
        reached = np.unique(_slots(keys[total >= least])).astype(np.uint32)
        made = [keys.tobytes(), np.minimum(total, least).astype(_count_type(least)).tobytes(), reached.tobytes()]
        arrays = [rows["words"].slice(0, 1).combine_chunks(), rows["slice"].slice(0, 1).combine_chunks(), *[pa.array([m], pa.binary()) for m in made]]
        return pa.Table.from_arrays(arrays, ["words", "slice", "keys", "n", "reached"])

    return run


def _spread_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob.as_buffer(), np.uint32).astype(np.int64))], ["slot"])


def _scan(rows: DataFrame, step: int, cycle: int, ready: list, slices: int, least: int) -> DataFrame:
    """``words, slice, keys, n`` of one shard: all words during the first cycle, and the phrases that are active."""

    def active(parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        since = np.maximum(*parts).astype(np.int64)
        return (since <= step) & (step < since + cycle)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ready, pairs_ready = ready[0].value, ready[1].value
        held: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for size, keys in held.items():
                if keys:
                    held[size] = []
                    yield _packed(*np.unique(np.concatenate(keys), return_counts=True), size, slices, least)

        for batch in batches:
            codes, names = _lang_numbers(batch.column(0))
            numbers = np.array([_lang_hash(n) for n in names] or [0], dtype=np.int64)[codes] if len(codes) else codes
            for at, chunk in ws.chunks(ws.of_array(batch.column(1)), SCAN_BYTES):
                found = _Words(chunk, numbers[at : at + len(chunk)])
                if step < cycle:
                    held[1].append(found.keys)
                two, pairs, _, triples = found.phrases()
                since = words_ready[_slots(found.keys)]
                held[2].append(pairs[active((since[two], since[two + 1]))])
                since = pairs_ready[_slots(pairs)]
                held[3].append(triples[active((since[found.halves[0]], since[found.halves[1]]))])
                if sum(len(k) for keys in held.values() for k in keys) > FLUSH:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(work, PACKED)


def _reached(counts: DataFrame, words: int, known: np.ndarray, step: int) -> None:
    """Enter into ``known`` that from ``step`` on the keys whose counts reach the threshold are ready."""
    slot = F.col("slot") + 1
    slots = counts.where(F.col("words") == words).select("reached").mapInArrow(_spread_slots, "slot long")
    bits = slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    for row in bits.collect():  # at most 2 ** SLOT_BITS bits in all
        low = (row["bucket"] - 1) << 15
        here = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")) + low
        known[here] = np.minimum(known[here], step)


def frequent_phrases(
    docs: DataFrame, min_count: int = 10, shards: int = 2, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all words and phrases of two and three words that occur ``min_count`` times,
    and ``lang, n`` with all word occurrences.
    """
    if not 1 <= shards <= 80:
        raise ValueError("shards is 1 to 80")
    spark = docs.sparkSession
    dealt = F.pmod(F.xxhash64(column(key)), F.lit(shards))
    rows = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).cast("string").alias("text"), dealt.alias("shard"))
    ready = [np.full(1 << SLOT_BITS, NEVER, dtype=np.uint8) for _ in range(3)]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts: DataFrame | None = None
    for step in range(3 * shards):
        sent = [spark.sparkContext.broadcast(a) for a in ready[:2]]
        shard = rows.where(F.col("shard") == step % shards).select("lang", "text")
        found = _scan(shard, step, shards, sent, slices, min_count)
        if counts is not None:  # of lengths that are not counted to the end
            longer = 1 + (step >= shards) + (step >= 2 * shards)
            found = found.unionByName(counts.where(F.col("words") >= longer).drop("reached"))
        summed = found.groupBy("words", "slice").applyInArrow(_summed(min_count), PACKED + ", reached binary")
        counts = written(summed, "phrase-counts", batch_bytes=BATCH_BYTES)
        for s in sent:
            s.destroy()
        if step < shards:
            _reached(counts, 1, ready[0], step + 1)
        if 0 < step < 2 * shards:
            _reached(counts, 2, ready[1], step + 1)
    _reached(counts, 3, ready[2], 0)

    sent = [spark.sparkContext.broadcast(np.packbits(a != NEVER)) for a in ready]
    exact = rows.select("lang", "text").mapInArrow(_spelled(sent), "lang string, words byte, phrase string, f long")
    counted = written(exact.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(f"words = 0 OR f >= {int(min_count)}"), "phrases", batch_bytes=BATCH_BYTES)
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def _numbered(values: np.ndarray) -> np.ndarray:
    """A number per value, from 0 in the order in which different ones come."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _met(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different value, and how often it comes."""
    codes = _numbered(values)
    n = np.bincount(codes)
    place = np.empty(len(n), dtype=np.int64)
    place[codes] = np.arange(len(codes))
    return place, n


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of several parts, summed."""
    if parts:
        keys = ["lang", "words", "phrase"]
        summed = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate([("f", "sum")])
        yield from summed.rename_columns([*keys, "f"]).to_batches(max_chunksize=SPELL_ROWS)


class _Spelling:
    """The words of a chunk one after another, a space after each, so that every phrase is a run of bytes."""

    def __init__(self, found: _Words):
        data, self.size = found.texts.data, found.end - found.start
        self.at = np.cumsum(self.size + 1) - self.size - 1
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[found.start] += 1
        edge[found.end] -= 1
        gap = np.zeros(int(self.at[-1] + self.size[-1]) + 1, dtype=bool)
        gap[self.at + self.size] = True
        self.data = np.full(len(gap), 32, dtype=np.uint8)
        self.data[~gap] = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]

    def phrases(self, heads: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that begin with the words ``heads``."""
        last = heads + words - 1
        size = self.at[last] + self.size[last] - self.at[heads]
        bounds = np.zeros(len(heads) + 1, dtype=np.int64)
        np.cumsum(size, out=bounds[1:])
        body = self.data[np.arange(bounds[-1]) + np.repeat(self.at[heads] - bounds[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(bounds), pa.py_buffer(body)).cast(pa.string())


def _spelled(ready: list):
    """Arrow pass: phrases of the slots that are set, spelled out, with their counts; and all words as length 0."""

    def ones(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys)
        return np.flatnonzero((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in spelled(batches):
            held.append(part)
            if sum(p.num_rows for p in held) >= HELD_ROWS:
                yield from _joined(held)
                held = []
        yield from _joined(held)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, names = _lang_numbers(batch.column(0))
            langs = pa.array(names, pa.string())

            def counted(spoken: np.ndarray, words: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
                arrays = [langs.take(pa.array(spoken)), pa.array(np.full(len(n), words, np.int8)), phrases, pa.array(n.astype(np.int64))]
                return pa.RecordBatch.from_arrays(arrays, ["lang", "words", "phrase", "f"])

            hashed = np.array([_lang_hash(n) for n in names] or [0], dtype=np.int64)
            for at, chunk in ws.chunks(ws.of_array(batch.column(1)), SPELL_BYTES):
                mine = codes[at : at + len(chunk)]
                found = _Words(chunk, hashed[mine])
                if not len(found.keys):
                    continue
                owner = np.searchsorted(chunk.bounds, found.start, side="right") - 1
                spoken = mine[owner]
                two, pairs, three, triples = found.phrases()
                number = ws.exact_numbers(found.texts.data, found.start, found.end)
                number = _numbered(spoken * (number.max() + 1) + number)
                size = number.max() + 1
                paired = number[two] * size + number[two + 1]
                short = paired if size < 1 << 20 else _numbered(paired)  # 63 bits hold three numbers
                tripled = short[found.halves[0]] * size + number[three + 2]
                text = _Spelling(found)
                groups = ((1, np.arange(len(number)), number, found.keys), (2, two, paired, pairs), (3, three, tripled, triples))
                for words, firsts, numbers, keys in groups:
                    kept = ones(ready[words - 1].value, keys)
                    first, n = _met(numbers[kept])
                    heads = firsts[kept][first]
                    for low in range(0, len(heads), SPELL_ROWS):
                        part = heads[low : low + SPELL_ROWS]
                        yield counted(spoken[part], words, text.phrases(part, words), n[low : low + SPELL_ROWS])
                n = np.bincount(spoken, minlength=len(names))
                met = np.flatnonzero(n)
                yield counted(met, 0, pa.array([""] * len(met), pa.string()), n[met])

    return work


def collocations(frequent: DataFrame, totals: DataFrame, most: int = 2_000, millionths: int = 1_000_000, percent: int = 50) -> DataFrame:
    """The ``most`` strongest phrases per language, from the tables of ``frequent_phrases``.

    A phrase is cut in two at each place; the cut of the least ``millionths * a * a / (l * r)`` counts. A phrase that
    stands in a longer one with ``percent`` of its occurrences gives way. Products are decimals of 38 digits.
    """
    phrases = frequent.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    cut = lambda k, size: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice(word, 1, k), " ").alias("left"), F.array_join(F.slice(word, k + 1, size - k), " ").alias("right")
    )
    cuts = phrases.select("lang", "phrase", "a", F.inline(F.when(F.col("words") == 2, F.array(cut(1, 2))).otherwise(F.array(cut(1, 3), cut(2, 3)))))
    part = lambda name, side: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(part("l", "left"), ["lang", "left"])
        .join(part("r", "right"), ["lang", "right"])
        .withColumn("top", (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(millionths).cast("decimal(7,0)"))
        .withColumn("below", whole("l") * whole("r"))
        .select("lang", "phrase", "a", "k", "l", "r", F.expr("`top` div `below`").alias("score"))
    )
    of_cut = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    both = scored.groupBy("lang", "phrase", "a").agg(*[of_cut(k, c) for k in (1, 2) for c in ("l", "r", "score")])
    second = F.coalesce(F.col("score2") < F.col("score1"), F.lit(False))
    judged = both.select("lang", "phrase", "a", *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in ("l", "r", "score")])
    longer = frequent.where("words = 3").select(
        "lang", F.explode(F.array(F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))).alias("phrase"), "f"
    )
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = judged.join(covered, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * percent))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)  # limited in each task first
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language over all documents."""
    frequent, totals = frequent_phrases(read_table(spark, sf_dir, "documents"))
    return collocations(frequent, totals)


OP12_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT row_no, lang, string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]') AS pieces FROM lowered),
pieces AS (SELECT lang, row_no, generate_subscripts(pieces, 1) AS piece_no, unnest(pieces) AS piece FROM cut),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
spoken AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM split
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split),
freq AS (SELECT lang, words, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lft,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rgt
  FROM freq, (SELECT unnest([1, 2]) AS k) WHERE k < words),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN freq l ON l.lang = c.lang AND l.phrase = c.lft JOIN freq r ON r.lang = c.lang AND r.phrase = c.rgt),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, f
  FROM freq WHERE words = 3),
kept AS (
  SELECT * FROM lowest s
  WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = s.lang AND g.phrase = s.phrase AND 100 * g.f >= 50 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN spoken USING (lang) WHERE rank <= 2000
"""

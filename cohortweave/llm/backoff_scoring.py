"""Language-model scores by a weighted backoff automaton (operator 4).

Tokens are words (A-Z in lower case) and one end per text, each text led by a start. Counts cover every
training text:

1. Words are counted by hash, all of them kept. N-grams of every order are counted; those seen ``LEAST`` times are kept,
   the same at every size of the corpus.
2. Kept n-grams are states, one row each. An arc takes a state and a word to the state of the longer
   n-gram and has a smoothed log-probability (absolute discounting, the discount from the counts of counts).
   Where a state has no arc for a word, its failure arc leads to the state without the first token and
   carries the backoff weight, which makes each state's probabilities add up to one. The root's
   arcs are words with add-one probabilities. Arcs and weights are made by joins; the model is as large as the corpus asks.
3. The score of a token is a sum over the n-grams that end at it or just before it: the root arc of the word, the backoff
   weight of every kept context, and for every kept n-gram its *gain*, its arc less what
   the weight of its context and its suffix's score would give. So a text's score is a sum over its n-grams, each looked up by its hash.

The n-grams and words with at least ``KEEP`` of all tokens are sent to all tasks as a cache of proven size
(``1 / KEEP`` entries per order); it decides where a value is looked up, never what it is. The n-grams and
words of a text that are not in it are looked up in the tables.

What the disk holds at a time is bounded. Texts are tokenized once, into blocks (``token_blocks``). N-grams are dealt into
parts by hash; the parts of an order are counted, and later looked up, in a fixed number of rounds, each reading all blocks.
Shuffle files go as soon as what needed them is written, and tables as soon as nothing reads them. N-grams travel in packed
arrays: to be counted, once per block as their words (two bytes for a common one, the hash for others) and a number; to be
looked up, as sorted hashes by their differences, with the rows they are in. Sums per row come back.

Edge cases: a null or empty text is its end alone. Without training texts all scores are 0. Rows
with equal ids are scored one by one and are all training texts or none; a null id counts as the text ''
when texts are held out. Words compare by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm import token_blocks, wordspans
from cohortweave.llm.token_blocks import Encoded, packed, unpacked
from cohortweave.operators.shared import Scratch

ORDER = 3
KEEP = 5e-7  # of all tokens: what the cache holds
LEAST = 2  # occurrences of an n-gram in the model


_START, _END = np.uint64(0x5374617274A5C3E1), np.uint64(0x456E640F1E2D3C4B)  # in place of words' hashes
_STEP = np.uint64(0xD6E8FEB86659FD93)

# Layout: changes what is on disk and in memory at a time, never a result.
LOOKUP_ROUNDS = 2  # for each order; n-grams of order n are counted in n - 1
_ROUND_TOKENS = 1 << 21  # of a corpus for each round, up to those
_PART_GRAMS = 1 << 21  # occurrences in a part
_BATCH_BYTES = 8 << 20
_CODES = {"parquet.dictionary.page.size": str(8 << 20)}  # words come again and again, so their columns are numbers of a dictionary
_RARE = 65_535  # in place of the code of a word that has none


def _signed(value: np.uint64) -> int:
    return int(np.array(value).view(np.int64))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their contexts and words."""
    return wordspans.mix(context * _STEP + word)


def _grams_of(block: token_blocks.Block, n: int, deal: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block that fall to the parts of a round: their hashes, sorted, and the places where they begin."""
    hashes = block.words[block.ids]
    keys = hashes[: max(len(hashes) - n + 1, 0)]
    inside = np.ones(len(keys), dtype=bool)
    for k in range(1, n):
        keys = longer(keys, hashes[k : k + len(keys)])
        inside &= block.ids[k : k + len(keys)] != len(block.words) - 1  # no second text
    at = np.flatnonzero(inside & _of_parts(keys, deal))
    keys = keys[at]
    sort = token_blocks.ordered(keys)
    return keys[sort], at[sort]


def grams(hashes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order from 2 its number, the places where an n-gram ends, and the hashes of the contexts there."""
    inside = hashes != _START
    keys, ends = hashes, np.ones(len(hashes), dtype=bool)
    for n in range(2, order + 1):
        at = np.flatnonzero(ends[:-1] & inside[1:]) + 1
        yield n, at, keys[at - 1]
        longest = np.zeros(len(hashes), dtype=np.uint64)
        longest[at] = longer(keys[at - 1], hashes[at])
        ends = np.zeros(len(hashes), dtype=bool)
        ends[at] = True
        keys = longest


def token_hashes(found: wordspans.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each led by the start and closed by the end; borders."""
    n = len(found.before) - 1
    bounds = found.before + 2 * np.arange(n + 1)
    hashes = np.empty(int(bounds[-1]), dtype=np.uint64)
    hashes[bounds[:-1]] = _START
    hashes[bounds[1:] - 1] = _END
    hashes[np.arange(len(found.hashes)) + 2 * found.owner() + 1] = found.hashes
    return hashes, bounds


@dataclass
class Automaton:
    """The part of the model that all tasks hold."""

    hashes: np.ndarray  # of frequent words, sorted
    word_counts: np.ndarray  # with the end and the start after the words
    word_failures: np.ndarray  # log10 backoff weights of the same
    total: int  # N
    distinct: int  # V
    keys: list[np.ndarray]  # sorted hashes of frequent n-grams of orders 2, 3, ...
    gains: list[np.ndarray]  # log10
    failures: list[np.ndarray]  # log10
    whole: list[bool]  # whether an order has no other n-grams

    @property
    def end(self) -> int:
        return len(self.hashes)

    @property
    def start(self) -> int:
        return len(self.hashes) + 1

    def root(self, count) -> np.ndarray:
        """Log-probability of a word seen so often."""
        return np.log10((np.asarray(count, dtype=np.float64) + 1.0) / (self.total + self.distinct + 1.0))

    def tokens(self, found: wordspans.Words) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each led by the start and closed by the end, -1 for rare words; borders."""
        hashes, bounds = token_hashes(found)
        return self.numbers(hashes), bounds

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        ids = _scattered(self.hashes, hashes)
        ids[hashes == _START] = self.start
        ids[hashes == _END] = self.end
        return ids

    def score(self, ids: np.ndarray) -> np.ndarray:
        """Log-probability of every token as far as the cache knows; of rare words the failure arcs only."""
        known = np.concatenate([self.hashes, [_END, _START], np.zeros(1, np.uint64)])
        return self.looked_up(known[ids], ids)

    def looked_up(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What the cache gives to every token."""
        inside = ids != self.start
        roots = self.root(self.word_counts)
        out = np.where(inside & (ids >= 0), roots[ids], 0.0)
        weights = np.where(ids >= 0, self.word_failures[ids], 0.0)  # of the contexts that end here
        for n, at, context in grams(hashes, len(self.keys) + 1):
            place = _places(self.keys[n - 2], longer(context, hashes[at]))
            hit = place >= 0
            out[at[hit]] += self.gains[n - 2][place[hit]]
            weights[at[hit]] += self.failures[n - 2][place[hit]]
        out[1:] += np.where(inside[1:], weights[:-1], 0.0)
        return out


def _places(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, -1 where it does not."""
    if not len(ordered):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, token_blocks.Block]]:
    return token_blocks.decoded(batch, _START, _END)


def _rounds(most: int, tokens: int) -> int:
    return max(1, min(most, tokens // _ROUND_TOKENS))


def _dealt(tokens: int, rounds: int) -> list[tuple[int, int, int]]:
    """For each round the number of all parts, its first and its last but one."""
    each = max(1, -(-tokens // (rounds * _PART_GRAMS)))
    return [(each * rounds, r * each, (r + 1) * each) for r in range(rounds)]


def _least(part: int, parts: int) -> np.uint64:
    """The least hash of a part; parts are ranges of hashes."""
    return np.uint64(-(-(part << 32) // parts) << 32)


def _of_parts(keys: np.ndarray, deal: tuple[int, int, int]) -> np.ndarray:
    """Which hashes fall to the parts of a round."""
    parts, low, high = deal
    first = _least(low, parts)
    beyond = (1 << 64) if high == parts else int(_least(high, parts))
    return keys - first <= np.uint64(beyond - 1 - int(first))


def _cuts(ordered: np.ndarray, deal: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The parts of a round that have some of these hashes, each with its borders among them."""
    parts, low, high = deal
    starts = np.array([_least(p, parts) for p in range(low, high)], dtype=np.uint64)
    at = [*np.searchsorted(ordered, starts).tolist(), len(ordered)]
    return [(p, a, b) for p, a, b in zip(range(low, high), at[:-1], at[1:]) if a < b]


def _part_column(key: str, parts: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(parts).cast("long"), 32).cast("int")


def _count_words(deal: tuple[int, int, int]) -> Callable:
    """For each block its words, by part, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in _blocks(batch):
                times, sort = np.bincount(block.ids), np.argsort(block.words[:-2])
                keys, times, made = block.words[sort], times[sort], []
                for p, a, b in _cuts(keys, deal):
                    made.append((p, b - a, packed(times[a:b]), packed(np.diff(keys[a:b], prepend=_least(p, deal[0]))), b""))
                yield _batch(made, _COUNTS)

    return run


def _word_part(parts: int) -> Callable:
    """The words of a part with their occurrences."""

    def run(table: pa.Table) -> pa.Table:
        first, (sizes, times, keys) = _least(table["p"][0].as_py(), parts), (table[c].to_pylist() for c in ("m", "times", "codes"))
        keys = np.concatenate([first + np.cumsum(unpacked(k, m, np.uint64), dtype=np.uint64) for k, m in zip(keys, sizes)])
        sort = token_blocks.ordered(keys)
        at = _firsts(keys[sort])
        total = np.add.reduceat(np.concatenate([unpacked(t, m) for t, m in zip(times, sizes)])[sort], at)
        return pa.table([pa.array(keys[sort[at]].view(np.int64)), pa.array(total)], ["k", "n"])

    return run


@dataclass
class _Codes:
    """Words with a code of two bytes."""

    hashes: np.ndarray  # by code
    order: np.ndarray  # codes, sorted by hash
    ordered: np.ndarray  # hashes, sorted

    @classmethod
    def of(cls, hashes: np.ndarray) -> _Codes:
        order = np.argsort(hashes)
        return cls(hashes, order.astype(np.uint16), hashes[order])

    def numbers(self, words: np.ndarray) -> np.ndarray:
        at = _scattered(self.ordered, words)
        return np.where(at >= 0, self.order[at], np.uint16(_RARE))


def _scattered(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``_places`` of values in no order, which are faster to look for when sorted."""
    sort = np.argsort(wanted)
    out = np.empty(len(wanted), dtype=np.int64)
    out[sort] = _places(ordered, wanted[sort])
    return out


def _count_grams(n: int, deal: tuple[int, int, int], sent: Broadcast) -> Callable:
    """For each block the n-grams of the parts of a round, each once with its occurrences, as their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in _blocks(batch):
                codes = sent.value.numbers(block.words)
                keys, at = _grams_of(block, n, deal)
                first = _firsts(keys)
                times = np.diff(np.append(first, len(keys)))
                words = block.ids[at[first] + np.arange(n)[:, None]]  # a row for each place in the n-gram
                made = []
                for p, a, b in _cuts(keys[first], deal):
                    own = codes[words[:, a:b]].reshape(-1)
                    rare = block.words[words[:, a:b].reshape(-1)[own == _RARE]]
                    made.append((p, b - a, packed(times[a:b]), packed(own), rare.tobytes()))
                yield _batch(made, _COUNTS)

    return run


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)


_COUNTS = pa.schema([("p", pa.int32()), ("m", pa.int64()), ("times", pa.binary()), ("codes", pa.binary()), ("rare", pa.binary())])
_SUMS = pa.schema([("_block", pa.int64()), ("m", pa.int64()), ("rows", pa.binary()), ("sums", pa.binary())])
_LOOKUPS = pa.schema([("p", pa.int32()), *_SUMS, ("keys", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {'int32': 'int', 'int64': 'long'}.get(str(f.type), str(f.type)) }" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _count_part(n: int, least: int, sent: Broadcast) -> Callable:
    """The n-grams of a part that are kept: hashes of them, of their contexts and suffixes, occurrences; how many are seen once and twice."""

    def run(table: pa.Table) -> pa.Table:
        known = np.append(sent.value.hashes, np.zeros(_RARE + 1 - len(sent.value.hashes), np.uint64))
        words, times = [], []
        for m, counts, codes, rare in zip(*(table[c].to_pylist() for c in _COUNTS.names[1:])):
            own = unpacked(codes, n * m, np.uint16)
            found = known[own]
            found[own == _RARE] = np.frombuffer(rare, np.uint64)
            words.append(found.reshape(n, m))
            times.append(unpacked(counts, m))
        words, times = np.concatenate(words, axis=1), np.concatenate(times)
        keys = _key(words)
        sort = token_blocks.ordered(keys)
        first = _firsts(keys[sort])
        total = np.add.reduceat(times[sort], first)
        kept = total >= least
        words = words[:, sort[first[kept]]]
        columns = [pa.array(_key(w).view(np.int64)) for w in (words, words[:-1], words[1:])] + [pa.array(total[kept])]
        columns = [pa.concat_arrays([c, pa.array([None, None], pa.int64())]) for c in columns[:3]] + [pa.concat_arrays([columns[3], pa.array([1, 2])])]
        met = pa.concat_arrays([pa.nulls(int(kept.sum()), pa.int64()), pa.array([int((total == x).sum()) for x in (1, 2)])])
        return pa.table([*columns, met], ["k", "c", "s", "n", "met"])

    return run


def _key(words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given by a row of hashes for each place."""
    key = words[0]
    for word in words[1:]:
        key = longer(key, word)
    return key


@dataclass
class Tables:
    """The whole model: ``k, n`` of all words; ``o, k, v`` of the states of order ``o`` that the cache does not hold.

    ``v`` is a gain or a backoff weight, so a state may have two rows.
    """

    words: DataFrame
    rest: DataFrame


def fit(training: DataFrame | Encoded, text: str = "text", order: int = ORDER, keep: float = KEEP, least: int = LEAST) -> tuple[Automaton, Tables]:
    """The cache and the tables.

    The driver takes at most ``1 / keep`` words and as many n-grams of each order.
    """
    spark = training.blocks.sparkSession if isinstance(training, Encoded) else training.sparkSession
    scratch = Scratch(spark, _BATCH_BYTES)
    blocks = (training if isinstance(training, Encoded) else token_blocks.encoded(scratch, "blocks", training, text, [])).blocks
    deal = _dealt(blocks.agg(F.sum("_words")).first()[0] or 0, 1)[0]
    parted = blocks.select(token_blocks.PARTS).mapInArrow(_count_words(deal), _ddl(_COUNTS)).groupBy("p")
    words = scratch.write("word-table", parted.applyInArrow(_word_part(deal[0]), "k long, n long"))
    n_texts = blocks.agg(F.sum("_rows")).first()[0] or 0
    sums = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = (sums[0] or 0) + n_texts, sums[1] + (n_texts > 0)
    bound = max(least, int(np.ceil(keep * total)))
    start, end = _signed(_START), _signed(_END)
    common = words.orderBy(F.desc("n"), "k").limit(_RARE - 2).select("k").toPandas()["k"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(_Codes.of(np.append(common, [_START, _END])))
    root = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    ends = spark.createDataFrame([(start, n_texts), (end, n_texts)], "k long, n long")
    shorter = words.unionByName(ends).select("k", "n", root.alias("arc"))  # states of one order less
    weights: list[DataFrame] = []  # backoff weights ``f`` of the states ``c`` of orders 1, 2, ..., with their occurrences ``cn``
    made: list[DataFrame] = []
    for n in range(2, order + 1):
        sums = [
            blocks.select(token_blocks.PARTS).mapInArrow(_count_grams(n, deal, sent), _ddl(_COUNTS))
            .groupBy("p").applyInArrow(_count_part(n, least, sent), "k long, c long, s long, n long, met long")
            for deal in _dealt(total, _rounds(n - 1, total))
        ]
        both = scratch.write(f"grams-{n}", *sums, **_CODES)
        met = {r["n"]: r["met"] for r in both.where("met IS NOT NULL").groupBy("n").agg(F.sum("met").alias("met")).collect()}
        once, twice = met.get(1, 0), met.get(2, 0)
        discount = once / (once + 2.0 * twice) if once and twice else 0.5
        rows, part = both.where("met IS NULL").drop("met"), F.greatest(F.col("n") - discount, F.lit(1e-12))
        # The same word after the context without its first token; it is kept, as it is seen as often.
        low = shorter.select(F.col("k").alias("s"), F.col("arc").alias("low"))
        states = scratch.write(f"states-{n}", rows.join(low, "s").drop("s"), **_CODES)
        scratch.remove(f"grams-{n}")
        counts = shorter.select(F.col("k").alias("c"), F.col("n").alias("cn"))
        taken = states.groupBy("c").agg(F.sum(part).alias("taken"), F.sum(F.pow(F.lit(10.0), "low")).alias("below")).join(counts, "c")
        left, below = (F.greatest(1.0 - x, F.lit(1e-9)) for x in (F.col("taken") / F.col("cn"), F.col("below")))
        weights.append(scratch.write(f"weights-{n - 1}", taken.select("c", "cn", F.log10(left / below).alias("f")), **_CODES))
        arc = F.log10(part / F.col("cn"))
        columns = ["k", "n", arc.alias("arc"), (arc - F.col("f") - F.col("low")).alias("d")]
        shorter = scratch.write(f"arcs-{n}", states.join(weights[-1], "c").select(columns), **_CODES)
        made.append(shorter)
        scratch.remove(f"states-{n}")
    if "blocks" in scratch.paths:
        scratch.remove("blocks")

    def of_driver(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, sorted, and values."""
        found = rows.toDF("k", "v").toPandas()
        keys = found["k"].to_numpy(np.int64).view(np.uint64)
        sort = np.argsort(keys)
        return keys[sort], found["v"].to_numpy(np.float64)[sort]

    def failures(n: int, keys: np.ndarray) -> np.ndarray:
        """Backoff weights of these frequent states of order ``n``; those without arcs have none."""
        if n > len(weights):
            return np.zeros(len(keys))
        known, values = of_driver(weights[n - 1].where(F.col("cn") >= bound).select("c", "f"))
        place = _places(known, keys)
        return np.where(place >= 0, values[place], 0.0) if len(values) else np.zeros(len(keys))

    frequent, seen = of_driver(words.where(F.col("n") >= bound))
    # The start is a context of every text, and never comes after anything.
    first = weights[0].where(F.col("c") == start).first() if weights else None
    seen = np.concatenate([seen, [n_texts, n_texts]])
    fails = np.concatenate([failures(1, frequent), [0.0, first["f"] if first else 0.0]])
    model = Automaton(frequent, seen, fails, total, distinct, [], [], [], [])
    rest = [weights[0].where((F.col("cn") < bound) & (F.col("c") != start)).select(F.lit(1).alias("o"), F.col("c").alias("k"), F.col("f").alias("v"))] if weights else []
    for n, rows in enumerate(made, 2):
        keys, gains = of_driver(rows.where(F.col("n") >= bound).select("k", "d"))
        model.keys.append(keys)
        model.gains.append(gains)
        model.failures.append(failures(n, keys))
        own = rows.where(F.col("n") < bound).select(F.lit(n).alias("o"), "k", F.col("d").alias("v"))
        model.whole.append(own.isEmpty())
        rest.append(own)
        if n <= len(weights):
            rest.append(weights[n - 1].where(F.col("cn") < bound).select(F.lit(n).alias("o"), F.col("c").alias("k"), F.col("f").alias("v")))
    return model, Tables(words, reduce(DataFrame.unionByName, rest) if rest else spark.createDataFrame([], "o int, k long, v double"))


def _wanted(n: int, deal: tuple[int, int, int], sent: Broadcast) -> Callable:
    """For each block the words, or n-grams, of these parts that the cache does not hold, with the rows they are in.

    What the cache gives goes along as sums per row, to any part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        roots, unseen = known.root(known.word_counts), known.root(0)
        values = known.gains[n - 2] + known.failures[n - 2] if n > 1 else None
        for batch in batches:
            for i, block in _blocks(batch):
                number, made = batch.column(len(token_blocks.PARTS))[i].as_py(), []
                if n == 1:
                    own = known.numbers(block.words)
                    base = np.where(own < 0, unseen, np.where(own == known.start, 0.0, roots[own]))
                    weights = np.where(own < 0, 0.0, known.word_failures[own])  # every token but the end is a context
                    seen = (own >= 0) & (own != known.start) & (known.word_counts[own] > 0)
                    sums = [np.add.reduceat(x[block.ids], block.bounds[:-1]) for x in (base, seen.astype(np.float64), base + weights)]
                    made.append((_spread(number, deal), number, len(sums[0]), packed(np.arange(len(sums[0]))), np.concatenate(sums).tobytes(), None))
                    at = np.flatnonzero((own < 0)[block.ids])
                    keys = block.words[block.ids[at]]
                    sort = token_blocks.ordered(keys)
                    keys, rows = keys[sort], block.owner(at[sort])
                else:
                    keys, at = _grams_of(block, n, deal)
                    rows, place = block.owner(at), _places(known.keys[n - 2], keys)
                    hit = place >= 0
                    if hit.any():
                        place = place[hit]
                        made.append((_spread(number, deal), number, *_per_row(rows[hit], [values[place]]), None))
                    keys, rows = (keys[~hit], rows[~hit]) if not known.whole[n - 2] else (keys[:0], rows[:0])
                for p, a, b in _cuts(keys, deal):
                    made.append((p, number, b - a, packed(rows[a:b]), None, packed(np.diff(keys[a:b], prepend=_least(p, deal[0])))))
                yield _batch(made, _LOOKUPS)

    return run


def _spread(number: int, deal: tuple[int, int, int]) -> int:
    """A part of a round for what belongs to none."""
    return deal[1] + (number * 2654435761 >> 16) % (deal[2] - deal[1])


def _per_row(rows: np.ndarray, values: list[np.ndarray]) -> tuple[int, bytes, bytes]:
    """How many rows there are, which, and for each value the sums of them."""
    met = np.flatnonzero(np.bincount(rows))
    return len(met), packed(met), np.concatenate([np.bincount(rows, weights=v)[met] for v in values]).tobytes()


def _found(parts: int, values: list[str]) -> Callable:
    """Per block the rows with something found in a part of the table, and the sums of its values."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        sort = token_blocks.ordered(ordered := held["k"].to_numpy().view(np.uint64))
        first = _firsts(ordered := ordered[sort])
        ordered = ordered[first]
        own = [np.add.reduceat(held[v].to_numpy()[sort], first) for v in values] if len(first) else []
        made: list[tuple] = []
        for p, number, m, rows, sums, keys in zip(*(asked[c].to_pylist() for c in _LOOKUPS.names)):
            if keys is None:
                made.append((number, m, rows, sums))
                continue
            place = _places(ordered, _least(p, parts) + np.cumsum(unpacked(keys, m, np.uint64), dtype=np.uint64))
            hit = np.flatnonzero(place >= 0)
            if len(hit):
                made.append((number, *_per_row(unpacked(rows, m)[hit], [v[place[hit]] for v in own])))
        return pa.Table.from_batches([_batch(made, _SUMS)])

    return run


def _summed(values: list[str]) -> Callable:
    """Sums per row of a block."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([unpacked(r, m) for r, m in zip(table["rows"].to_pylist(), table["m"].to_pylist())])
        sums = np.concatenate([np.frombuffer(x).reshape(len(values), -1) for x in table["sums"].to_pylist()], axis=1)
        met = np.flatnonzero(np.bincount(rows))
        columns = [np.full(len(met), table["_block"][0].as_py(), np.int64), met.astype(np.int32), *[np.bincount(rows, weights=x)[met] for x in sums]]
        return pa.table([pa.array(c) for c in columns], ["_block", "_i", *values])

    return run


def _looked_up(blocks: DataFrame, table: DataFrame, values: list[str], n: int, deal: tuple[int, int, int], sent: Broadcast) -> DataFrame:
    """``_block, _i`` and the sums of these values over the words, or n-grams, that the row has in the parts of a round."""
    parts, low, high = deal
    asked = blocks.select(*token_blocks.PARTS, "_block").mapInArrow(_wanted(n, deal, sent), _ddl(_LOOKUPS))
    held = table.withColumn("p", _part_column("k", parts)).where(F.col("p").between(low, high - 1)).select("p", "k", *values)
    sums = asked.groupBy("p").cogroup(held.groupBy("p")).applyInArrow(_found(parts, values), _ddl(_SUMS))
    return sums.groupBy("_block").applyInArrow(_summed(values), "_block long, _i int" + "".join(f", {v} double" for v in values))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: its block and place in it, its tokens, and what is kept."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, n, number = (batch.column(c)[i].as_py() for c in range(3))
            arrays = [np.full(n, number, np.int64), np.arange(n, dtype=np.int32), unpacked(sizes, n) + 1]
            kept = [c.slice(i, 1).flatten() for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), *kept], ["_block", "_i", "n_tokens", *[f"_k{j}" for j in range(len(kept))]])


def score(docs: DataFrame | Encoded, model: Automaton, tables: Tables, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the key, the columns kept, ``n_tokens, n_known, base_score, score``."""
    spark = tables.words.sparkSession
    scratch = Scratch(spark, _BATCH_BYTES)
    source = docs if isinstance(docs, Encoded) else token_blocks.encoded(scratch, "blocks", docs, text, [key, *(keep or [])])
    blocks = source.blocks
    sent = spark.sparkContext.broadcast(model)
    types = "".join(f", _k{i} {kind}" for i, (_, kind) in enumerate(source.kept))
    rows = blocks.select("_sizes", "_rows", "_block", *[f"_k{i}" for i in range(len(source.kept))])
    passed = scratch.write("scored", rows.mapInArrow(_rows, "_block long, _i int, n_tokens long" + types))

    tokens = blocks.agg(F.sum(F.col("_words") + 2 * F.col("_rows"))).first()[0] or 0
    # Words that the cache does not hold count as unseen at first; log10(n + 1) is what their root arc has beyond that.
    more = F.log10(F.col("n") + 1)
    words = tables.words.select("k", more.alias("base"), F.lit(1.0).alias("known"), more.alias("more"))
    rest = tables.rest.withColumnRenamed("v", "more")
    words = words.unionByName(rest.where("o = 1").select("k", F.lit(0.0).alias("base"), F.lit(0.0).alias("known"), "more"))
    looked = _looked_up(blocks, words, ["base", "known", "more"], 1, *_dealt(tokens, 1), sent)
    sums = [scratch.write("word-sums", looked)]
    # N-grams that the cache does not hold; those that are not in the model either add nothing.
    rounds = _dealt(tokens, _rounds(LOOKUP_ROUNDS, tokens))
    found = [_looked_up(blocks, rest.where(F.col("o") == n), ["more"], n, deal, sent) for n in range(2, len(model.keys) + 2) for deal in rounds]
    if found:
        sums.append(scratch.write("gram-sums", *found).select("_block", "_i", F.lit(0.0).alias("base"), F.lit(0.0).alias("known"), "more"))
    if "blocks" in scratch.paths:
        scratch.remove("blocks")
    added = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    added = added.groupBy("_block", "_i").agg(*[F.sum(c).alias(f"_{c}") for c in ("base", "known", "more")])
    plus = {c: F.coalesce(f"_{c}", F.lit(0.0)) for c in ("base", "known", "more")}
    return passed.join(added, ["_block", "_i"], "left").select(
        *[F.col(f"_k{i}").alias(c) for i, (c, _) in enumerate(source.kept)],
        "n_tokens",
        plus["known"].cast("long").alias("n_known"),
        plus["base"].alias("base_score"),
        plus["more"].alias("score"),
    )


def held_out(key: Column, parts: int, chosen: int) -> Column:
    """Whether the crc32 of the id, as text, leaves this remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == chosen


def op4_backoff_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    scratch = Scratch(spark, _BATCH_BYTES)
    training = token_blocks.encoded(scratch, "training-blocks", docs.where(~F.col("held_out")), "text", ["doc_id", "held_out"])
    others = token_blocks.encoded(scratch, "other-blocks", docs.where("held_out"), "text", ["doc_id", "held_out"])
    model, tables = fit(training)
    scored = score(training.union(others), model, tables, keep=["held_out"])
    scratch.remove("training-blocks", "other-blocks")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

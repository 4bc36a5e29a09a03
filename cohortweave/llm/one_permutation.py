"""Document fingerprints by one-permutation MinHash (operator 6).

Every shingle of five words (in lower case) is hashed once. The top bits of the hash name one of
``BINS`` bins, which keeps its least hash. A bin that no shingle fell into takes the value of
another by optimal densification: it looks at bins in an order of its own, the same for all texts (a few
hashes of its number, then all bins from a hashed start by a hashed odd step), and takes the first that is not empty. The ``BITS`` low-order bits of each value, packed as hex digits, are the
fingerprint. Two bins of different documents agree by chance once in ``2**BITS``, so the likeness
of two fingerprints is ``(equal - 1/16) / (1 - 1/16)``, cut off at 0.

Only DataFrame functions are used. Shingles, bins and probes are arrays inside a row: nothing is
exploded. Texts move once, to meet their next id by their own, and that one shuffle serves both to send
each text's head, no longer than the document before can use, and to receive the next one's.

*Next document*: that of the next greater id. Ids are numbered over range partitions, so no window
covers the table; the head is fetched by a join of ids. Of several rows with one id the head is that
of the least text and the likeness is to the least fingerprint; each of them has the same next
document. Rows with a null id have no next document, and nothing replaces their tail.

Edge cases: null and empty texts, and texts without words, have the fingerprint of 0 digits; two of
these are alike (1), one and another text are not (0). Texts under five words have one shingle,
the whole. A table with one id is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.rowmaps import column
from cohortweave.operators.ranking import global_row_number
from cohortweave.operators.shared import written

SHINGLE = 5
BINS = 256
BITS = 4  # one hex digit a bin
PROBES = 6  # places a bin looks at before it goes through all

_SPACE = r"[\x09-\x0D\x20]+"
_SHIFT = 63 - BINS.bit_length() + 1  # a hash without its sign has 63 bits
_LOW = (1 << _SHIFT) - 1


def _probe(bin_no: Column, attempt: int) -> Column:
    """A fixed hash of a bin and an attempt: where an empty bin looks first."""
    return F.pmod(F.xxhash64(bin_no, F.lit(attempt)), F.lit(BINS)).cast("int")


def _order(bin_no: Column) -> Column:
    """All bins, from a hashed start by a hashed odd step: the order of its own in which a bin looks on."""
    start = F.pmod(F.xxhash64(bin_no, F.lit(-1)), F.lit(BINS))
    step = F.pmod(F.xxhash64(bin_no, F.lit(-2)), F.lit(BINS // 2)) * 2 + 1
    return F.transform(F.sequence(start, start + step * (BINS - 1), step), lambda at: F.pmod(at, F.lit(BINS)).cast("int"))


def shingle_hashes(text: Column) -> Column:
    """Even hashes from 0 to 2**63 - 2 of the text's shingles, repeated ones included."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))

    def of(words: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]).bitwiseAND(F.lit((1 << 63) - 2))
        # A text under five words has one shingle, the whole; words that are not there leave a hash as it is.
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), hashed)

    return F.when(trimmed != "", _let(F.split(trimmed, _SPACE), of)).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the body does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bin_minima(hashes: Column) -> Column:
    """The least hash of every bin, in the order of bins; the greatest value of the bin where it is empty."""
    # Each bin's greatest value, which is odd and so no hash, closes the bin in the sorted array.
    closing = F.array(*[F.lit((b << _SHIFT) | _LOW) for b in range(BINS)])

    def leaders(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1).bitwiseAND(F.lit(_LOW)) == _LOW))

    return _let(F.sort_array(F.concat(hashes, closing)), leaders)


def densified(minima: Column) -> Column:
    """Values of all bins, empty ones filled; needs one bin that is not empty."""
    def fill(values: Column) -> Column:
        low = lambda x: x.bitwiseAND(F.lit(_LOW))
        used = lambda x: F.when(low(x) != _LOW, x)

        def value(x: Column, b: Column) -> Column:
            tries = [used(F.get(values, _probe(b, k))) for k in range(PROBES)]
            # All bins, each in an order of its own; needed for short texts only.
            rest = F.filter(F.transform(_order(b), lambda at: F.get(values, at)), lambda v: low(v) != _LOW)
            return F.coalesce(used(x), *tries, F.get(rest, F.lit(0)))

        return F.transform(values, value)

    return _let(minima, fill)


def fingerprint(text: Column) -> Column:
    """``BINS`` hex digits, or the empty string for a text without words."""
    hashes = shingle_hashes(F.coalesce(text, F.lit("")))
    # The lowest bit is the same in all hashes.
    digit = lambda x: F.substring(F.lit("0123456789abcdef"), (F.shiftright(x, 1).bitwiseAND(F.lit((1 << BITS) - 1)) + 1).cast("int"), F.lit(1))
    return _let(hashes, lambda h: F.when(F.size(h) > 0, F.array_join(F.transform(densified(bin_minima(h)), digit), "")).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest((same / F.lit(float(BINS)) - chance) / (1.0 - chance), F.lit(0.0))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of every row."""
    return docs.select(column(key), fingerprint(column(text).cast("string")).alias("fingerprint"))


def next_ids(docs: DataFrame, key: str) -> DataFrame:
    """``_key, _next`` for every id: the next greater one, for the greatest the least."""
    ids = docs.select(column(key).alias("_key")).where("_key IS NOT NULL").distinct()
    numbered = written(global_row_number(ids, ["_key"], "_no"), "id-order")
    total = numbered.count()
    after = numbered.select(F.col("_key").alias("_next"), F.when(F.col("_no") == 1, F.lit(total)).otherwise(F.col("_no") - 1).alias("_no"))
    return numbered.join(after, "_no").select("_key", "_next")


def edited_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``_key, _text``, its ``_next`` id, and ``_edited``: its last quarter replaced by the next document's head."""
    rows = docs.select(column(key).alias("_key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("_text"))
    order = written(next_ids(docs, key), "next-ids")
    # Numbers alone: who needs how much of whose head.
    asked = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.max(F.length("_text")).alias("_n"))
    before = order.join(asked, "_key").select(F.col("_next").alias("_key"), F.col("_key").alias("_to"), F.floor(F.col("_n") / 4).cast("int").alias("_take"))
    # Both joins are by the text's own id, on the same rows, so texts are shuffled once.
    named = rows.where("_key IS NOT NULL")
    sent = named.join(before, "_key").select("_to", "_key", F.substring("_text", F.lit(1), F.col("_take")).alias("_head"))
    heads = sent.groupBy("_to", "_key").agg(F.min("_head").alias("_head")).select(F.col("_to").alias("_key"), F.col("_key").alias("_next"), "_head")
    nameless = rows.where("_key IS NULL").select("*", F.lit(None).cast(docs.schema[key].dataType).alias("_next"), F.lit(None).cast("string").alias("_head"))
    joined = named.join(heads, "_key", "left").select("_key", "_text", "_next", "_head").unionByName(nameless)
    quarter = F.floor(F.length("_text") / 4).cast("int")
    head = F.substring(F.coalesce("_head", F.lit("")), F.lit(1), quarter)
    return joined.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.length("_text") - quarter), head)).drop("_head")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the fingerprints of the text, its edited text and the next document, and how like they are."""
    made = edited_texts(docs, key, text).select(
        "_key", "_next", F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_text")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"),
    )
    made = written(made, "fingerprints")
    after = made.groupBy(F.col("_key").alias("_next")).agg(F.min("fingerprint").alias("_next_print"))
    return made.join(after, "_next", "left").select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.when(F.col("_next_print").isNotNull(), likeness(F.col("fingerprint"), F.col("_next_print"))).alias("near_next"),
    )


def op6_one_permutation(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

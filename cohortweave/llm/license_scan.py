"""License texts in documents by an exact set-similarity join with templates (operator 1).

Templates and texts are sequences of words (A-Z in lower case; letters, digits and non-ASCII).
A *block* is a run of as many words as a template has, repeated ones included (fewer in a shorter text).
The join finds every block that contains at least ``THRESHOLD`` of a template's different words:

* Tokens are ordered by the number of documents they are in, the rarest first. A block that holds
  ``need = ceil(threshold * size)`` of a template's words holds one of its first ``size - need + 1``
  (prefix filter). Texts without such a word are not looked at again.
* Blocks are made only where a prefix word stands: those that cover its place.
* A text with fewer than ``need`` words has no block (length filter). There is no positional filter: no rank enters a bound.
* What is left is verified by intersection, once per block and template.

Overlapping blocks that match are one find: the score of a text is the best containment of any of
them, and the label of a template is set if any block reaches the threshold.

Beside the join the base phrases are found where their words stand consecutively. Only DataFrame
functions are used. Templates and phrases are parameters; the driver collects one number per
distinct template word, nothing that grows with the documents. A text is one row throughout and
does not shuffle, so hot sources cost nothing more.

Edge cases: null and empty texts have no words, no labels and score 0. Repeated rows are scanned
alike. Templates without words match nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.rowmaps import column

THRESHOLD = 0.8

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Templates: label and text. Several of one label may be given.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This program is free software under the GNU General Public License, version 2."),
    ("lgpl", "GNU Lesser General Public License, version 2.1"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "Licensed under Creative Commons Attribution 4.0 International"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def spaced(text: Column) -> Column:
    """Words with one space before and after each; a text without words is one space."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), _BETWEEN, " ")


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def word_frequencies(lines: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts (column ``_line`` as ``spaced`` gives) each of the words is."""
    if not words:
        return {}
    counts = lines.agg(*[F.count(F.when(F.contains("_line", F.lit(f" {w} ")), 1)).alias(f"c{i}") for i, w in enumerate(words)]).first()
    return dict(zip(words, counts))


def _word_at(words: Column, k: int, word: str):
    return lambda i: F.get(words, i - 1 + k) == word


def _named(label: str):
    return lambda s: F.struct(s.alias("s"), F.lit(label).alias("l"))


def _starts(words: Column, size: Column, phrase: list[str]) -> Column:
    """All places where the phrase's words stand consecutively."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.get(words, i - 1) == phrase[0])
    for k, w in enumerate(phrase[1:], 1):
        at = F.filter(at, _word_at(words, k, w))
    return F.transform(at, lambda i: (i - 1).cast("long"))


def _best_containment(words: Column, size: Column, tokens: list[str], need: int, width: int) -> Column:
    """The most of the template's tokens in any block that holds a prefix token; tokens rarest first."""
    prefix = tokens[: len(tokens) - need + 1]
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.array_contains(_array(prefix), F.get(words, i)))
    last = F.greatest(size - width, F.lit(0))  # where the last block begins
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - width + 1, F.lit(0)), F.least(p, last)))))

    def shared(s: Column) -> Column:
        return F.size(F.array_intersect(_array(tokens), F.slice(words, s + 1, F.lit(width))))

    return F.coalesce(F.array_max(F.transform(starts, shared)), F.lit(0))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: the key, words, base finds and labels, and the score.

    ``template_hits`` holds, for each template that reaches the threshold, its label and containment.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    lines = docs.select(column(key).alias("_key"), spaced(column(text)).alias("_line"))
    sets = [(label, list(dict.fromkeys(words)), len(words)) for label, words in ((label, template_words(content)) for label, content in templates) if words]
    often = word_frequencies(lines, sorted({w for _, words, _ in sets for w in words}))

    size = (F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) - 1).cast("int")
    rows = lines.withColumn("_size", size)
    split = F.split(F.substring("_line", 2, 2147483647), " ")  # has an empty last entry, beyond _size

    # Templates are tried only where one of their prefix words is, whole texts only where any is.
    plans = []
    for label, words, width in sets:
        need = math.ceil(threshold * len(words) - 1e-9)
        tokens = sorted(words, key=lambda w: (often[w], w))
        plans.append((label, tokens, need, tokens[: len(tokens) - need + 1], width))
    holds = lambda w: F.contains("_line", F.lit(f" {w} "))
    maybe = F.lit(False)
    for _, _, need, prefix, _ in plans:
        here = F.lit(False)
        for w in prefix:
            here = here | holds(w)
        maybe = maybe | (here & (F.col("_size") >= need))
    for phrase in phrases:
        maybe = maybe | holds(" ".join(template_words(phrase)))
    rows = rows.withColumn("_maybe", maybe)
    # One of the arrays below would be built several times over; the words are split once.
    rows = rows.withColumn("_words", F.when(F.col("_maybe"), split)).drop("_line")

    found = [(label, template_words(phrase)) for phrase, label in phrases.items()]
    base = F.array_sort(F.flatten(F.array(*[F.transform(_starts(F.col("_words"), F.col("_size"), ws), _named(label)) for label, ws in found])))
    hits = F.array(*[F.struct(F.lit(label).alias("label"), (_best_containment(F.col("_words"), F.col("_size"), tokens, need, width) / F.lit(float(len(tokens)))).alias("c"), F.lit(need / len(tokens)).alias("t")) for label, tokens, need, _, width in plans])
    rows = rows.withColumn("_base", F.when(F.col("_maybe"), base)).withColumn("_hits", F.when(F.col("_maybe"), hits))
    matched = F.filter("_hits", lambda h: h["c"] >= h["t"] - 1e-12)
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["l"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("_base", lambda b: b["l"]), F.transform(matched, lambda h: h["label"]))))
    score = F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.array_max(F.transform("_hits", lambda h: h["c"])))
    return rows.select(
        F.col("_key").alias(key),
        F.col("_size").cast("long").alias("n_words"),
        F.coalesce(F.when(F.col("_maybe"), F.size("_base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["s"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["s"])).alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(F.when(F.col("_maybe"), score), F.lit(0.0)).alias("score"),
        F.coalesce(F.when(F.col("_maybe"), F.transform(matched, lambda h: F.struct(h["label"].alias("label"), h["c"].alias("containment")))), F.array()).alias("template_hits"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("template_hits")

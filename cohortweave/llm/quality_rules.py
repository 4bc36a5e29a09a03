"""Quality rules whose cutoffs come with a guarantee (operator 8).

Every document gets counts and, from them, a few shares between 0 and 1000 (per mille). A rule
rejects a document whose share lies above a cutoff. Cutoffs are chosen per stratum from labelled
documents, none of which was used for anything else, so all of them are a holdout:

* A rule walks its fixed grid of cutoffs from the loosest on. Each step tests the hypothesis
  "more than ``alpha / rules`` of the good documents of this stratum are rejected" by the exact
  binomial tail, and the walk ends with the first step that is not significant. As all steps
  before were, testing in this fixed order needs no further correction (learn then test).
* Rules and strata share the error ``delta`` equally (Bonferroni). So with probability
  ``1 - delta`` no stratum loses more than ``alpha`` of its good documents.
* Among the certified cutoffs the one is used that gains most: the share of bad documents
  rejected less ``cost`` times that of good ones. Without a gain the rule rejects nothing.

A stratum with too few labels to certify anything has no cutoffs, and keeps its documents.

Whole texts are read, by numpy in Arrow batches. Labels meet the counts by a join, are reduced to
one row per stratum, rule and cutoff before they shuffle, and each stratum (at most rules x 1001
rows, whatever the input) is decided in a task of its own.

Edge cases: a null text has no words and counts 0 throughout. Null strata form a stratum of their
own. Labels that are null are ignored, as are ids labelled both ways. Repeated rows are judged
alike. An empty table gives an empty result; without labels nothing but the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.llm import wordspans
from cohortweave.llm.rowmaps import PART_BYTES, add_columns, column, free_name
from cohortweave.operators.shared import written

WINDOW = 8  # words of a window whose repetition counts
GRID = 1000  # shares are per mille

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_distinct")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True

#: Name and share of each rule; a larger share is worse.
RULES: dict[str, str] = {
    "symbols": "n_symbols / word_chars",
    "capitals": "n_capitals / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "few_words": "(n_words - n_distinct) / n_words",
}


@dataclass(frozen=True)
class RuleSettings:
    alpha: float = 0.05  # good documents a stratum may lose, as a share
    delta: float = 0.05  # chance that the promise fails anywhere
    cost: float = 10.0  # what a rejected good document weighs against a bad one
    min_words: int = 20
    max_repeat_percent: int = 30


def _distinct_per_text(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each text."""
    if not len(hashes):
        return np.zeros(n, dtype=np.int64)
    both = wordspans.mix(hashes + owner.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    _, first = np.unique(both, return_index=True)
    return np.bincount(owner[first], minlength=n)


def _repeated_words(found: wordspans.Words, n: int) -> np.ndarray:
    """Words inside windows that occur twice or more in their text."""
    hashes, first = wordspans.windows(found, WINDOW)
    if not len(hashes):
        return np.zeros(n, dtype=np.int64)
    owner = found.owner()
    both = wordspans.mix(hashes + owner[first].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    twice = np.zeros(len(both), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(owner) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    return wordspans.per_text(np.cumsum(cover)[: len(owner)] > 0, found.before)


def _chunk_counts(texts: wordspans.Texts) -> dict[str, np.ndarray]:
    n = len(texts)
    data = texts.data
    found = wordspans.words(texts)
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    solid = ~space[data]
    point = (data & 0xC0) != 0x80
    line_start, line_end = wordspans.spans(data != 10, texts.bounds)
    solid_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(solid, out=solid_before[1:])
    full = solid_before[line_end] > solid_before[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_owner = np.searchsorted(texts.bounds, line_start, side="right") - 1
    n_lines = np.bincount(line_owner, minlength=n)
    return {
        "n_words": found.counts(),
        "word_chars": wordspans.per_text(solid & point, texts.bounds),
        "n_symbols": wordspans.per_text(_SYMBOL[data], texts.bounds),
        "n_dup_lines": n_lines - _distinct_per_text(line_owner, wordspans.span_hashes(data, line_start, line_end), n),
        "n_repeat_words": _repeated_words(found, n),
        "n_capitals": wordspans.per_text(_CAPITAL[data], texts.bounds),
        "n_lines": n_lines,
        "n_distinct": _distinct_per_text(found.owner(), found.hashes, n),
    }


def count_texts(texts: pa.Array) -> dict[str, pa.Array]:
    """The counts of every text of an Arrow array."""
    parts = [_chunk_counts(chunk) for _, chunk in wordspans.chunks(wordspans.of_array(texts))]
    none = np.empty(0, dtype=np.int64)
    return {c: pa.array(np.concatenate([p[c] for p in parts] or [none]).astype(np.int64)) for c in COUNTS}


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns kept (all by default) and the counts of the whole text."""
    return add_columns(docs, text, count_texts, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), keep)


def base_failed(settings: RuleSettings) -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < settings.min_words) | (100 * repeated > settings.max_repeat_percent * words)


def share(rule: str) -> Column:
    """Per mille of a rule, from 0 to 1000; 0 where there is nothing to divide by."""
    over, under = RULES[rule].rsplit(" / ", 1)
    return F.expr(f"CAST(coalesce(least(greatest(floor({GRID} * ({over}) / nullif({under}, 0)), 0), {GRID}), 0) AS INT)")


def agreed_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One 0 or 1 per id, for ids that are not labelled both ways."""
    grouped = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key)
    both = grouped.agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    return both.where("_low = _high").select(F.col(key).alias("_id"), F.col("_low").cast("int").alias("_good"))


def tail_bound(n: int, alpha: float, delta: float) -> int:
    """The most rejected among ``n`` with which "a share over alpha" is still refuted, or -1.

    The greatest k with P(Binomial(n, alpha) <= k) <= delta. The tail rises with k, so that all
    cutoffs up to the first that fails are those with at most k rejected.
    """
    if n == 0:
        return -1
    log_ratio = np.log(alpha) - np.log1p(-alpha)
    log_term, total, k = n * np.log1p(-alpha), 0.0, -1
    for i in range(n + 1):
        total += float(np.exp(log_term))
        if total > delta:
            return k
        k = i
        log_term += np.log(n - i) - np.log(i + 1) + log_ratio if i < n else 0.0
    return k


CUTOFF_SCHEMA = "stratum string, rule string, cutoff int, n_good long, n_bad long, good_rejected long, bad_rejected long"


def _decide(frame: pd.DataFrame, alpha: float, delta: float, cost: float) -> pd.DataFrame:
    """Cutoffs of one stratum from its counts by rule and share."""
    rows = []
    for rule, part in frame.groupby("rule"):
        good, bad = np.zeros(GRID + 1, dtype=np.int64), np.zeros(GRID + 1, dtype=np.int64)
        np.add.at(good, part["share"].to_numpy(), part["good"].to_numpy())
        np.add.at(bad, part["share"].to_numpy(), part["bad"].to_numpy())
        n_good, n_bad = int(good.sum()), int(bad.sum())
        # Rejected where the share is above the cutoff; cutoffs from the loosest (GRID) down.
        good_above = n_good - np.cumsum(good)
        bad_above = n_bad - np.cumsum(bad)
        certified = good_above <= tail_bound(n_good, alpha, delta)
        gain = bad_above / max(n_bad, 1) - cost * good_above / max(n_good, 1)
        gain[~certified] = -np.inf
        best = GRID - int(np.argmax(gain[::-1]))  # the loosest of equals
        if gain[best] <= 0:
            best = GRID
        rows.append((frame["stratum"].iloc[0], rule, best, n_good, n_bad, int(good_above[best]), int(bad_above[best])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CUTOFF_SCHEMA.split(", ")])


def fit_cutoffs(
    counts: DataFrame, labels: DataFrame, key: str, stratum: str, label: str, settings: RuleSettings = RuleSettings()
) -> DataFrame:
    """One row per labelled stratum and rule: its cutoff and the counts behind it.

    ``counts`` as ``text_counts`` gives them. Documents that fail the base rule are not asked.
    """
    asked = counts.where(~base_failed(settings) & column(key).isNotNull())
    rows = asked.select(column(key).alias("_id"), column(stratum).cast("string").alias("stratum"), *COUNTS)
    known = rows.join(agreed_labels(labels, key, label), "_id")
    shares = ", ".join(f"'{rule}', _s{i}" for i, rule in enumerate(RULES))
    table = (
        known.select("stratum", "_good", *[share(rule).alias(f"_s{i}") for i, rule in enumerate(RULES)])
        .selectExpr("stratum", "_good", f"stack({len(RULES)}, {shares}) AS (rule, share)")
        .groupBy("stratum", "rule", "share")
        .agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad"))
    )
    table = written(table, "rule-shares", batch_bytes=PART_BYTES)
    strata = max(table.select(F.count_distinct(F.coalesce("stratum", F.lit(""))) + F.max(F.col("stratum").isNull().cast("int"))).first()[0] or 1, 1)
    alpha, delta = settings.alpha / len(RULES), settings.delta / (len(RULES) * strata)
    cost = settings.cost
    return table.groupBy("stratum").applyInPandas(lambda frame: _decide(frame, alpha, delta, cost), CUTOFF_SCHEMA)


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (comma-joined) and ``kept``.

    The cutoffs are one row per labelled stratum; the planner broadcasts them if they are small,
    and splits a hot stratum if not.
    """
    limits = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    limits = limits.select(F.col("stratum").alias("_stratum"), *[column(r).alias(f"_cut_{r}") for r in RULES])
    joined = counts.join(limits, column(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
    above = [F.when(share(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in RULES]
    return (
        joined.withColumn("base_failed", base_failed(settings))
        .withColumn("failed_rules", F.concat_ws(",", *above))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
        .drop("_stratum", *[f"_cut_{r}" for r in RULES])
    )


def judged_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    label: str = "quality", settings: RuleSettings = RuleSettings(),
) -> DataFrame:
    """Counts and verdict of every document. The counts are written once; texts are read once."""
    counts = written(text_counts(docs, text, [key, stratum]), "rule-counts", batch_bytes=PART_BYTES)
    return judge(counts, fit_cutoffs(counts, labels, key, stratum, label, settings), stratum, settings)


def kept_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    label: str = "quality", settings: RuleSettings = RuleSettings(),
) -> DataFrame:
    """The rows that pass, with their own columns.

    Texts are read twice, once for the cutoffs and once for the verdict, so that they never shuffle.
    """
    names = {c: free_name(docs, f"_doc{i}") for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[column(c).alias(n) for c, n in names.items()])
    known = text_counts(docs, text, [key, stratum])
    cutoffs = written(fit_cutoffs(known, labels, key, stratum, label, settings), "rule-cutoffs")
    verdict = judge(text_counts(renamed, names[text]), cutoffs, names[stratum], settings)
    return verdict.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = judged_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "failed_rules", *COUNTS[5:])

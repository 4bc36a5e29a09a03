"""Quality scores by a generalised additive model with pairwise interactions (operator 2).

Each feature of a text is put into one of at most ``BINS`` bins. The model is an intercept and one table per
feature, and one per chosen pair of features; a text's log-odds are the entries of its bins added up.
Tables are learned by cyclic boosting: round after round, each feature in turn gets a shallow tree
(at most ``LEAVES`` leaves over its bins) fitted to the gradient that all tables so far leave, shrunk by
``RATE``, and added to its table. Then the same is done for the ``PAIRS`` pairs whose best cut into
four explains most of what is left, with the single tables held.

Features come from whole texts by numpy in Arrow batches and are written once, a narrow table. The
model is fitted on at most ``SAMPLE_ROWS`` labelled rows (those of the least hash of their id); bins are
quantiles of these. Everything else covers all rows, and scoring is one vectorised lookup per
table. Only text is looked at: no labels, languages, sources or ids.

Edge cases: null and empty texts have features of 0 and get a score as any text. Ids labelled both
ways, null labels and null ids are not learned from. With labels of one kind only, or none, all scores are the
(smoothed) share of label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.llm import wordspans
from cohortweave.llm.backoff_scoring import held_out
from cohortweave.llm.quality_rules import agreed_labels, count_texts
from cohortweave.llm.rowmaps import add_columns, bounded_sample, column
from cohortweave.operators.shared import written

BINS = 32
LEAVES = 4
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
RIDGE = 1.0
SAMPLE_ROWS = 20_000
CUTOFF = 0.3

FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "repeated_lines", "repeated_words", "distinct_words",
    "words_per_line", "digits", "punctuation", "beyond_ascii",
)

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b"!?.,;:\"'()-/")] = True


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text of an Arrow array."""
    counts = {k: v.to_numpy(zero_copy_only=False).astype(np.float64) for k, v in count_texts(texts).items()}
    parts = wordspans.of_array(texts)
    classes = {"digits": _DIGIT, "punctuation": _POINT, "beyond_ascii": np.arange(256) >= 0xC0}
    found = {name: [] for name in classes}
    for _, chunk in wordspans.chunks(parts):
        for name, inside in classes.items():
            found[name].append(wordspans.per_text(inside[chunk.data], chunk.bounds))
    extra = {name: np.concatenate(v or [np.empty(0)]).astype(np.float64) for name, v in found.items()}
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    lines = np.maximum(counts["n_lines"], 1)
    columns = [
        np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / chars, counts["n_capitals"] / chars,
        counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words,
        # Different words for the length: the number falls below a text's length as a power of it.
        np.log1p(counts["n_distinct"]) / np.maximum(np.log1p(counts["n_words"]), 1e-9),
        np.log1p(counts["n_words"] / lines), extra["digits"] / chars, extra["punctuation"] / chars, extra["beyond_ascii"] / chars,
    ]
    return np.stack(columns, axis=1) if len(words) else np.empty((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for table, at in zip(self.tables, b):
            total += table[at]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[i], b[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins low to high - 1; place is the first bin of the upper part."""
    if high - low < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    gt, ht = g[low:high].sum(), h[low:high].sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    best = int(np.argmax(gain))
    return float(gain[best]), low + best + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values of the bins under the greedy tree on sums of gradients and curvatures."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, which = max((*_cut(g, h, *part), i) for i, part in enumerate(parts))
        if gain <= 1e-9:
            break
        low, high = parts.pop(which)
        parts += [(low, at), (at, high)]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return out


def shallow_plane(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over two features' bins: the best cut of one, and of the other on either side; and the gain."""
    best_gain, best = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        # Every cut of the rows, with the best cut of the columns above and below it.
        ga, ha = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for at in range(1, len(a)):
            values, gain = np.zeros_like(a), -(ga[-1].sum() ** 2) / (ha[-1].sum() + RIDGE)
            for low, high, gs, hs in ((0, at, ga[at - 1], ha[at - 1]), (at, len(a), ga[-1] - ga[at - 1], ha[-1] - ha[at - 1])):
                tree = shallow_tree(gs, hs, 2)
                values[low:high] = tree
                gain += float((2 * gs * tree - (hs + RIDGE / len(hs)) * tree**2).sum())
            if gain > best_gain:
                best_gain, best = gain, values.T if flip else values
    return best, best_gain


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of labelled rows."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b[j], g, len(table)), np.bincount(b[j], h, len(table)))
            table += step
            total += step[b[j]]

    def plane(i: int, j: int) -> tuple[np.ndarray, float, np.ndarray]:
        g, h = slopes()
        size = (len(model.tables[i]), len(model.tables[j]))
        flat = b[i] * size[1] + b[j]
        values, gain = shallow_plane(np.bincount(flat, g, size[0] * size[1]).reshape(size), np.bincount(flat, h, size[0] * size[1]).reshape(size))
        return values, gain, flat

    gains = sorted(((plane(i, j)[1], i, j) for i, j in combinations(range(len(FEATURES)), 2)), reverse=True)
    for _, i, j in gains[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            values, _, flat = plane(i, j)
            table += RATE * values
            total += RATE * values.ravel()[flat]
    return model


def with_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def make(texts: pa.Array) -> dict[str, pa.Array]:
        x = text_features(texts)
        return {"_features": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))}

    return add_columns(docs, text, make, T.StructType([T.StructField("_features", T.ArrayType(T.DoubleType()))]), keep)


def fit(features: DataFrame, labels: DataFrame, key: str, label: str, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model from a table of features and a table of labels; at most ``sample_rows`` reach the driver."""
    known = features.where(column(key).isNotNull()).select(column(key).alias("_id"), "_features").join(agreed_labels(labels, key, label), "_id")
    sample = bounded_sample(known, "_id", sample_rows).select("_features", "_good").toPandas()
    x = np.array(sample["_features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_tables(x, sample["_good"].to_numpy(dtype=np.float64))


def scored(features: DataFrame, model: AdditiveModel, keep: list[str]) -> DataFrame:
    """The columns kept and ``score``. The model is a few thousand numbers, sent with the task."""
    source = features.select("_features", *[column(c).alias(f"_k{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(x))], [f"_k{i}" for i in range(len(keep))] + ["score"])

    types = "".join(f"_k{i} {features.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = source.mapInArrow(run, f"{types}score double")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "score")


def op2_additive_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    features = written(with_features(docs, "text", ["doc_id"]), "features").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = fit(features.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    return scored(features, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))

"""Document rates whose expected domain totals match target weights (operator 10).

Domains are known for labelled documents only. A naive Bayes classifier (presence and absence of lexicon words) learned from them gives
every document a posterior over the domains (soft membership). Document d with ``n_d`` tokens and
posterior ``p_d`` adds ``rate_d * n_d * p_dk`` expected tokens to domain k. Rates minimise

    1/2 sum_k (A_k - target_k)^2 / N_k,   A_k = sum_d rate_d n_d p_dk,   0 <= rate_d <= max_rate

by accelerated projected gradient steps from rate 1 (each gradient is taken a little ahead, in the
direction of the last step); ``N_k`` are the totals at rate 1. In the metric that
weighs a document by its tokens the gradient is ``sum_k p_dk (A_k - target_k) / N_k``, its
Lipschitz constant is at most 1 (a product of two row-stochastic matrices), so steps of 1 need no
search. A step is one aggregate of as many sums as there are domains. The rate follows from the
posterior and the list of residuals so far, so no rates are stored between steps; documents with
equal posteriors (kept in per mille) share their rate and are added up once, before the first step.

Only DataFrame functions are used. What reaches the driver is bounded by parameters: the lexicon
(``LEXICON`` words), the class tables, and one number per domain and step. The classifier is
fitted on at most ``SAMPLE_ROWS`` labelled rows, those of the least hash of their id; all else
covers every document. Features: the presence of lexicon words (those with most information on the
domain; how common they may be is chosen by a fifth of the sample held out), and two shares in classes (symbols, capitals).

Edge cases: a null or empty text has 0 tokens and the posterior its emptiness suggests. Without
labels all posteriors are uniform. Ids labelled with two domains are ignored. Targets of domains
nobody has are 0 in effect. Repeated rows count as often as they occur; empty tables stay empty.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.rowmaps import bounded_sample, column, free_name
from cohortweave.operators.shared import written

LEXICON = 96
SAMPLE_ROWS = 20_000
LEAST_GAIN = 15.0  # nats of the whole sample; half the statistic of a G-test, which chance reaches in one of a million words
LEAST_ODDS = 2.0  # log-odds between domains; weaker words go together (as those of a language do) and would count twice
COMMON = 0.1  # share of texts a lexicon word may be in; commoner ones often tell the length and language of a text
WIDER = (0.2, 0.4, 1.0)  # shares tried as well; the one that tells held-out labelled texts best is taken
FOLDS = 5
STEPS = 400  # a limit; steps end at the targets or at the optimum, and a warning says where they do not
TOLERANCE = 1e-4  # of the greatest residual against the total
MILLE = 1000

_SPACE = r"[\x09-\x0D\x20]+"
_SHAPES = {"symbols": r"[^#*$%&|<>]+", "capitals": r"[^A-Z]+"}  # what is taken out before the rest is counted
_BINS = 11


@dataclass(frozen=True)
class DomainModel:
    """Log-probabilities by domain; ``words`` maps a lexicon word to what its presence adds in each."""

    domains: list[str]
    priors: list[float]
    absent: list[float] = field(default_factory=list)  # of a text without any lexicon word
    words: dict[str, list[float]] = field(default_factory=dict)
    shapes: dict[str, list[list[float]]] = field(default_factory=dict)  # by class of the share


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")


def _shape(text: Column, name: str) -> Column:
    """Class of a share: 0 for none, then twentieths, at most ``_BINS - 1``."""
    rest = F.length(F.regexp_replace(text, _SHAPES[name], ""))
    twentieths = F.floor(F.lit(20) * rest / F.greatest(F.length(text), F.lit(1)))
    return F.when(rest == 0, F.lit(0)).otherwise(F.least(twentieths + 1, F.lit(_BINS - 1))).cast("int")


def _text(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain",
    sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON,
) -> DomainModel:
    """The classifier from a table of ids and domains."""
    known = labelled.where(column(domain).isin(domains) & column(key).isNotNull()).groupBy(column(key).alias("_id"))
    known = known.agg(F.min(column(domain)).alias("_domain"), F.max(column(domain)).alias("_other")).where("_domain = _other")
    sample = bounded_sample(known.select("_id", "_domain"), "_id", sample_rows)
    rows = docs.select(column(key).alias("_id"), _text(text).alias("_text")).join(F.broadcast(sample), "_id")  # bounded by sample_rows
    fold = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).alias("_fold")
    rows = rows.select("_domain", fold, F.array_distinct(_words(F.col("_text"))).alias("_words"), *[_shape(F.col("_text"), s).alias(s) for s in _SHAPES])
    rows = written(rows, "mix-sample")
    shares = [COMMON, *[c for c in WIDER if c > COMMON]]
    tried = [_fitted(rows.where("_fold > 0"), domains, lexicon, share) for share in shares]
    aside = rows.where("_fold = 0")
    told = [F.avg(F.exp(_told(model, domains))) for model in tried]  # the share that mixing would put where it belongs
    told = [v for v in aside.agg(*told).first() if v is not None] if all(m.shapes for m in tried) else []
    best = max(range(len(told)), key=lambda i: (told[i], -i)) if told else 0
    return _fitted(rows, domains, lexicon, shares[best])


def _told(model: DomainModel, domains: list[str]) -> Column:
    """Log-probability of a sample row's own domain."""
    log = _logs(model, F.col("_words"), {s: F.col(s) for s in _SHAPES})
    own = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i)]), F.col("_domain"))
    return F.transform(F.array(log), lambda l: F.get(l, own) - F.array_max(l) - F.log(F.aggregate(F.transform(l, lambda v: F.exp(v - F.array_max(l))), F.lit(0.0), lambda a, b: a + b)))[0]


def _fitted(rows: DataFrame, domains: list[str], lexicon: int, common: float) -> DomainModel:
    """The classifier of sample rows, with words that are in at most a share ``common`` of them."""
    sizes = {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().collect()}  # a row per domain
    total = sum(sizes.values())
    k = len(domains)
    if not total:
        return DomainModel(domains, [0.0] * k)
    n = [sizes.get(d, 0) for d in domains]
    priors = [math.log((c + 1) / (total + k)) for c in n]

    by_word = rows.select("_domain", F.explode("_words").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("df"), *[F.count(F.when(F.col("_domain") == d, 1)).alias(f"d{i}") for i, d in enumerate(domains)]
    )
    odds = [f"ln((d{i} + df / {total}D) / {n[i] + 1}D)" for i in range(k)]  # smoothed by the word's share of all
    without = [f"ln(({n[i] + 1}D - d{i} - df / {total}D) / {n[i] + 1}D)" for i in range(k)]
    mean = f"({' + '.join(odds)}) / {k}D"
    # Information of presence: expected log-odds of the domain against its prior.
    gain = " + ".join(f"(d{i} * ln(greatest(d{i}, 1) * {total}D / (df * {max(n[i], 1)}D)) + ({n[i]} - d{i}) * ln(greatest({n[i]} - d{i}, 1) * {total}D / (greatest({total} - df, 1) * {max(n[i], 1)}D)))" for i in range(k))
    o = F.expr(f"array({', '.join(f'{x} - {mean}' for x in odds)})")
    less = F.expr(f"array({', '.join(without)})")
    telling = (F.col("gain") >= LEAST_GAIN) & (F.array_max("o") - F.array_min("o") >= LEAST_ODDS)
    best = by_word.withColumn("gain", F.expr(gain)).withColumn("o", o).withColumn("less", less).where(telling & (F.col("df") <= common * total)).orderBy(F.desc("gain"), "w").limit(lexicon)
    chosen = best.select("w", "o", "less").collect()  # at most ``lexicon`` rows
    words = {r["w"]: [a - b for a, b in zip(r["o"], r["less"])] for r in chosen}
    absent = [sum(r["less"][i] for r in chosen) for i in range(k)]

    shapes: dict[str, list[list[float]]] = {}
    for s in _SHAPES:  # at most _BINS rows per domain
        seen = {(r["_domain"], r[s]): r["count"] for r in rows.groupBy("_domain", s).count().collect()}
        shapes[s] = [[math.log((seen.get((d, b), 0) + sum(seen.get((e, b), 0) for e in domains) / total) / (n[i] + 1)) if any((e, b) in seen for e in domains) else 0.0 for i, d in enumerate(domains)] for b in range(_BINS)]
    return DomainModel(domains, priors, absent, words, shapes)


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _logs(model: DomainModel, words: Column, shapes: dict[str, Column]) -> Column:
    """Log-probabilities by domain, up to a constant."""
    parts = [_doubles(model.priors)]
    for s, rows in model.shapes.items():
        parts.append(F.element_at(F.array(*[_doubles(r) for r in rows]), shapes[s] + 1))
    if model.words:
        lexicon = F.array(*[F.lit(w) for w in model.words])
        weights = F.create_map(*[x for w, o in model.words.items() for x in (F.lit(w), _doubles(o))])
        found = F.array_intersect(words, lexicon)
        parts.append(_doubles(model.absent))
        parts.append(F.aggregate(found, _doubles([0.0] * len(model.domains)), lambda s, w: F.zip_with(s, F.element_at(weights, w), lambda a, b: a + b)))
    log = parts[0]
    for part in parts[1:]:
        log = F.zip_with(log, part, lambda a, b: a + b)
    return log


def posterior(model: DomainModel, text: Column) -> Column:
    """Posteriors of a text in per mille, an int per domain; the last one takes what is left of 1000."""
    log = _logs(model, _words(text), {s: _shape(text, s) for s in _SHAPES})
    weight = F.transform(F.array(log), lambda l: F.transform(l, lambda v: F.exp(v - F.array_max(l))))[0]
    mille = F.transform(
        F.array(weight), lambda w: F.transform(w, lambda v: F.floor(F.lit(MILLE) * v / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)).cast("int"))
    )[0]
    k = len(model.domains)
    short = lambda p: F.lit(MILLE) - F.aggregate(p, F.lit(0), lambda a, b: a + b)
    # What rounding down leaves over goes to the likeliest domain.
    return F.transform(F.array(mille), lambda p: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.element_at(p, i) + F.when(F.array_position(p, F.array_max(p)) == i, short(p)).otherwise(0)))[0]


def described(docs: DataFrame, model: DomainModel, text: str, tokens: str, mille: str) -> DataFrame:
    """Adds the number of tokens (words) and the posterior; rows stay where they are."""
    return docs.withColumns({tokens: F.size(_words(_text(text))).cast("long"), mille: posterior(model, _text(text))})


def _after(mille: Column, residuals: list[list[float]], max_rate: float, anchor: int | None = None) -> Column:
    """``r`` (the rate after the steps), ``y`` (where the next gradient is taken) and ``d`` (how far the last step went from there) of a posterior."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"), F.lit(0.0).alias("d"))
    if not residuals:
        return start
    steps = F.array(*[F.struct(_doubles(r).alias("g"), F.lit(t / (t + 3.0)).alias("m")) for t, r in enumerate(residuals)])

    def step(s: Column, x: Column) -> Column:
        slope = F.aggregate(F.zip_with(mille, x["g"], lambda p, g: p * g), F.lit(0.0), lambda a, b: a + b) / MILLE
        r = F.least(F.greatest(s["y"] - slope, F.lit(0.0)), F.lit(float(max_rate)))
        return F.struct(r.alias("r"), (r + x["m"] * (r - s["r"])).alias("y"), F.abs(r - s["y"]).alias("d"))

    moved = F.aggregate(steps, start, step)
    return moved if anchor is None else F.when(F.get(mille, F.lit(anchor)) >= F.array_max(mille), start).otherwise(moved)


def rate(mille: Column, residuals: list[list[float]], max_rate: float, anchor: int | None = None) -> Column:
    """The rate of a posterior after the steps taken so far: a step and a projection per residual.

    Posteriors whose likeliest domain is the anchor keep rate 1.
    """
    return _after(mille, residuals, max_rate, anchor)["r"]


@dataclass(frozen=True)
class Mix:
    residuals: list[list[float]]
    available: list[float]
    targets: list[float]
    reached: list[float]
    moved: float = 0.0  # mean way of the last step, 0 at the optimum (the KKT condition)
    met: bool = True  # whether the targets or the optimum were reached within the tolerance


def solve(groups: DataFrame, weights: list[float], max_rate: float, anchor: int | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> Mix:
    """Residuals of the steps; ``groups``: ``mille, tokens``, written and of one row per posterior.

    Targets are ``weights`` (in proportion) of all tokens, or, with an ``anchor``, of so many that
    the anchor domain's target is what it has; documents likeliest of the anchor then stay at rate 1.
    """
    k = len(weights)

    def totals(residuals: list[list[float]]) -> tuple[list[float], list[float], float]:
        """Domain totals at the rates, and at the points of the next gradient; the mean way of the last step."""
        placed = groups.select("mille", "tokens", _after(F.col("mille"), residuals, max_rate, anchor).alias("_s"))
        sums = [F.sum(F.col(f"_s.{at}") * F.col("tokens") * F.col("mille")[i] / MILLE) for at in ("r", "y") for i in range(k)]
        way = F.sum(F.col("_s.d") * F.col("tokens")) / F.greatest(F.sum("tokens"), F.lit(1))
        row = [float(v or 0.0) for v in placed.agg(*sums, way).first()]
        return row[:k], row[k : 2 * k], row[-1]

    available, ahead, moved = totals([])
    scale = sum(available) if anchor is None else available[anchor] * sum(weights) / weights[anchor]
    targets = [scale * w / sum(weights) for w in weights]
    residuals: list[list[float]] = []
    reached = available
    near = lambda: max(abs(a - t) for a, t in zip(reached, targets)) <= tolerance * max(sum(targets), 1.0)
    met = near()
    while not met and len(residuals) < steps:
        residuals.append([(a - t) / n if n else 0.0 for a, t, n in zip(ahead, targets, available)])
        reached, ahead, moved = totals(residuals)
        # A gradient step that goes nowhere: targets are out of reach, and this is as near as rates come.
        met = near() or moved <= tolerance
    if not met:
        warnings.warn(f"rates are not at their optimum after {steps} steps: the last went {moved:.2g}", stacklevel=2)
    return Mix(residuals, available, targets, reached, moved, met)


def mixed(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain",
    max_rate: float = 4.0, anchor: str | None = None,
) -> tuple[DataFrame, DomainModel, Mix]:
    """Tokens, posterior and rate of every row (``key, n_tokens, mille, rate``), the classifier and the solution."""
    domains = list(weights)
    model = fit_domains(docs, labelled, domains, key, text, domain)
    narrow = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    rows = written(described(narrow, model, "_text", "n_tokens", "mille").drop("_text"), "mix-posteriors")
    groups = written(rows.groupBy("mille").agg(F.sum("n_tokens").alias("tokens")), "mix-groups")
    held = domains.index(anchor) if anchor else None
    found = solve(groups, list(weights.values()), max_rate, held)
    return rows.withColumn("rate", rate(F.col("mille"), found.residuals, max_rate, held)).withColumnRenamed("_key", key), model, found


def thinned(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, key: str = "doc_id", text: str = "text",
    domain: str = "domain", seed: int = 0,
) -> DataFrame:
    """Rows drawn at their rates, with rates up to 1 and the anchor domain's total as it is.

    A row stays if the hash of its id, as a number from 0 to 1, is below its rate. Texts do not move.
    """
    rows, model, found = mixed(docs, labelled, weights, key, text, domain, 1.0, anchor)
    mille = free_name(docs, "_mille")
    drawn = F.pmod(F.xxhash64(column(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    judged = docs.withColumn(mille, posterior(model, _text(text)))
    return judged.where(drawn < rate(F.col(mille), found.residuals, 1.0, list(weights).index(anchor))).drop(mille)


DOMAIN_WEIGHTS = {"good": 0.95, "poor": 0.03, "toxic": 0.02}


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """Domains of the table ``labels``: poor by quality, toxic by toxicity, else good."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").alias("domain"),
    )


def op10_soft_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labelled = domains_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, model, _ = mixed(docs, labelled, DOMAIN_WEIGHTS)
    shares = [(F.col("mille")[i] / MILLE).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rows.select("doc_id", "n_tokens", *shares, "rate")

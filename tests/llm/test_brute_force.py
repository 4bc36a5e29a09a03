"""Operators against plain Python on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortweave.llm import bpe, license_scan, packing, quality_rules, secrets_scan, token_files, wordspans
from cohortweave.llm.registry import ORACLES, QUERIES
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    frame = pd.read_parquet(f"{SF_SMALL}/documents.parquet").sort_values("doc_id")
    return dict(zip(frame["doc_id"], frame["text"].fillna("")))


@pytest.fixture(scope="module")
def result(spark):
    made: dict[str, pd.DataFrame] = {}

    def of(name):
        if name not in made:
            made[name] = QUERIES[name](spark, SF_SMALL).toPandas()
        return made[name]

    return of


def shingles(text):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_every_query_is_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLES) <= set(QUERIES)


def test_op1_base_places(docs, result):
    for row in result("op1_license_scan").itertuples():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[row.doc_id].translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert places == [] or (row.first_word, row.last_word) == (min(places), max(places))
        assert labels <= set(row.labels.split(","))


def test_op1_finds_every_block(docs, result):
    for row in result("op1_license_scan").itertuples():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs[row.doc_id].translate(LOWER))
        labels = set(filter(None, row.base_labels.split(",")))
        for label, text in license_scan.TEMPLATES:
            wanted = set(license_scan.template_words(text))
            need = math.ceil(license_scan.THRESHOLD * len(wanted) - 1e-9)
            best = max((len(wanted & set(words[i : i + len(wanted)])) for i in range(len(words))), default=0)
            labels |= {label} if best >= need else set()
        assert row.labels == ",".join(sorted(labels))


def test_op1_copy_of_a_template_with_repeated_words(spark):
    text = " ".join(f"the w{i} of the v{i} and" for i in range(12))  # 72 words, 27 different
    docs = spark.createDataFrame([(1, f"some words before {text} and after"), (2, "the of and w1")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan(docs, templates=[("x", text)]).collect()}
    assert (rows[1]["labels"], rows[1]["score"], rows[2]["labels"]) == ("x", 1.0, "")


def test_op2_separates_held_out(result):
    labels = pd.read_parquet(f"{SF_SMALL}/labels.parquet")
    rows = result("op2_additive_quality")
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    known = rows.merge(labels, on="doc_id")
    good, bad = known.loc[known["quality"] == 1, "score"], known.loc[known["quality"] == 0, "score"]
    assert (np.subtract.outer(good.to_numpy(), bad.to_numpy()) > 0).mean() > 0.9


def test_op3_reads_back_what_the_library_gives(docs, result):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, rows = 0, result("op3_token_files").set_index("doc_id")
    for doc_id, text in docs.items():
        ids = np.array(tool.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        row = rows.loc[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_seekable_file():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50_000, n).astype("<u4") for n in (10, 1, 5_000, 77)]
    writer = token_files.SeekableWriter()
    for block in blocks:
        writer.add(block)
    file, whole = writer.finish(), np.concatenate(blocks)
    reader = token_files.SeekableReader(file)
    for first, count in ((0, 3), (9, 2), (11, 5_000), (0, len(whole)), (5_080, 8)):
        assert (np.concatenate(list(reader.read(first, count))) == whole[first : first + count]).all()
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == whole.tobytes()
    broken = bytearray(file)
    table = len(file) - 9 - 12 * len(blocks)
    broken[table + 8] ^= 1
    with pytest.raises(ValueError):
        list(token_files.SeekableReader(bytes(broken)).read(0, 3))


@pytest.mark.parametrize("text", ["", "it's he'll 'tis 'S ''s", " a\n\n b  \t", "<|endoftext|> x", "über 　 99½ x\x85y", "a" * 5_000, "\r\n \r\n"])
def test_ids_are_those_of_the_library(text):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encoder().ids(text) == tool.encode(text, add_special_tokens=False).ids


def test_op4_counts_and_base(docs, result):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    rows = result("op4_backoff_scoring")
    for row in rows.itertuples():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[row.doc_id])
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert (row.n_tokens, row.n_known) == (len(tokens[row.doc_id]), sum(counts[w] > 0 for w in tokens[row.doc_id]))
        assert (row.train_tokens, row.held_out) == (total, out[row.doc_id])
    assert rows.loc[rows["held_out"], "score"].sum() > rows.loc[rows["held_out"], "base_score"].sum()


def test_op4_probabilities_add_up(spark):
    from cohortweave.llm import backoff_scoring

    texts = ["a b c a b d", "a b c", "b c a a b c", "c c c", "a b"]
    model, _ = backoff_scoring.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    counts = Counter(w for t in texts for w in t.split())
    words = sorted(counts)
    for context in ([], ["a"], ["a", "b"], ["c", "c"], ["d", "a"]):
        mass = 0.0
        for w in [*words, None]:
            body = " ".join([*context, *([w] if w else [])]).encode()
            found = wordspans.words(wordspans.Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)])))
            ids, _ = model.tokens(found)
            rare = w is not None and ids[len(context) + 1] < 0  # its root arc is added by a join
            mass += 10 ** (model.score(ids)[len(context) + 1] + (model.root(counts[w]) if rare else 0.0))
        # One share of the add-one root is left for words nobody has seen.
        unseen = 1 / (model.total + model.distinct + 1)
        assert 1 - 20 * unseen <= mass <= 1 + 1e-9


def _plain_scores(texts, least, order=3):
    """Backoff scores by plain dictionaries, all n-grams seen ``least`` times kept."""
    lines = [["<s>", *WORD.findall(t.translate(LOWER)), None] for t in texts]
    counts = {n: Counter(tuple(x[i : i + n]) for x in lines for i in range(len(x) - n + 1)) for n in range(1, order + 1)}
    roots = {g[0]: c for g, c in counts[1].items() if g != ("<s>",)}
    total, distinct = sum(roots.values()), len(roots)
    arcs, fails = {1: {(w,): math.log10((c + 1) / (total + distinct + 1)) for w, c in roots.items()}}, {}
    for n in range(2, order + 1):
        met = Counter(counts[n].values())
        discount = met[1] / (met[1] + 2 * met[2]) if met[1] and met[2] else 0.5
        arcs[n] = {g: math.log10((c - discount) / counts[n - 1][g[:-1]]) for g, c in counts[n].items() if c >= least}
        left, below = Counter(), Counter()
        for g, a in arcs[n].items():
            left[g[:-1]] += 10**a
            below[g[:-1]] += 10 ** arcs[n - 1][g[1:]]
        fails |= {h: math.log10(max(1 - left[h], 1e-9) / max(1 - below[h], 1e-9)) for h in left}

    def p(g):
        if g in arcs[len(g)]:
            return arcs[len(g)][g]
        return math.log10(1 / (total + distinct + 1)) if len(g) == 1 else fails.get(g[:-1], 0.0) + p(g[1:])

    return [sum(p(tuple(x[max(0, i - order + 1) : i + 1])) for i in range(1, len(x))) for x in lines]


def test_op4_scores_do_not_depend_on_the_cache(spark, docs):
    from cohortweave.llm import backoff_scoring

    texts = [t for t in list(docs.values())[:150]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = _plain_scores(texts, backoff_scoring.LEAST)
    for keep in (5e-7, 1e-3, 0.5):  # a corpus so large that this share is many occurrences
        model, tables = backoff_scoring.fit(table, keep=keep)
        rows = {r["doc_id"]: r["score"] for r in backoff_scoring.score(table, model, tables).collect()}
        assert [rows[i] for i in range(len(texts))] == pytest.approx(wanted, rel=1e-6, abs=1e-6)


def test_op5_pieces(docs, result):
    tool = bpe.encoder()
    rows = result("op5_harmonic_packing").sort_values(["doc_id", "start"])
    for doc_id, part in rows.groupby("doc_id"):
        ids = tool.array(docs[doc_id], 0)
        at = 0
        for row in part.itertuples():
            assert row.start == at and row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes()) and row.doc_tokens == len(ids)
            at += row.length
        assert at == len(ids)
    assert set(rows["doc_id"]) == set(docs)
    padding = 0
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]]
        used = int(part["length"].sum())
        assert used <= 1024
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    assert padding < 0.02 * rows["length"].sum()


def test_op5_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i * 37 % 400)) for i in range(20)], "doc_id long, text string")
    packed = packing.pack(docs, with_ids=True)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for row in packed.collect():
        assert ids[row["sequence_id"]][row["offset"] : row["offset"] + row["length"]] == row["ids"]


@pytest.mark.parametrize("n", [1, 2, 17, 63, 64, 65, 341, 512, 700, 1000, 1023, 1024, 1025, 5000])
def test_cut_lengths(n):
    lengths = packing.cut_lengths(n)
    assert sum(lengths) == n and all(0 < x <= 1024 for x in lengths)


def test_op6_edited_and_likeness(docs, result):
    rows, ids = result("op6_one_permutation").set_index("doc_id"), list(docs)
    errors, prints = [], {}
    for i, doc_id in enumerate(ids):
        text, after = docs[doc_id], docs[ids[(i + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = rows.loc[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        for other, near in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingles(text), shingles(other)
            if a and b:
                errors.append(row[near] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_op7_base_spans(docs, result):
    kinds = (
        ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    for row in result("op7_secret_scan").itertuples():
        spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(docs[row.doc_id]) if ok(m)]
        joined = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert row.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(joined) <= set(row.spans.split(",")) | {""}


def test_op7_random_strings_only():
    tool = secrets_scan.vocabulary()
    kinds = lambda text: [secrets_scan.KINDS[k] for _, k, _ in secrets_scan.spans_of(text, tool)]
    assert kinds("key k9Zq2Lw8Xv4Tn1Rb7Yc3PdQ8 end") == ["random"]
    for clean in ("internationalization_of_everything", "550e8400-e29b-41d4-a716-446655440000", "1234567890123456789012", "part-00012-of-00100-final-version", "einlichkeitverkeitachst"):
        assert kinds(clean) == []
    assert kinds("DA39A3EE5E6B4B0D3255BFEF95601890AFD80709") == []  # a digest in capitals


def test_op7_names_take_linear_time():
    code = "from cohortweave.llm import secrets_scan as s; t = s.vocabulary(); [s.spans_of(c * 1000 + w, t) for c in '-=/_+' for w in ('McDonald', 'iPhone', 'aB')]"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)  # a pattern that backtracks never ends
    old = re.compile(r"(([a-z]*|[A-Z]*|[A-Z][a-z]*)[0-9]*[_/=+-]+)+([a-z]*|[A-Z]*|[A-Z][a-z]*)[0-9]*|[0-9]+")
    rng = np.random.default_rng(2)
    for _ in range(5_000):
        run = "".join(rng.choice(list("abAB01_-/"), int(rng.integers(1, 9))))
        assert secrets_scan.is_name(run) == bool(old.fullmatch(run)), run


def test_op7_secrets_tied_to_words():
    tool, rng = secrets_scan.vocabulary(), np.random.default_rng(4)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for before in ("", "/repository/documents/", "//storage/company/production/backup/", "session=", "config"):
        for size in (16, 18, 24, 40):
            covered = 0
            for _ in range(50):
                text = f"a {before}{''.join(rng.choice(letters, size))} b"
                covered += any(k == 3 and a <= 2 + len(before) and b == len(text) - 2 for a, k, b in secrets_scan.spans_of(text, tool))
            assert covered >= 45, (before, size)
    key = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    found = lambda text: any(k == 3 for _, k, _ in secrets_scan.spans_of(text, tool))
    assert found(f"the key {key} opens") and found(f"/home/{key}")
    for clean in (f"sha1: {key}", f"commit {key}", f"/sha1/{key}", "/files/550e8400-e29b-41d4-a716-446655440000/page", "getElementsByTagNameAndClassName", "XMLHttpRequestEventTarget/addEventListener"):
        assert not found(clean), clean


def _repeated(words):
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if found[tuple(words[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(cover)


def test_op8_counts(docs, result):
    rows = result("op8_quality_rules")
    for row in rows.itertuples():
        text = docs[row.doc_id]
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        n, repeated = len(words), _repeated(words)
        assert (row.n_words, row.word_chars, row.n_symbols) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), repeated)
        assert row.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert not (row.base_failed and row.kept)


def test_op8_bound_is_exact():
    def tail(n, k, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n, alpha, delta in ((50, 0.05, 0.05), (500, 0.01, 0.001), (2_000, 0.02, 0.01), (10, 0.01, 0.01)):
        k = quality_rules.tail_bound(n, alpha, delta)
        assert (k == -1 or tail(n, k, alpha) <= delta) and tail(n, k + 1, alpha) > delta


def test_op8_cutoffs_keep_the_promise(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(3_000):
        bad = rng.random() < 0.2
        words = [f"w{rng.integers(0, 5000)}" + ("$$$" if bad and rng.random() < 0.8 else "") for _ in range(40)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    judged = quality_rules.judged_documents(docs, known).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "quality"]))
    assert judged.loc[judged["quality"] == 1, "kept"].mean() > 0.95
    assert judged.loc[judged["quality"] == 0, "kept"].mean() < 0.05


def test_op9_components(docs, result):
    sets = {i: shingles(t) for i, t in docs.items()}
    lists: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            lists.setdefault(g, []).append(i)
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for pair, common in Counter((a, b) for ids in lists.values() for k, a in enumerate(ids) for b in ids[k + 1 :]).items():
        a, b = pair
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for row in result("op9_ngram_jaccard").itertuples():
        assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), find(row.doc_id))


def _slow_rates(shares, tokens, targets, max_rate):
    """Projected gradient in plain numpy, until it stands."""
    available, r = shares.T @ tokens, np.ones(len(tokens))
    for _ in range(50_000):
        r = np.clip(r - shares @ ((shares.T @ (r * tokens) - targets) / available), 0, max_rate)
    return r


def _distance(shares, tokens, targets, r):
    return float((((shares.T @ (r * tokens)) - targets) ** 2 / (shares.T @ tokens)).sum()) / tokens.sum()


def test_op10_rates_are_the_best(result):
    rows = result("op10_soft_mixing")
    shares, tokens = rows[["p_good", "p_poor", "p_toxic"]].to_numpy(), rows["n_tokens"].to_numpy(float)
    assert np.allclose(shares.sum(axis=1), 1) and (rows["rate"] >= 0).all()
    targets = tokens.sum() * np.array([0.95, 0.03, 0.02])
    slow = _slow_rates(shares, tokens, targets, 4.0)
    assert _distance(shares, tokens, targets, rows["rate"].to_numpy()) <= _distance(shares, tokens, targets, slow) + 1e-4


def test_op10_reaches_targets_of_known_domains(spark):
    words = {"good": "fine solid", "poor": "junk spam", "toxic": "vile nasty"}
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        domain = ["good", "poor", "toxic"][int(rng.integers(0, 3))]
        rows.append((i, " ".join(rng.choice(words[domain].split() + ["x"] * 3, 30))))
        labels.append((i, domain))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, domain string")
    from cohortweave.llm import soft_mixing

    weights = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    # Each domain's words are in a third of the texts here, more than a lexicon takes by default.
    old, soft_mixing.COMMON = soft_mixing.COMMON, 0.5
    try:
        mixed, model, found = soft_mixing.mixed(docs, known, weights)
        assert len(mixed.collect()) == 600
    finally:
        soft_mixing.COMMON = old
    total = sum(found.targets)
    assert all(abs(a - t) < 0.001 * total for a, t in zip(found.reached, found.targets))


def test_op10_words_of_a_large_domain(spark):
    from cohortweave.llm import soft_mixing

    words = {"good": "fine solid", "poor": "junk spam", "toxic": "vile nasty"}
    rng = np.random.default_rng(5)
    labels = [(i, ["good", "poor", "toxic"][int(rng.integers(0, 3))]) for i in range(600)]
    rows = [(i, " ".join(rng.choice(words[d].split() + ["x"] * 3, 30))) for i, d in labels]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    mixed, _, found = soft_mixing.mixed(docs, known, {"good": 0.7, "poor": 0.2, "toxic": 0.1})
    own = dict(labels)
    assert all(r["mille"][list(words).index(own[r["doc_id"]])] > 900 for r in mixed.collect())
    assert all(abs(a - t) < 0.001 * sum(found.targets) for a, t in zip(found.reached, found.targets))


def test_op10_anchor_keeps_its_documents(spark):
    from cohortweave.llm import soft_mixing

    rng = np.random.default_rng(8)
    soft = np.concatenate([rng.dirichlet(a, 200) for a in ((6, 0.3, 0.3), (0.3, 6, 0.3), (0.3, 0.3, 6))])
    mille = [[1000 - p - t, p, t] for p, t in (soft[:, 1:] * 1000).astype(int).tolist()]
    groups = spark.createDataFrame([(m, 100) for m in mille], "mille array<int>, tokens long").coalesce(1)
    found = soft_mixing.solve(groups, [0.97, 0.02, 0.01], 1.0, 0)
    rates = groups.select("mille", soft_mixing.rate(F.col("mille"), found.residuals, 1.0, 0).alias("r")).collect()
    assert all(r["r"] == 1.0 for r in rates if r["mille"][0] == max(r["mille"]))
    assert found.met and np.mean([r["r"] for r in rates if r["mille"][0] < max(r["mille"])]) < 0.5


def test_components_of_paths_stars_and_cycles(spark):
    from cohortweave.llm.links import components, merged

    rng = np.random.default_rng(9)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(400, 600) if i != 500]
    odd = [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (150, 2))] + [(7, 7), (2, 1), (1, 2)]
    edges = chain + star + odd
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    wanted = {n: find(n) for n in parent if n != 7 and any(n in e and e[0] != e[1] for e in edges)}
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in components(table).collect()} == wanted
    half = merged(None, spark.createDataFrame(edges[::2], "a long, b long"))
    assert {r["node"]: r["root"] for r in merged(half, spark.createDataFrame(edges[1::2], "a long, b long")).collect()} == wanted
    assert components(table.limit(0)).count() == 0


def test_bounded_sample(spark):
    from cohortweave.llm.rowmaps import bounded_sample

    rows = spark.range(5_000)
    some = [r["id"] for r in bounded_sample(rows, "id", 500).collect()]
    assert 400 < len(some) <= 500 and some == [r["id"] for r in bounded_sample(rows.repartition(7), "id", 500).collect()]
    assert bounded_sample(rows, "id", 6_000).count() == 5_000

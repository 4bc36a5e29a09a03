"""Suffix arrays, repeated passages, phrases and periodic runs, against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortweave.llm import induced_sorting as isort
from cohortweave.llm import periodic_runs as pr
from cohortweave.llm import phrase_mining as pm
from cohortweave.llm import suffix_dedup as sd
from cohortweave.llm.phrase_mining import op12_phrase_mining
from cohortweave.llm.registry import QUERIES
from tests.conftest import SF_SMALL

# --- suffix arrays ----------------------------------------------------------------


@pytest.mark.parametrize("few", [1024, 2])  # bucket by bucket, and stretches of buckets
def test_suffix_arrays(few, monkeypatch):
    monkeypatch.setattr(isort, "_FEW", few)
    monkeypatch.setattr(isort, "_AT_ONCE", 8192 if few > 2 else 16)
    draw = random.Random(few)
    for _ in range(400):
        n, k = draw.randrange(1, 200), draw.choice([1, 2, 3, 5, 50, 400])
        t = [draw.randrange(k) for _ in range(n)]
        if draw.random() < 0.5:
            t = (t[: draw.randrange(1, 20)] * 200)[:n]
            for _ in range(draw.randrange(3)):
                t[draw.randrange(n)] = draw.randrange(k)
        assert isort.suffix_array(np.array(t, dtype=np.int32)).tolist() == sorted(range(n), key=lambda i: t[i:])


def test_suffix_array_of_text(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(40).collect()]
    raw = "\n".join(texts).encode()
    order = isort.suffix_array(np.frombuffer(raw, np.uint8), 256)
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert all(raw[a:] < raw[b:] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))


def test_permuted_common_prefixes():
    draw = random.Random(5)
    for _ in range(200):
        strings = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 40))) for _ in range(draw.randrange(1, 8))]
        data = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8)
        sizes = [len(s) + 1 for s in strings]
        ends = np.repeat(np.cumsum(sizes) - 1, sizes)
        order = isort.suffix_array(data, 256)
        found = isort.permuted_common_prefixes(data, order, ends)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist()):
            k = 0
            while i + k < ends[i] and j + k < ends[j] and data[i + k] == data[j + k]:
                k += 1
            assert found[i] == k


# --- op11 -------------------------------------------------------------------------


def _without_repeats(docs, size=50):
    """``(id, kept bytes, runs removed)`` per document, as the definition says."""
    first = {}
    texts = sorted((i, (t or "").encode()) for i, t in docs)
    for i, t in texts:
        for p in range(len(t) - size + 1):
            first.setdefault(t[p : p + size], i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = b"\x01" * size
        runs = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, bytes(c for c, g in zip(t, gone) if not g), runs))
    return out


def _found(df):
    return sorted((r.doc_id, bytes(r.kept), len(r.spans)) for r in df.collect())


def test_op11_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    wanted = {i: (len((t or "").encode()), kept, runs) for (i, kept, runs), (_, t) in zip(_without_repeats(docs), sorted(docs))}
    rows = QUERIES["op11_suffix_dedup"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        size, kept, runs = wanted[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(kept), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("more", [{}, {"block_bytes": 3_000, "common": 5}])
def test_passages_that_cross_blocks(spark, more):
    """Copies, overlaps, periodic text, characters of several bytes; few and many blocks, common grams apart."""
    draw = random.Random(11)
    words = ["straße", "naïve", "alpha", "beta", "gamma", "δέλτα"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared = [make(12) for _ in range(4)] + ["ab" * 60, "x" * 200, "A line that very many documents have at their end, word by word."]
    docs = []
    for i in range(120):
        parts = [make(draw.randrange(0, 30))]
        for _ in range(draw.randrange(3)):
            passage = draw.choice(shared)
            cut = draw.randrange(len(passage) // 3)
            parts += [passage[cut : len(passage) - draw.randrange(10)], make(draw.randrange(5))]
        docs.append((i * 3, " ".join(parts) + (shared[-1] if i % 2 else "")))
    docs += [(1000 + i, docs[5][1]) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert _found(sd.repeated_spans(df, **more)) == _without_repeats(docs)


def test_ranges_of_hashes_are_alike():
    """Least hashes are small ones; no range may hear many more than its share."""
    draw = random.Random(5)
    raw = "".join(draw.choice("abcdefgh ") for _ in range(200_000)).encode()
    found = sd._stretches(sd.ws.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), sd.SIZE)
    keys, _, _ = sd._block_keys(np.zeros(1, np.int64), found, 38)
    _, border = sd._by_range(keys, 38, 6)
    shares = np.diff(border)
    assert len(shares) == 64 and shares.max() < 2 * shares.mean()


def test_op11_edges(spark, odd_docs, no_docs):
    found = sd.repeated_spans(odd_docs).collect()
    assert len(found) == 11 and all(not r.spans for r in found)
    assert {r.doc_id: r.n_bytes for r in found}[2] == 0
    assert sd.repeated_spans(no_docs).count() == 0
    line = "a line of more than fifty bytes that stands in every one of the documents"
    rows = [(None, line), (5, line), (5, line), (9, line), (9, line[:49]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id or -1), len(bytes(r.kept))) for r in sd.repeated_spans(df).collect())
    assert left == [(-1, len(line)), (3, 0), (5, len(line)), (5, len(line)), (9, 0), (9, 49)]


def test_a_text_longer_than_a_piece(spark):
    draw = random.Random(2)
    long = "".join(draw.choice("abcdefgh ") for _ in range(3 * sd.PIECE))
    docs = [(1, long), (2, "y" * 60 + long[sd.PIECE - 40 : sd.PIECE + 40] + "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _found(sd.repeated_spans(df)) == [(1, long.encode(), 0), (2, b"y" * 60 + b"z", 1)]


# --- op12 -------------------------------------------------------------------------


def _counted(docs):
    counts, totals = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in docs:
        piece, pieces = "", []
        for ch in (text or "").translate(lower):
            if ch in ".,;:!?\n\v\f\r":
                pieces.append(piece)
                piece = ""
            else:
                piece += ch
        for p in [*pieces, piece]:
            words = [w for w in p.replace("\t", " ").split(" ") if w]
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                counts.update((lang or "und", " ".join(words[i : i + size])) for i in range(len(words) - size + 1))
    return counts, totals


def _collocations(docs, least, most):
    counts, totals = _counted(docs)
    often = {k: f for k, f in counts.items() if f >= least}
    ranked = {}
    for (lang, phrase), a in often.items():
        words = phrase.split(" ")
        if len(words) == 1:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[lang, " ".join(words[:k])], often[lang, " ".join(words[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if len(words) == 2 and any(100 * f >= 50 * a and l2 == lang and f" {phrase} " in f" {p} " and p.count(" ") == 2 for (l2, p), f in often.items()):
            continue
        ranked.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, left, right, totals[lang], score))
    return sorted((lang, i + 1, *r[3:]) for lang, rows in ranked.items() for i, r in enumerate(sorted(rows)[:most]))


def _table_of_phrases(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_phrases_against_brute_force(spark, shards):
    """Words that become frequent late, in one shard only, languages apart, ties, an unknown language."""
    draw = random.Random(7)
    words = ["alpha", "beta", "Gamma", "δ", "é!", "x.y", "tab\tbed"] + [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(40))), draw.choice(["en", "de", None])) for i in range(150)]
    docs += [(900 + i, "late words come here. late words come", "en") for i in range(7)] + [(None, "late words come, late words", "en"), (5, None, "en"), (6, "", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    made = pm.collocations(*pm.frequent_phrases(df, min_count=8, shards=shards), most=40)
    assert _table_of_phrases(made) == _collocations([(t, lang) for _, t, lang in docs], 8, 40)


def test_op12_edges(spark, odd_docs, no_docs):
    assert pm.collocations(*pm.frequent_phrases(no_docs)).count() == 0
    frequent, totals = pm.frequent_phrases(odd_docs, min_count=2)
    assert {r.lang: r.n for r in totals.collect()}["und"] == 60_000
    counts, _ = _counted([(r.text, r.lang) for r in odd_docs.collect()])
    assert {(r.lang, r.phrase): r.f for r in frequent.collect()} == {k: f for k, f in counts.items() if f >= 2 and k[1].count(" ") < 3}


def test_op12_scores_beyond_64_bits(spark):
    rows = [("en", 1, "a", 6 * 10**12), ("en", 1, "b", 5 * 10**12), ("en", 2, "a b", 4 * 10**12)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    assert [r.score for r in pm.collocations(frequent, totals).collect()] == [10**6 * 16 // 30]


def test_op12_whole_table(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").collect()]
    assert _table_of_phrases(op12_phrase_mining(spark, SF_SMALL)) == _collocations(docs, 10, 2_000)


# --- op13 -------------------------------------------------------------------------


def _runs(c, least=6, periods=4):
    out = set()
    for q in range(1, len(c) // periods + 1):
        i = 0
        while i + q < len(c):
            if c[i] != c[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(c) and c[i] == c[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, periods * q) and not any(all(c[s + k] == c[s + k + d] for k in range(n - d)) for d in range(1, q)):
                out.add((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


_passages = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(_passages)
def test_runs(passages):
    words = [w for passage, n in passages for w in passage * n]
    assert pr.runs(np.array(words, dtype=np.int64)) == _runs(words)
    assert pr.runs(np.array(words, dtype=np.int64), 4, 2) == _runs(words, 4, 2)


@pytest.mark.parametrize("words", [np.zeros(60_000, int), np.tile(np.arange(9_000), 5), np.tile(np.arange(7), 9_000)])
def test_long_runs_take_linear_time(words):
    q = len(np.unique(words))
    assert pr.runs(words) == [(0, len(words), q)]


def test_op13_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()}
    assert rows.keys() == docs.keys()
    for doc_id, text in docs.items():
        words = (text or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b" " * 5)).split(b" ")
        words = [w for w in words if w]
        n, h = len(words), crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = _runs(words) if n < 700 else pr.runs(np.array([sorted(set(words)).index(w) for w in words]))
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = rows[doc_id]
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_op13_edges(spark, odd_docs, no_docs):
    rows = pr.periodic_runs(odd_docs, repeat_some=True).collect()
    assert len(rows) == 11
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in rows}
    for i in (2, 3, 4):
        assert (by_id[i].n_words, by_id[i].n_runs, by_id[i].start, by_id[i].runs_sha256, by_id[i].collapsed_sha256) == (0, 0, None, empty, empty)
    assert by_id[7].n_words == 60_000 and by_id[7].n_runs == 0
    assert pr.periodic_runs(no_docs).count() == 0
    df = spark.createDataFrame([(1, "x  a b a\tb a b a b\ny")], "doc_id long, text string")
    row = pr.periodic_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)]
    assert row.collapsed_sha256 == hashlib.sha256(b"x a b y").hexdigest()

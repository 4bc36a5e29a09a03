"""Operator 4 in rounds and parts: the same scores, and little left on disk."""

import os

import numpy as np
import pytest

from cohortweave.llm import backoff_scoring, token_blocks
from cohortweave.operators.shared import Scratch, shared_folder
from tests.llm.test_brute_force import _plain_scores


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0], [2**63 - 1, 1], list(range(70_000))])
def test_packed_numbers_come_back(values):
    for kind in (np.int64, np.uint64):
        given = np.array(values, dtype=kind)
        assert (token_blocks.unpacked(token_blocks.packed(given), len(given), kind) == given).all()
    assert (token_blocks.unpacked(token_blocks.packed(~np.zeros(2, np.uint64)), 2, np.uint64) == ~np.zeros(2, np.uint64)).all()


@pytest.mark.parametrize("near", [0, 1, 1 << 30, (1 << 64) - 1])
def test_hashes_are_sorted(near):
    rng = np.random.default_rng(3)
    # Hashes that differ in their low bits only, beside far ones.
    keys = np.concatenate([rng.integers(0, max(near, 1), 3_000, dtype=np.uint64), rng.integers(0, 9, 500, dtype=np.uint64), np.full(9, near, np.uint64)])
    for some in (keys, keys[:1], keys[:0]):
        assert (some[token_blocks.ordered(some)] == np.sort(some)).all()


def test_every_hash_has_one_part():
    keys = np.concatenate([np.random.default_rng(1).integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2), [np.uint64(0), ~np.uint64(0)]])
    for tokens, rounds in ((0, 1), (backoff_scoring._PART_GRAMS * 7, 1), (backoff_scoring._PART_GRAMS * 7, 3)):
        met = []
        for deal in backoff_scoring._dealt(tokens, rounds):
            own = np.sort(keys[backoff_scoring._of_parts(keys, deal)])
            for p, a, b in backoff_scoring._cuts(own, deal):
                assert backoff_scoring._least(p, deal[0]) <= own[a] and (p == deal[0] - 1 or own[b - 1] < backoff_scoring._least(p + 1, deal[0]))
            met.append(own)
        assert (np.sort(np.concatenate(met)) == np.sort(keys)).all()


def _texts():
    rng = np.random.default_rng(7)
    return [" ".join(f"w{i}" for i in rng.zipf(1.3, rng.integers(0, 60)) % 500) for _ in range(200)] + ["", "w1 w1 w1 w1", "w1 w1 w1 w1", "W2 é"]


def test_rounds_and_parts_change_no_score(spark, monkeypatch):
    monkeypatch.setattr(backoff_scoring, "_ROUND_TOKENS", 100)
    monkeypatch.setattr(backoff_scoring, "_PART_GRAMS", 700)
    texts = _texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for keep in (1e-3, 0.5):
        model, tables = backoff_scoring.fit(table, keep=keep)
        rows = {r["doc_id"]: r["score"] for r in backoff_scoring.score(table, model, tables).collect()}
        assert [rows[i] for i in range(len(texts))] == pytest.approx(_plain_scores(texts, backoff_scoring.LEAST), rel=1e-6, abs=1e-6)


def test_blocks_serve_as_texts_do(spark):
    texts = _texts()
    table = spark.createDataFrame([(i, t, [i, None]) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` array<int>")
    scratch = Scratch(spark)
    parts = [token_blocks.encoded(scratch, str(i), table.where(f"doc_id % 3 {sign} 0"), "text", ["doc_id", "a.b"]) for i, sign in enumerate(("=", "<>"))]
    model, tables = backoff_scoring.fit(parts[0])
    rows = sorted(backoff_scoring.score(parts[0].union(parts[1]), model, tables, keep=["a.b"]).collect())
    wanted = backoff_scoring.score(table, *backoff_scoring.fit(table.where("doc_id % 3 = 0")), keep=["a.b"])
    for row, other in zip(rows, sorted(wanted.collect()), strict=True):
        assert tuple(row)[:4] == tuple(other)[:4] and tuple(row)[4:] == pytest.approx(tuple(other)[4:], rel=1e-9)


def test_little_is_left_on_disk(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{i}" for i in rng.integers(0, 3_000, 500)) for _ in range(300)]  # most n-grams once
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    def held():
        return sum(os.path.getsize(f"{d}/{name}") for d, _, names in os.walk(shared_folder(spark).removeprefix("file://")) for name in names if name.endswith(".parquet"))

    before = held()
    model, tables = backoff_scoring.fit(table, keep=0.5)
    assert backoff_scoring.score(table, model, tables).count() == len(texts)
    assert held() - before < sum(map(len, texts))

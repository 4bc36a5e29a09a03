"""Texts made so that a polynomial hash over 2**64 takes them for equal."""

import pyarrow as pa

from cohortweave.llm import ngram_join, quality_rules
from cohortweave.llm import wordspans as ws


def _pair(n=2048):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_and_lines_are_told_apart():
    a, b = _pair()
    assert len(set(ws.words(ws.of_array(pa.array([a, b, a]))).hashes.tolist())) == 2
    made = quality_rules.count_texts(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} {b}"]))
    assert made["n_dup_lines"].to_pylist() == [0, 1, 0]
    assert made["n_distinct"].to_pylist() == [2, 1, 2]


def test_documents_of_such_words_are_not_linked(spark):
    a, b = _pair()
    docs = [(1, f"{a} " * 6), (2, f"{b} " * 6), (3, a), (4, b), (5, f"{a} " * 6)]
    rows = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_hashes_depend_on_the_bytes_alone():
    texts = ws.of_array(pa.array(["x one two", None, "", " one\ttwo  one "]))
    found = ws.words(texts)
    assert found.hashes[1] == found.hashes[3] == found.hashes[5] and found.hashes[2] == found.hashes[4]
    alone = ws.words(ws.of_array(pa.array(["one"])))
    assert alone.hashes[0] == found.hashes[1]
    assert len(ws.words(ws.of_array(pa.array([], pa.string()))).hashes) == 0

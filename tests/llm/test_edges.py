"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from cohortweave.llm import (
    additive_quality,
    backoff_scoring,
    license_scan,
    ngram_join,
    one_permutation,
    packing,
    quality_rules,
    secrets_scan,
    soft_mixing,
    token_files,
)
from cohortweave.llm.rowmaps import add_columns

N = 11


def _lm(docs):
    model, words = backoff_scoring.fit(docs)
    return backoff_scoring.score(docs, model, words)


def _additive(docs, labels):
    features = additive_quality.with_features(docs, "text", ["doc_id"])
    model = additive_quality.fit(features, labels, "doc_id", "quality")
    return additive_quality.scored(features, model, ["doc_id"])


RUNS = {
    "license": lambda d, _: license_scan.scan(d),
    "additive": _additive,
    "tokens": lambda d, _: token_files.read_documents(token_files.write_files(d)),
    "scoring": lambda d, _: _lm(d),
    "fingerprint": lambda d, _: one_permutation.fingerprints(d),
    "secrets": lambda d, _: secrets_scan.scan(d),
    "rules": lambda d, labels: quality_rules.judged_documents(d, labels),
    "jaccard": lambda d, _: ngram_join.near_duplicates(d),
    "mixing": lambda d, labels: soft_mixing.mixed(d, soft_mixing.domains_of_labels(labels), {"good": 0.8, "poor": 0.2})[0],
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_per_row(name, odd_docs, no_docs, odd_labels):
    assert RUNS[name](odd_docs, odd_labels).count() == N
    assert RUNS[name](no_docs, odd_labels).count() == 0


@pytest.mark.parametrize("name", ["rules", "mixing", "additive"])
def test_without_labels(name, odd_docs, odd_labels):
    assert RUNS[name](odd_docs, odd_labels.limit(0)).count() == N


def test_packing_keeps_every_id(odd_docs, no_docs):
    pieces = packing.pack(odd_docs).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    tokens = token_files.read_documents(token_files.write_files(odd_docs)).toPandas()
    assert pieces["length"].sum() == tokens["n_tokens"].sum()
    assert packing.pack(no_docs).count() == 0


def test_fingerprint_of_next_document(odd_docs, no_docs):
    rows = one_permutation.edited_texts(odd_docs).collect()
    assert len(rows) == N
    by_id = {r["_key"]: r for r in rows}
    assert by_id[10]["_edited"] == by_id[10]["_text"][: -(len(by_id[10]["_text"]) // 4)] + by_id[1]["_text"][: len(by_id[10]["_text"]) // 4]
    made = {r["doc_id"]: r for r in one_permutation.edited_fingerprints(odd_docs).collect()}
    assert made[None]["near_next"] is None and made[2]["near_next"] == 1.0 and made[1]["near_next"] == 0.0
    assert made[5]["fingerprint"] == made[6]["fingerprint"] and made[3]["fingerprint"] == ""
    assert one_permutation.edited_fingerprints(no_docs).count() == 0


def test_jaccard_values(odd_docs):
    rows = ngram_join.near_duplicates(odd_docs).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[1] == (3, 1)
    assert found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (0, 4)
    assert found[5] == (1, 5) and found[6] == (1, 5)
    assert found[None][1] is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns(name, spark, odd_docs, no_docs, odd_labels, folder):
    odd_labels.write.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, folder)
    assert out.columns == odd_docs.columns
    assert {c: t for c, t in out.dtypes} == dict(odd_docs.dtypes)
    assert out.count() <= N
    assert stage(spark, no_docs, folder).count() == 0


def _part_sizes(texts):
    return {"part": pa.array([len(texts)] * len(texts), pa.int64())}


def test_texts_are_sent_once_and_go_back_in_parts(spark):
    """A batch of long texts is not answered as a whole, and a text that is kept is not sent beside itself."""
    docs = spark.range(6).selectExpr("id AS doc_id", "IF(id = 5, NULL, repeat(char(97 + id), 3000000)) AS text", "'en' AS lang").coalesce(1)
    added = T.StructType([T.StructField("part", T.LongType())])
    for keep in (None, ["doc_id"], ["lang", "text"]):
        out = add_columns(docs, "text", _part_sizes, added, keep)
        assert out.columns == [*(keep or docs.columns), "part"]
        assert out.agg(F.max("part")).first()[0] <= 2
    out = add_columns(docs, "text", _part_sizes, added)
    assert out.selectExpr("doc_id", "left(text, 1) AS c", "length(text) AS n").collect() == docs.selectExpr("doc_id", "left(text, 1) AS c", "length(text) AS n").collect()
    assert "_of" not in out._jdf.queryExecution().analyzed().toString()

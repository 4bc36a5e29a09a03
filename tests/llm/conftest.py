"""Rows that every operator must survive."""

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_words", T.StringType()),  # clashes with names the operators make
        T.StructField("set_id", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977} é{i}" for i in range(30_000))


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", "z", "t", "dot")


ODD_ROWS = [
    row(1, "one two three four five six seven"),
    row(1, "one two three four five six seven"),  # repeated
    row(2, None),
    row(3, ""),
    row(4, " \n\t "),
    row(5, "One TWO three"),
    row(6, "one two three"),
    row(7, LONG, None, None),
    row(None, "a text without an id that has some words", "de"),
    row(9, "   é\U0001f600 café naïve <|endoftext|> it's\r\n\r\n  99 bücher\t", "fr"),
    row(10, 'password = "hunter2hunter2" under the MIT License.'),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD_ROWS, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 0), (7, None, None), (10, 0, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )

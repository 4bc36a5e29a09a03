"""From raw documents to packed training sequences: five stages, each one operator over all it is given.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm.ngram_join import first_of_groups
from cohortweave.llm.packing import pack
from cohortweave.llm.quality_rules import kept_documents
from cohortweave.llm.rowmaps import PART_BYTES
from cohortweave.llm.secrets_scan import redact
from cohortweave.llm.soft_mixing import domains_of_labels, thinned
from cohortweave.operators.shared import written

#: Shares of the tokens by domain that the corpus shall have; good text is kept whole, the rest gives way.
MIX = {"good": 0.97, "poor": 0.02, "toxic": 0.01}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs of their language."""
    return kept_documents(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    return first_of_groups(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` renewed."""
    return redact(docs, size="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that bring the domains to their shares."""
    return thinned(docs, domains_of_labels(_labels(spark, sf_dir)), MIX, anchor="good")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("soft mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), batch_bytes=PART_BYTES)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Certified cutoffs, the classifier, tokens and bins are beyond SQL; tests compare with brute force.
ORACLE_SQL = None

"""CSV, JSON and list files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.schemas import DESCRIPTION_COUNTS


def read_positional_csv(spark: SparkSession, path: str, columns: Sequence[str], split: str = ",") -> DataFrame:
    """Rows by position under the given names; the file's own header is skipped.

    Quotes are ordinary characters. A short row ends in NULLs, extra fields drop,
    and an empty field reads as NULL.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep=split, header=True, enforceSchema=True, quote="")


def parse_positional_lines(lines: DataFrame, columns: Sequence[str], split: str = ",", line: str = "value") -> DataFrame:
    """The same for lines that are in a table already."""
    fields = lines.select(F.split(F.col(line), F.lit("\\Q" + split + "\\E"), -1).alias("_fields"))
    return fields.selectExpr(*[f"nullif(get(_fields, {i}), '') AS `{name}`" for i, name in enumerate(columns)])


def read_header_csv(spark: SparkSession, path: str, columns: Mapping[str, str], split: str = ",") -> DataFrame:
    """Named columns of a CSV with a header, each under its new name."""
    rows = spark.read.csv(path, sep=split, header=True, inferSchema=False)
    return rows.select(*[F.col(f"`{name}`").alias(new) for name, new in columns.items()])


def read_id_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One id per line."""
    return spark.read.text(path).select(F.rtrim("value").alias(name)).where(F.col(name) != "")


def read_description_counts(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of description counts whose numbers are text."""
    rows = spark.read.json(path, schema=DESCRIPTION_COUNTS, multiLine=True)
    return typed_description_counts(rows)


def typed_description_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("SeriesDescription").alias("description"), F.col("num").cast("bigint").alias("num"))

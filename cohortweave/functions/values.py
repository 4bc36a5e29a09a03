"""Checked casts and defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.schemas import MISSING


def present(text: Column) -> Column:
    """Empty text is a missing value."""
    return F.nullif(text, F.lit(""))


def or_missing(value: Column) -> Column:
    """Output form of a missing number; inside the engine it stays NULL."""
    return F.coalesce(value, F.lit(MISSING))


def known(value: Column) -> Column:
    """True for a value that is neither NULL nor the output form of missing."""
    return F.coalesce(value != F.lit(MISSING), F.lit(False))


def subject_key(text: Column) -> Column:
    """Subject ids compare as numbers where they are numbers, so ``007`` equals ``7``."""
    return F.coalesce(text.try_cast("bigint").cast("string"), F.trim(text))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def typed_list(texts: Column, type_name: str) -> Column:
    """Multi-value tag with every element converted."""
    return F.transform(texts, lambda x: x.try_cast(type_name))


def drawn(key: Column, seed: int | str, digits: int = 13) -> Column:
    """A whole number of ``digits`` hexadecimal digits for a key and a seed, the same on every engine."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def bucket_of(key: Column, buckets: int, seed: int = 0) -> Column:
    """Repeatable bucket of a key, the same on every run and after any retry."""
    return F.pmod(drawn(key, seed, 15), F.lit(buckets).cast("bigint"))

"""Nested, typed tags of a JSON column, as rows.

A set of tags is a JSON object of tag names and values. A value is a number or text, a list of such, another
set, or a sequence (a list of sets); sets nest to any depth. All is built from VARIANT expressions: one
scan, one generator per level, no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.schemas import TAG_PIXELS, TAG_TYPES

_COLUMN_OF = {"bigint": "i", "double": "f", "string": "s"}


def nesting_depth(json: Column) -> Column:
    """Brackets open at once, at most; those within quoted text don't count."""
    return _marks_depth(bracket_marks(json))


def bracket_marks(json: Column) -> Column:
    """The brackets outside quoted text. Sets of tags differ far more than their brackets do."""
    return F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")


def _marks_depth(marks: Column) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda state: state["most"])


def _is_set(value: Column) -> Column:
    # Unlike the schema of a value, this looks at nothing inside it.
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def _elements(value: Column) -> Column:
    """Those of a list; null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _opens(value: Column) -> Column:
    """Sets, and lists with a set in them, are gone into; other lists are values."""
    return F.coalesce(_is_set(value) | F.exists(_elements(value), _is_set), F.lit(False))


def _leaves(rows: DataFrame, key: str, json: str, depth: int) -> DataFrame:
    """``key, path, tag, value`` of everything that is no set, ``fault`` where it cannot be a tag."""
    spark = rows.sparkSession
    # Empty text and text that is no JSON give no value.
    root = F.try_parse_json(F.col(json).cast("string"))
    level = rows.where(F.col(json).isNotNull()).select(
        F.col(key).alias("key"), F.lit("").alias("path"), F.lit(None).cast("string").alias("tag"), root.alias("value"),
    ).select("*", F.when(F.col("value").isNull(), "not_json").when(~_is_set(F.col("value")), "not_tags").alias("fault"))
    level = level.withColumn("open", F.col("fault").isNull())
    for _ in range(depth):
        # A set that is gone into is not kept beside each of its tags.
        own, entered = F.when(~F.col("open"), F.col("value")), F.when(F.col("open"), F.col("value"))
        inner = level.select("key", "path", "tag", own.alias("value"), "fault", "open", entered.alias("_in"))
        inside = inner.lateralJoin(spark.tvf.variant_explode_outer(F.col("_in").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_name"), F.col("value").alias("_child")))
        name, child = F.col("_name"), F.col("_child")
        kept = inside.where(~F.col("open") | (F.col("_pos").isNotNull() & ~F.coalesce(name == TAG_PIXELS, F.lit(False)) & ~F.coalesce(F.is_variant_null(child), F.lit(False))))
        slash = F.when(F.col("path") == "", "").otherwise("/")
        place = F.when(name.isNotNull(), F.concat("path", slash, name)).otherwise(F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        stray = F.col("open") & name.isNull() & ~_is_set(child)  # in a sequence, but no set
        level = kept.select(
            "key",
            F.when(F.col("open"), place).otherwise(F.col("path")).alias("path"),
            F.when(F.col("open"), F.coalesce(name, F.col("tag"))).otherwise(F.col("tag")).alias("tag"),
            F.when(F.col("open"), child).otherwise(F.col("value")).alias("value"),
            F.when(stray, "not_tags").otherwise(F.col("fault")).alias("fault"),
            (F.col("open") & ~stray & _opens(child)).alias("open"),
        )
    return level.where("NOT open")


def _as(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.try_variant_get(value, "$", kind)


def _typed(leaves: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Adds ``is_list``, the typed values and, where one does not convert, the fault."""
    value = F.col("value")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("tag")) if types else F.lit(None).cast("string")
    kind = F.col("_kind")
    is_list = F.startswith(kind, F.lit("ARRAY<"))
    inner = F.when(is_list, F.expr("substring(_kind, 7, length(_kind) - 7)")).otherwise(kind)
    own = F.when(inner == "BIGINT", "bigint").when(inner.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "double").otherwise("string")
    rows = leaves.withColumn("_kind", F.schema_of_variant(value)).select(*leaves.columns, is_list.alias("is_list"), F.coalesce(named, own).alias("type"))
    listed = rows.withColumn("_all", F.when(F.col("fault").isNull(), F.when(F.col("is_list"), _elements(value)).otherwise(F.array(value))))
    converted = {
        column: F.when(F.col("type") == kind, F.transform("_all", _as(kind)))
        for kind, column in _COLUMN_OF.items()
    }
    made = listed.select("*", *[c.alias(f"_{name}") for name, c in converted.items()])
    failed = [F.coalesce(F.exists(f"_{name}", F.isnull), F.lit(False)) for name in converted]
    fault = F.coalesce("fault", F.when(failed[0] | failed[1] | failed[2], F.concat(F.lit("not_"), "type")))
    return made.select("key", "path", "tag", "is_list", "type", fault.alias("fault"), F.struct(*[F.col(f"_{n}").alias(n) for n in converted]).alias("value"))


def _all_tags(rows: DataFrame, key: str, json: str, types: Mapping[str, str] | None) -> DataFrame:
    marks = rows.select(bracket_marks(F.col(json).cast("string")).alias("marks")).distinct()
    depth = marks.agg(F.max(_marks_depth(F.col("marks")))).first()[0] or 0
    return _typed(_leaves(rows, key, json, depth), TAG_TYPES if types is None else types)


def typed_tags(rows: DataFrame, key: str, json: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """``key, path, tag, is_list, value`` of every tag that has a value, at any depth.

    ``path`` leads to the tag (``Sequence[0]/Tag``); ``value`` has one array, of integers ``i``, floats ``f`` or
    texts ``s``. ``types`` gives the type of a tag by name (``bigint``, ``double``, ``string``); any other keeps its
    own, a list of several kinds becomes text. Lists are converted element by element, and one element that
    does not convert takes its tag away, that tag alone: see :func:`tag_faults`. The pixel tag and nulls are left
    out, as are empty sets and rows without JSON.
    """
    return _all_tags(rows, key, json, types).where("fault IS NULL").select(F.col("key").alias(key), "path", "tag", "is_list", "value")


def tag_faults(rows: DataFrame, key: str, json: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """Tags that :func:`typed_tags` leaves out, and why: ``not_json``, ``not_tags`` (no set where one must be),
    ``not_bigint``, ``not_double``, ``not_string``.
    """
    return _all_tags(rows, key, json, types).where("fault IS NOT NULL").select(F.col("key").alias(key), "path", "tag", F.col("fault").alias("reason"))

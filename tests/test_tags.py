"""Nested, typed tags."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortweave.operators import tags as tg
from cohortweave.schemas import TAG_PIXELS


def _table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, tags string")


def _read(rows, **more):
    return {(r["id"], r["path"]): r for r in tg.typed_tags(rows, "id", "tags", **more).collect()}


def test_types_lists_and_sequences(spark):
    one = {
        "Slice Location": "1.5",
        "Rows": [1, "2", 3],
        "Sequence": [{"Inner": {"Deep": [{"D": 1}, {"D": "x", TAG_PIXELS: "p"}]}}],
        TAG_PIXELS: "AA==",
        "Note": None,
        "Nothing": {},
        "Mixed": [1, "a"],
        "Fractions": [1, 2.5],
        "Quoted": '{[{["',
    }
    found = {path: (r["is_list"], r["value"].asDict()) for (_, path), r in _read(_table(spark, json.dumps(one))).items()}
    value = lambda **v: {"i": None, "f": None, "s": None} | v
    assert found == {
        "Slice Location": (False, value(f=[1.5])),
        "Rows": (True, value(i=[1, 2, 3])),
        "Sequence[0]/Inner/Deep[0]/D": (False, value(i=[1])),
        "Sequence[0]/Inner/Deep[1]/D": (False, value(s=["x"])),
        "Mixed": (True, value(s=["1", "a"])),
        "Fractions": (True, value(f=[1.0, 2.5])),
        "Quoted": (False, value(s=['{[{["'])),
    }


def test_a_bad_tag_goes_alone_and_is_told(spark, rows):
    table = _table(spark, '{"Rows":"no","Columns":4,"Q":[{"D":1},5]}', None, "{bad", "[1]", "", "{}", "7")
    assert {k: r["value"]["i"] for k, r in _read(table).items()} == {(0, "Columns"): [4], (0, "Q[0]/D"): [1]}
    assert rows(tg.tag_faults(table, "id", "tags")) == [
        (0, "Q[1]", "Q", "not_tags"), (0, "Rows", "Rows", "not_bigint"), (2, "", None, "not_json"),
        (3, "", None, "not_tags"), (4, "", None, "not_json"), (6, "", None, "not_tags"),
    ]


def test_one_element_that_is_null_takes_its_list_along(spark):
    assert _read(_table(spark, '{"Rows":[1,null],"Columns":[]}')).keys() == {(0, "Columns")}


def test_a_type_by_name_wins(spark):
    found = _read(_table(spark, '{"Id":7,"Rows":7}'), types={"Id": "string"})
    assert found[0, "Id"]["value"]["s"] == ["7"] and found[0, "Rows"]["value"]["i"] == [7]


def test_empty_table(spark):
    assert tg.typed_tags(spark.createDataFrame([], "id long, tags string"), "id", "tags").count() == 0


def test_one_scan_without_shuffle(spark):
    df = tg.typed_tags(_table(spark, '{"a":[{"b":{"c":[{"d":1}]}}]}'), "id", "tags")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Scan") == 1


_leaf = st.one_of(st.integers(-99, 99), st.text("ab\"[{", max_size=4))
_sets = st.recursive(
    st.dictionaries(st.text("xyz", min_size=1, max_size=2), _leaf, max_size=3),
    lambda inner: st.dictionaries(st.text("xyz", min_size=1, max_size=2), st.one_of(_leaf, inner, st.lists(inner, min_size=1, max_size=2)), max_size=3),
    max_leaves=8,
)


def _walk(tags, path=""):
    for name, value in tags.items():
        at = f"{path}/{name}" if path else name
        if isinstance(value, dict):
            yield from _walk(value, at)
        elif isinstance(value, list):
            for k, item in enumerate(value):
                yield from _walk(item, f"{at}[{k}]")
        else:
            yield at, value


@settings(max_examples=5, deadline=None)
@given(st.lists(_sets, min_size=20, max_size=20))
def test_agrees_with_a_recursive_walk(spark, sets):
    found = _read(_table(spark, *[json.dumps(s) for s in sets]))
    wanted = {(k, path): v for k, s in enumerate(sets) for path, v in _walk(s)}
    assert {k: (r["value"]["i"] or r["value"]["s"])[0] for k, r in found.items()} == wanted


@pytest.mark.parametrize(("text", "depth"), [("{}", 1), ('{"a":[{"b":"]]["}]}', 3), ('{"a":"\\"{{{"}', 1), ("", 0)])
def test_depth(spark, text, depth):
    assert spark.range(1).select(tg.nesting_depth(F.lit(text))).first()[0] == depth


def test_brackets_are_told_from_quoted_ones(spark):
    texts = {
        '{"a":[{"b":"]]}}{{{[[["}]}': 3,
        r'{"a\"{{{":"\\"}': 1,
        '{"open": "[[[': 4,  # a quote that never ends hides nothing
        '"\\\n["': 1,  # nor does one with a line that is broken off
        "": 0,
        "[[],[[]]]": 3,
    }
    rows = spark.createDataFrame(list(texts.items()), "tags string, depth int")
    assert rows.where(tg.nesting_depth(F.col("tags")) != F.col("depth")).count() == 0


def test_a_set_is_not_kept_beside_its_tags(spark):
    """Each tag of a set of many would otherwise carry the whole set through every level below."""
    rows = _table(spark, "{" + ",".join(f'"tag{i}":{i}' for i in range(400)) + ',"deep":{"deeper":{"last":[1,"2"]}},"list":[1,[2,{"a":1}]]}', "null", "[]", "no json", None)
    level = tg._leaves(rows, "id", "tags", 1)
    plan = level._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan.lower() and "schemaofvariant" not in plan.lower()
    found = {r["path"]: r["value"] for r in tg.typed_tags(rows, "id", "tags", types={}).collect()}
    assert len(found) == 402 and found["tag399"]["i"] == [399]
    assert found["deep/deeper/last"]["s"] == ["1", "2"] and found["list"]["s"] == ["1", '[2,{"a":1}]']
    assert {(r["id"], r["reason"]) for r in tg.tag_faults(rows, "id", "tags").collect()} == {(1, "not_tags"), (2, "not_tags"), (3, "not_json")}

"""Shapes of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from cohortweave.operators import reports as rp
from cohortweave.operators import samples as sm
from cohortweave.operators import series as sr
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def slices_table(spark):
    from cohortweave.operators.shared import new_path
    from cohortweave.registry.base import tagged_slices

    path = new_path(spark, "slices-for-plans")
    tagged_slices(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["cohort_manifest", "slice_order", "cohort_join", "required_series", "patient_hierarchy", "batched_cohort"])
def test_no_join_of_everything_with_everything(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(driver.queries()[name](spark, SF_SMALL)))


def test_pixels_are_not_read_where_they_are_not_needed(spark, slices_table):
    for df in (sr.middle_slices(slices_table), sr.series_metadata(slices_table), sr.series_quarantine(slices_table)):
        assert not re.search(r"ReadSchema: struct<[^>]*pixels", plan(df))


def test_one_shuffle_of_slices_for_the_metadata_of_series(spark, slices_table):
    assert plan(sr.series_metadata(slices_table)).count("Exchange") == 1


def test_filters_reach_the_scan(spark, slices_table):
    counts = rp.patients_by_description(slices_table, time_point="T1")
    assert "EqualTo(time_point,T1)" in plan(counts)
    features = spark.read.parquet(f"{SF_SMALL}/part.parquet").withColumnsRenamed({"p_name": "feature_name", "p_partkey": "patient_id"})
    assert "In(p_name" in plan(sm.required_series(features.withColumn("series_id", F.col("p_brand")), ["red bolt", "old bolt"]))


def test_a_group_is_never_ranked_in_one_task(slices_table):
    """Row numbers over range partitions, at every size; the one window is over the partitions."""
    for df in (sr.slice_order(slices_table), sr.middle_slices(slices_table), sr.volume_blocks(slices_table)):
        assert "row_number" not in plan(df)


def test_places_are_found_without_pixels(slices_table):
    assert "pixels" not in plan(sr.slice_order(slices_table))
    assert "pixels" not in plan(sr.middle_slices(slices_table))


@pytest.mark.parametrize("name", ["representative_values", "feature_dedup", "preferred_series", "series_allowlist"])
def test_least_values_are_found_without_sorting(spark, name):
    assert "SortAggregate" not in plan(driver.queries()[name](spark, SF_SMALL))


def test_a_volume_is_never_collected(slices_table):
    blocks = plan(sr.volume_blocks(slices_table))
    assert not re.search("collect_list|ObjectHashAggregate", blocks)
    assert len(re.findall("Exchange hashpartitioning", blocks)) <= 3  # slices and their places, then blocks


def test_slices_are_read_once_for_their_order(spark, slices_table):
    """What comes after reads the narrow table of paths."""
    for df in (sr.slice_order(slices_table), sr.middle_slices(slices_table)):
        assert "slices-for-plans" not in plan(df)

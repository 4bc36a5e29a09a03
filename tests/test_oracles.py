"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    rows = driver.queries()[name](spark, SF_SMALL).toPandas()
    assert len(rows) > 0
    assert compare(rows, duck.execute(driver.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not driver.queries()[name](spark, SF_SMALL).isEmpty()


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_is_the_manifest(spark):
    df = driver.entry(spark)
    assert df.columns == [
        "patient_id", "n_studies", "n_series", "n_slices", "z_lo", "z_hi", "age", "response_group",
    ]
    assert df.count() > 0

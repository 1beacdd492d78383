"""Every registered query beside its SQL on the smallest driver tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql().get(name), SF) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "mean_l_quantity_2" in df.columns


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())

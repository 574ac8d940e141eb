"""Every registered query equals its SQL statement."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from passagework import catalog, oracles


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert len(got) and differences(got, want) == []


def test_entry(spark):
    frame = entry.entry(spark).toPandas()
    assert list(frame["rank"].sort_values()) == [1, 2, 3, 4, 5]

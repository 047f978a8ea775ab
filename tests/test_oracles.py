"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
import compare
from registry.oracles import ORACLES
from registry.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    assert compare.difference(spark, con, sf, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

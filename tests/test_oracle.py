"""Queries against their SQL on the smallest test tables, where these are present."""

import os

import pytest

from checks import compare, oracles
from checks import queries as registry
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CHOSEN = sorted(set(registry.queries()) & set(oracles.oracle_sql()))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert not compare.differences(got, compare.database(SF).execute(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

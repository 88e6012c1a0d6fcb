"""Every check query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.compare import difference, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, con, name):
    assert difference(spark, con, entry.queries()[name], ORACLE[name], sf) is None


def test_entry(spark):
    got = {r.lang: r for r in entry.entry(spark).collect()}
    assert "all" in got and 0 < got["all"].f1 <= 100

"""Queries with SQL against it."""

import pytest

from checks.compare import difference, duck
from spanloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    assert difference(spark, duck(sf), QUERIES[name], ORACLE[name], sf) is None

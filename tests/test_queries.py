"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.queries import ORACLES, QUERIES
from checks.verify import compare, oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    assert name in ORACLES
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


def test_entry_contract():
    import __spark_entry__ as e

    # Queries of optional modules may have none; their tests hold them against plain versions.
    assert set(ORACLES) == set(QUERIES) and ORACLES.items() <= e.oracle_sql().items()
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

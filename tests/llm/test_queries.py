"""The registered queries beside their SQL on the smallest given tables."""

import pytest

from checks.verify import compare, oracle
from vacantia.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, oracle(sf), ORACLES[name]) == ""
    else:
        assert df.count() > 0 and df.columns


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

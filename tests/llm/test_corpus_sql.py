import pytest

from meshwalk.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_sql(name, same):
    same(Q.QUERIES[name], Q.ORACLES[name])

"""Every numbered query that has a SQL twin against it on the smallest tables."""

import pytest

from barlattice.llm import queries

from ..test_oracles import duck, same  # noqa: F401 (duck is a fixture)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])

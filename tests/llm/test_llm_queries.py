"""Queries of the package against their SQL."""

import pytest

from quarryline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(same, name):
    same(QUERIES[name], SQL[name])

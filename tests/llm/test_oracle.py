"""Queries that SQL can express, on the smallest tables."""

import pytest
from check import compare, connect
from samples import SF

from gridlake.llm.oracle import ORACLE
from gridlake.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, SF) is None


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))

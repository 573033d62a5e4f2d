"""The corpus queries against their SQL on the smallest tables, and their columns."""

import pytest

from clickloom import llm
from tests.compare import compare, connect

llm.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, name):
    assert compare(llm.QUERIES[name](spark, SF), connect(SF), llm.ORACLES[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))

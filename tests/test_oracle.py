"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import os

import pytest

from clickloom import catalog
from tests.compare import compare, connect

catalog.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")



@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    problems = compare(df, con, catalog.ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 45 and all(0 < r["map12"] <= 1 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())

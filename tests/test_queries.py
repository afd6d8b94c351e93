"""Every query against its SQL; those without SQL run and return rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import database, difference
from weftline.plans import queries as base


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = base.QUERIES[name](spark, sf_dir)
    if name in base.SQL:
        assert difference(df, con, base.SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

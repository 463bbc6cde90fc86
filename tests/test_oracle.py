"""Every registered query against its SQL, on the same tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as registry
from compare import connect, differences

FOLDER = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = registry.entry(spark)
    assert rows.columns[:3] == ["category", "company", "avg_stars"]
    assert rows.count() > 0

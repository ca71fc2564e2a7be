"""Every registered query against its SQL on the smallest tables, and the flagship."""

from pathlib import Path

import __spark_entry__ as entry
import pytest
from check_queries import compare, database

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


# Queries of the optional subpackage have tests of their own.
OPTIONAL = {*entry.llm_queries.queries(), "pipeline"} if entry.llm_queries else set()
NAMES = [name for name in entry.queries() if name not in OPTIONAL]


def test_every_query_has_sql():
    assert set(NAMES) == set(entry.oracle_sql()) - OPTIONAL


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "asin"

"""The queries of the subpackage beside their SQL, and that all of them are registered."""

from pathlib import Path

import pytest
from check_queries import compare, database

from pagefacts.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_a_query_for_each_operator():
    numbers = sorted(int(name.split("_")[0].removeprefix("op")) for name in queries.queries())
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) is None

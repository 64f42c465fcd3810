"""Every query over the smallest tables against its SQL."""

import pytest
from compare import connect, rows_of, rows_of_sql

from loomtag import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(con, SQL[name])

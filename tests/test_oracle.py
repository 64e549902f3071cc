"""Every query with SQL, on the smallest tables, against DuckDB."""

import pytest
from check_oracle import connect, run

from tidefolio.catalog import oracle_sql, queries
from tidefolio.session import release

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    _, _, diff = run(spark, con, SF, name, queries()[name], SQL[name])
    release(spark)
    assert diff == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())

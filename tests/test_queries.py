"""All queries outside the training-data subpackage beside their SQL, on the smallest tables."""

import duckdb
import pytest

from helixmill import queries
from verify_queries import TABLES, comparable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sql, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(queries.ORACLE_SQL[name]).df()
    a, b = comparable(got), comparable(want)
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)

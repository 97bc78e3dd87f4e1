"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from graphloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isnan(value):
        return repr(round(value, 6) + 0.0) if value != int(value) else str(int(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = plans.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(v) for v in row) for row in found.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(plans.ORACLE_SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(row[at.index(c)]) for c in columns) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF.replace("sf0.001", "sf0.01")).count() > 0

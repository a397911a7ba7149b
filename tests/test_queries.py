"""Every query with SQL against DuckDB, at the smallest size."""

import math

import duckdb
import pytest

from marginalia import queries
from marginalia.catalog import TABLES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.8g}")
    return value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

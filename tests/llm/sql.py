"""Queries with SQL against DuckDB over the driver's tables."""

import duckdb
from marginalia.catalog import TABLES
from marginalia.llm import queries


def equal_rows(spark, name, sf):
    """Asserts that a query's rows are those of its SQL and returns how many there are."""
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    theirs = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=str) == theirs
    return len(theirs)

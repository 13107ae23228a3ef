"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import duckdb
import pytest

from queries import load
from scripts.check_oracle import TABLES, rows_of

REGISTRY = load()


@pytest.fixture(scope="module")
def con(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(name, spark, folder, con):
    df = REGISTRY.QUERIES[name](spark, folder)
    mine, columns = rows_of(df.columns, df.collect())
    if name not in REGISTRY.ORACLES:
        assert mine
        return
    result = con.execute(REGISTRY.ORACLES[name])
    theirs, other = rows_of([d[0] for d in result.description], result.fetchall())
    assert columns == other
    assert mine == theirs


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

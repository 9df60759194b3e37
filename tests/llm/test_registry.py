"""Registered queries, and their SQL where there is any."""

from __future__ import annotations

import pytest

from paraspark.llm import registry

from .conftest import SF

duckdb = pytest.importorskip("duckdb")


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries())
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = connection.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = registry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)

"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import math
import os

import pytest

from __spark_entry__ import entry
from paraspark.plans.oracle import oracle_sql
from paraspark.plans.queries import queries

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    yield connection
    connection.close()


def canonical(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def text(v):
        return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)

    return sorted(tuple(text(row[i]) for i in order) for row in found)


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, database, name):
    df = queries()[name](spark, SF)
    cursor = database.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    types = {r[0]: r[1] for r in database.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert canonical(df.collect(), df.columns) == canonical(expected, columns)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["batch_id", "sample_name", "label", "amount"]
    # 54 sample and chain pairs, and three classes of six samples, per batch.
    assert df.count() == 2 * (54 + 18)

"""Every registered query against its SQL oracle on the supplied tables."""

import decimal
import os

import pytest

import __spark_entry__ as contract
from talentgrid.plans import registry
from talentgrid.plans.fixtures import TABLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
ORACLES = registry.oracles()
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return round(value, 6) if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 90
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    answer = database.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, answer.fetchall())


def test_flagship(spark):
    page = contract.entry(spark).collect()
    assert 0 < len(page) <= 20 and all("Java" in r.skills for r in page)

"""Queries stay right when one key holds a third of the rows and groups are too large for one task."""

import duckdb
import pytest

import __spark_entry__ as contract
from talentgrid.operators import ingest, ordered
from talentgrid.plans.fixtures import TABLES
from tests.test_oracles import FOLDER, table

HOT = {
    "lineitem": "CASE WHEN rowid % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey",
    "events": "CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id",
    "customer": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 100 ELSE c_custkey END AS c_custkey",
    "documents": "CASE WHEN doc_id % 3 = 0 THEN doc_id * 100 ELSE doc_id END AS doc_id",
}
NAMES = [
    "zip_entry_count",
    "zip_duplicate_path",
    "zip_total_size",
    "zip_verdict",
    "discover_cv_files",
    "skip_limit_gate",
    "insert_new_candidates",
    "ingest_uploads",
    "sort_candidates",
    "cleanup_metrics",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    database = duckdb.connect()
    for name in TABLES:
        database.execute(f"CREATE TABLE plain_{name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        column = f"REPLACE ({HOT[name]})" if name in HOT else ""
        database.execute(f"COPY (SELECT * {column} FROM plain_{name}) TO '{folder}/{name}.parquet'")
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, database


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot, name, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", 60)
    monkeypatch.setattr(ingest, "TOLD_UPLOADS", 0)
    folder, database = hot
    df = contract.queries()[name](spark, folder)
    answer = database.execute(contract.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in answer.description], answer.fetchall())

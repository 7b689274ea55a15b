"""Plans keep the shape they were written for."""

import re

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import audit
from talentgrid.operators import ingest as I
from talentgrid.operators.audit import audit_constraints
from talentgrid.operators.search import Criteria, search_candidates
from talentgrid.plans import fixtures, registry
from talentgrid.schemas import TABLES
from talentgrid.settings import BatchLimits
from tests.conftest import plan_of

SMALL = "/root/testdata/sf0.001"
PYTHON_NODES = ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython", "MapInArrow")


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(build(spark, SMALL)) for name, build in registry.queries().items()}


def test_everything_stays_in_the_jvm(plans):
    assert {n for n, p in plans.items() if any(node in p for node in PYTHON_NODES)} == set()


def test_no_cross_joins(plans):
    joins = ("CartesianProduct", "BroadcastNestedLoopJoin")
    assert {n for n, p in plans.items() if any(j in p for j in joins)} == set()


def test_pages_are_top_k(plans):
    for name in ("page_candidates", "search_candidates", "select_cleanup_batch", "page_failures"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_rank_filters_prune_before_the_shuffle(spark, plans):
    assert "WindowGroupLimit" in plans["dedupe_drafts"]
    results = spark.createDataFrame([("u", 1, "X")], "upload_id string, file_no long, error_code string")
    assert "WindowGroupLimit" in plan_of(I.stop_points(results, BatchLimits(4, 3)))


def test_gate_leaves_the_upload_spread(spark):
    # With joins as on large tables, the rank filter after the gate still prunes before its shuffle.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.queries()["insert_new_candidates"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    limits = re.findall(r"WindowGroupLimit \[upload_id#\d+, source_filename#\d+\].*, (Partial|Final)", plan)
    assert sorted(limits) == ["Final", "Partial"]


@pytest.mark.parametrize("told", [I.TOLD_UPLOADS, 0])
def test_texts_end_at_the_scan(spark, monkeypatch, told):
    """Nothing that is shuffled on the ingest path carries a document's text."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = []
    monkeypatch.setattr(I, "TOLD_UPLOADS", told)
    monkeypatch.setattr(I, "fixed", lambda df: seen.append(plan_of(df)) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.queries()["ingest_uploads"](spark, SMALL)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    shuffled = [re.findall(r"(?:Exchange|ShuffleExchange).*", p) for p in seen]
    assert any(shuffled)
    for plan in seen:
        for exchange in re.finditer(r"( *)[:+| -]*Exchange (?:hash|range)partitioning.*\n(.*)", plan):
            below = exchange.group(2)
            if "Project [" in below:
                assert not re.search(r"[\[ ]text#\d+[,\]]", below)


def test_one_shuffle_serves_the_verdict(spark):
    plan = plan_of(registry.queries()["zip_verdict"](spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(upload_id", plan)) <= 2
    grouped = re.findall(r"Aggregate\(keys?=\[([^\]]*)", plan)
    assert grouped and not any("entry_name" in keys or "path" in keys for keys in grouped)


def test_audit_reads_each_table_once(spark, folder):
    tables = {}
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    plan = plan_of(audit_constraints({n: tables[n] for n in audit._PRIMARY}))
    assert len(re.findall(r"FileScan parquet", plan)) == len(audit._PRIMARY)
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_search_filters_and_columns_reach_the_scan(spark, folder):
    schema = (
        "id string, upload_id string, full_name string, years_of_experience int, preferred_location string,"
        " preferred_job_type string, source_filename string, skills array<string>, created_at timestamp, notes string"
    )
    spark.createDataFrame([], schema).write.parquet(folder + "/c")
    people = spark.read.parquet(folder + "/c")
    plan = plan_of(search_candidates(people, Criteria(upload_id="u1", job_type="REMOTE", min_experience=3)))
    for pushed in ("EqualTo(upload_id,u1)", "EqualTo(preferred_job_type,REMOTE)", "GreaterThanOrEqual(years_of_experience,3)"):
        assert pushed in plan
    scan = re.search(r"ReadSchema: struct<(.*)", plan).group(1)
    assert "notes" not in scan and "created_at" not in scan


def test_customers_of_one_row_group_are_read_by_many_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 50)
    people = "id % 300 AS c_custkey, 'c' AS c_name, 0 AS c_nationkey, 1.0D AS c_acctbal, 'BUILDING' AS c_mktsegment"
    spark.range(400).selectExpr(*people.split(", ")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'FRANCE' AS n_name").write.parquet(f"{folder}/nation.parquet")
    spark.sql("SELECT 1L AS doc_id, 'x' AS text, 'en' AS lang").write.parquet(f"{folder}/documents.parquet")
    tables = fixtures.Inputs(spark, folder)
    for name, rows in (("resume_files", 401), ("candidate", 400), ("processing_failure", 400)):
        made = tables[name].groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in made) == rows and max(r["count"] for r in made) <= 100, name
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 500)  # few rows stay where they are
    assert "Exchange" not in plan_of(fixtures.Inputs(spark, folder)["processing_failure"])

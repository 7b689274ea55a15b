"""Bucketed tables: new rows meet stored ones without an exchange of the stored ones."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE
from talentgrid.sources import buckets as B
from tests.conftest import plan_of

NOW = dt.datetime(2024, 1, 1)


def people(spark, names, upload="u1", full="Ann Lee"):
    return spark.createDataFrame([(f"{upload}/{n}", upload, full, 1, None, "REMOTE", n, NOW, ["Java"]) for n in names], CANDIDATE)


def table(spark, folder, layout, buckets=8):
    return B.bucketed(spark, f"t{uuid.uuid4().hex}", f"{folder}/table", layout, buckets)


@pytest.fixture()
def joins_like_large_tables(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def test_rows_are_stored_once(spark, folder):
    stored = table(spark, folder, B.CANDIDATES)
    stored.append(people(spark, ["a.pdf", "b.pdf", "a.pdf"]))
    stored.append(people(spark, ["b.pdf", "c.pdf"], full="Changed").union(people(spark, ["a.pdf"], "u2")))
    for _ in range(2):  # a rerun
        stored.append(people(spark, ["b.pdf", "c.pdf"], full="Changed"))
    rows = sorted((r.upload_id, r.source_filename, r.full_name) for r in stored.rows().collect())
    assert rows == [("u1", "a.pdf", "Ann Lee"), ("u1", "b.pdf", "Ann Lee"), ("u1", "c.pdf", "Changed"), ("u2", "a.pdf", "Ann Lee")]
    stored.append(people(spark, []))
    # another session knows the folder under another name
    again = B.bucketed(spark, f"t{uuid.uuid4().hex}", f"{folder}/table", B.CANDIDATES, 8)
    assert again.rows().count() == 4 and again.new(people(spark, ["a.pdf", "d.pdf"])).count() == 1


def test_failures_by_id(spark, folder):
    stored = table(spark, folder, B.FAILURES)
    rows = [("1", "u1", "a.pdf", "X", None, NOW), ("1", "u1", "a.pdf", "X", None, NOW), ("2", "u1", "b.pdf", "Y", "why", NOW)]
    for _ in range(2):
        stored.append(spark.createDataFrame(rows, PROCESSING_FAILURE))
    assert sorted(r.id for r in stored.rows().collect()) == ["1", "2"]


@pytest.mark.parametrize("layout", [B.CANDIDATES, B.FAILURES])
def test_stored_rows_are_not_shuffled(spark, folder, joins_like_large_tables, layout):
    stored = table(spark, folder, layout)
    fresh = spark.createDataFrame([], layout.schema)
    plan = plan_of(stored.new(fresh))
    new_side, stored_side = plan[plan.index("SortMergeJoin") :].split("\n+- ")
    assert "Exchange" in new_side and "FileScan" not in new_side
    assert "Bucketed: true" in stored_side and "Exchange" not in stored_side
    scanned = re.search(r"ReadSchema: struct<([^>]*)>", stored_side).group(1)
    assert [c.split(":")[0] for c in scanned.split(",")] == list(layout.key)


def test_hot_upload_is_in_many_buckets(spark, folder):
    stored = table(spark, folder, B.CANDIDATES)
    stored.append(people(spark, [f"{i}.pdf" for i in range(200)]))
    files = stored.rows().select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 8 and max(r["count"] for r in files) < 60

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import logs as G
from talentgrid.operators import retention as C
from talentgrid.settings import Retention

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def uploads(spark):
    rows = []
    for status in ("UPLOADED", "PROCESSING", "COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED"):
        for age in (2, 7, 9, 30):
            rows.append((f"{status[:2]}{len(rows):02d}", status, NOW - dt.timedelta(days=age)))
        rows.append((f"{status[:2]}{len(rows):02d}", status, None))
    return spark.createDataFrame(rows, "id string, status string, completed_at timestamp")


def test_eligibility_bound_is_inclusive(spark):
    due = C.cleanup_eligible(uploads(spark), F.lit(NOW), Retention(days=7)).collect()
    assert len(due) == 6 and {r.status for r in due} == {"COMPLETED", "COMPLETED_WITH_ERRORS"}
    assert {(NOW - r.completed_at.replace(tzinfo=dt.timezone.utc)).days for r in due} == {7, 9, 30}
    assert C.cleanup_eligible(uploads(spark), F.lit(NOW), Retention(enabled=False)).count() == 0


def test_batch_is_oldest_first_without_cleaned(spark):
    table = uploads(spark)
    oldest = table.filter("status = 'COMPLETED'").orderBy("completed_at").filter("completed_at is not null").first()
    records = spark.createDataFrame([(oldest.id,)], "upload_id string")
    batch = C.select_cleanup_batch(table, records, F.lit(NOW), Retention(days=7, batch_size=2)).collect()
    assert [(NOW - r.completed_at.replace(tzinfo=dt.timezone.utc)).days for r in batch] == [30, 9]
    for bad in ({"days": 0}, {"batch_size": 0}, {"batch_size": 1001}):
        with pytest.raises(ValueError):
            Retention(**bad)


def test_outcomes_records_and_runs(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    listing = spark.createDataFrame([("a", True), ("b", False)], "upload_id string, deletable boolean")
    outcomes = C.cleanup_outcome(batch, listing)
    assert {r.id: r.outcome for r in outcomes.collect()} == {"a": "deleted", "b": "failed", "c": "already_absent"}
    additions = C.cleanup_records(outcomes, F.lit(NOW))
    known = spark.createDataFrame([("a", NOW)], "upload_id string, cleaned_at timestamp")
    assert [r.upload_id for r in C.new_cleanup_records(known, additions.union(additions)).collect()] == ["c"]
    run = C.cleanup_run_summary(outcomes.withColumn("run_id", F.lit(1))).first()
    assert (run.selected, run.deleted, run.already_absent, run.failed, run.completed) == (3, 1, 1, 1, 2)


def test_metrics(spark):
    rows = [
        (1, NOW, 5, False, 3, 2, 1, 0),
        (2, NOW + dt.timedelta(hours=1), 9, True, 8, 8, 0, 0),
        (3, NOW + dt.timedelta(hours=2), 2, False, 4, 1, 1, 2),
    ]
    runs = spark.createDataFrame(
        rows,
        "run_id int, started_at timestamp, duration_ms long, run_failed boolean, selected long, deleted long,"
        " already_absent long, failed long",
    )
    last = C.cleanup_metrics(runs).orderBy("run_id").collect()[-1]
    assert (last.total_selected, last.total_failed, last.total_runs, last.total_run_failures) == (7, 2, 2, 1)
    total = C.cleanup_totals(runs).first()
    assert (total.duration_count, total.duration_sum_ms, total.duration_max_ms) == (3, 16, 9)
    assert total.last_success.replace(tzinfo=dt.timezone.utc) == NOW


def test_storage_guard(spark):
    paths = {
        "/data/up/u1": False,
        "/data/up/u1/cvs/../x": False,
        "/data/up": True,
        "/data/up/": True,
        "/data/up/staging": True,
        "/data/up/staging/s1": False,
        "/data/up/u1/..": True,
        "/data/up/../up2/x": True,
        "/data/upper/x": True,
        "data/up/u1": True,
        "/": True,
        "/../data/./up//u1": False,
        "": True,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.refused for r in C.guard_storage_path(df, "/data/up").collect()} == paths


def test_access_log(spark):
    lines = [
        "2024 INFO HTTP_ACCESS method=GET path=/a status=200 durationMs=12 correlationId=abc",
        "HTTP_ACCESS method=GET path=/b status=503 durationMs=0 correlationId=-",
        "HTTP_ACCESS method=GET path=/b status=xx durationMs=0 correlationId=-",
        "other",
        None,
    ]
    parsed, rejected = G.parse_access_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [tuple(r) for r in parsed.collect()] == [("GET", "/a", 200, 12, "abc"), ("GET", "/b", 503, 0, None)]
    assert rejected.count() == 3


def test_job_log(spark):
    lines = [
        "CV_PROCESSING_JOB_STARTED uploadId=u jobExecutionId=1 batchStatus=STARTED",
        "CV_PROCESSING_JOB_COMPLETED uploadId=u jobExecutionId=1 batchStatus=COMPLETED exitCode=COMPLETED",
        "CV_PROCESSING_JOB_FAILED uploadId=u jobExecutionId=1 batchStatus=FAILED exitCode=-",
        "CV_PROCESSING_JOB_LOST uploadId=u jobExecutionId=1 batchStatus=FAILED exitCode=-",
    ]
    parsed, rejected = G.parse_job_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.event, r.exit_code) for r in parsed.collect()] == [
        ("STARTED", None),
        ("COMPLETED", "COMPLETED"),
        ("FAILED", None),
    ]
    assert rejected.count() == 1


def test_health_and_correlation_ids(spark):
    paths = ["/livez", "/readyz", "/actuator/health", "/actuator/health/db", "/actuator/healthy", "/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in G.drop_health_requests(df).collect()] == ["/actuator/healthy", "/x"]
    given = ["a-B.1:_", "x" * 128, "x" * 129, "", "a b", "a\n", None]
    ids = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, correlation_id string")
    out = [r.correlation_id for r in G.with_correlation_id(ids).orderBy("i").collect()]
    assert out[:2] == given[:2] and all(len(v) == 36 for v in out[2:]) and len(set(out)) == 7

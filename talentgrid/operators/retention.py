"""Which stored uploads are due for cleanup, and what a cleanup run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.paths import normalize_absolute
from talentgrid.operators.ordered import running
from talentgrid.settings import Retention

DONE = ("COMPLETED", "COMPLETED_WITH_ERRORS")


def cleanup_eligible(uploads: DataFrame, now: Column, retention: Retention = Retention()) -> DataFrame:
    if not retention.enabled:
        return uploads.limit(0)
    cutoff = now - F.expr(f"interval {retention.days} days")
    due = F.col("completed_at").isNotNull() & (F.col("completed_at") <= cutoff)
    return uploads.filter(F.col("status").isin(*DONE) & due)


def select_cleanup_batch(
    uploads: DataFrame, records: DataFrame, now: Column, retention: Retention = Retention()
) -> DataFrame:
    """The oldest eligible uploads that have no cleanup record."""
    due = cleanup_eligible(uploads, now, retention)
    cleaned = records.select(F.col("upload_id").alias("id"))
    return due.join(cleaned, "id", "left_anti").orderBy("completed_at", "id").limit(retention.batch_size)


def cleanup_outcome(batch: DataFrame, listing: DataFrame) -> DataFrame:
    """deleted, already_absent or failed per upload.

    ``listing`` has one row per stored folder: upload_id and deletable.
    """
    joined = batch.join(listing.withColumnRenamed("upload_id", "id"), "id", "left")
    outcome = (
        F.when(F.col("deletable").isNull(), "already_absent")
        .when(F.col("deletable"), "deleted")
        .otherwise("failed")
    )
    return joined.withColumn("outcome", outcome).drop("deletable")


def cleanup_records(outcomes: DataFrame, now: Column) -> DataFrame:
    done = outcomes.filter(F.col("outcome") != "failed")
    return done.select(F.col("id").alias("upload_id"), now.alias("cleaned_at"))


def new_cleanup_records(records: DataFrame, additions: DataFrame) -> DataFrame:
    """Records to append: one per upload, and only for uploads that have none."""
    firsts = additions.groupBy("upload_id").agg(F.min("cleaned_at").alias("cleaned_at"))
    return firsts.join(records.select("upload_id"), "upload_id", "left_anti")


def guard_storage_path(paths: DataFrame, root: str) -> DataFrame:
    """Add ``refused``: the path is the root, its staging folder, or outside the root."""
    base = root.strip("/")
    absolute = F.col("path").startswith("/")
    norm = F.when(absolute, normalize_absolute(F.col("path"))).otherwise("")
    refused = (norm == base) | (norm == f"{base}/staging") | ~norm.startswith(base + "/")
    return paths.withColumn("refused", refused)


def cleanup_run_summary(outcomes: DataFrame) -> DataFrame:
    def count(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name)

    grouped = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("selected"),
        count("deleted"),
        count("already_absent"),
        count("failed"),
    )
    return grouped.withColumn("completed", F.col("deleted") + F.col("already_absent"))


def cleanup_metrics(runs: DataFrame) -> DataFrame:
    """Counters after each run, in time order.

    ``runs`` has run_id, started_at, duration_ms, run_failed and the summary columns; a failed run
    counts apart and adds no items.
    """
    ok = ~F.col("run_failed")
    names = ("selected", "deleted", "already_absent", "failed")
    sums = {f"total_{n}": F.when(ok, F.col(n)).otherwise(0) for n in names}
    sums["total_runs"] = F.when(ok, 1).otherwise(0)
    sums["total_run_failures"] = F.when(ok, 0).otherwise(1)
    sums["total_duration_ms"] = F.col("duration_ms")
    columns = ["run_id", "started_at", *sums]
    return running(runs, [], ["started_at", "run_id"], sums=sums).select(*columns)


def cleanup_totals(runs: DataFrame) -> DataFrame:
    """The counters after the last run, plus the slowest run and the last clean one."""
    ok = ~F.col("run_failed")
    clean = ok & (F.col("failed") == 0)
    return runs.agg(
        F.count_if(ok).alias("runs"),
        F.count_if(~ok).alias("run_failures"),
        *[
            F.coalesce(F.sum(F.when(ok, F.col(n))), F.lit(0)).alias(n)
            for n in ("selected", "deleted", "already_absent", "failed")
        ],
        F.count(F.lit(1)).alias("duration_count"),
        F.sum("duration_ms").alias("duration_sum_ms"),
        F.max("duration_ms").alias("duration_max_ms"),
        F.max(F.when(clean, F.col("started_at"))).alias("last_success"),
    )

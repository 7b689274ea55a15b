"""Log lines to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.requests import (
    ACCESS_LINE,
    JOB_LINE,
    is_health_path,
    resolve_correlation_id,
)


def _group(pattern: str, index: int) -> Column:
    return F.regexp_extract("line", pattern, index)


def _absent(value: Column) -> Column:
    return F.when(~value.isin("", "-"), value)


def parse_access_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed requests, and the lines that are none."""
    good = F.col("line").rlike(ACCESS_LINE)
    rest = [c for c in lines.columns if c != "line"]
    parsed = lines.filter(good).select(
        *rest,
        _group(ACCESS_LINE, 1).alias("method"),
        _group(ACCESS_LINE, 2).alias("path"),
        _group(ACCESS_LINE, 3).cast("int").alias("status"),
        _group(ACCESS_LINE, 4).cast("long").alias("duration_ms"),
        _absent(_group(ACCESS_LINE, 5)).alias("correlation_id"),
    )
    return parsed, lines.filter(~F.coalesce(good, F.lit(False)))


def parse_job_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("line").rlike(JOB_LINE)
    rest = [c for c in lines.columns if c != "line"]
    parsed = lines.filter(good).select(
        *rest,
        _group(JOB_LINE, 1).alias("event"),
        _group(JOB_LINE, 2).alias("upload_id"),
        _group(JOB_LINE, 3).alias("job_execution_id"),
        _group(JOB_LINE, 4).alias("batch_status"),
        _absent(_group(JOB_LINE, 5)).alias("exit_code"),
    )
    return parsed, lines.filter(~F.coalesce(good, F.lit(False)))


def drop_health_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(~is_health_path(F.col("path")))


def with_correlation_id(requests: DataFrame, column: str = "correlation_id") -> DataFrame:
    return requests.withColumn(column, resolve_correlation_id(F.col(column)))

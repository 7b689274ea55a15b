"""Columns over request and log tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions.patterns import CORRELATION_ID
from talentgrid.functions.text import is_blank

# The routes, log line formats and the segment of each policy in a bucket key.
UPLOADS = "/api/v1/uploads"
CANDIDATES = "/api/v1/candidates"
EXPORTS = ("/api/v1/candidates/export.csv", "/api/v1/candidates/export.xlsx")
ONE_UPLOAD = r"^/api/v1/uploads/[^/]+(?:/failures)?\z"
HEALTH_PATHS = ("/livez", "/readyz", "/actuator/health")
HEALTH_PREFIX = "/actuator/health/"
ACCESS_LINE = (
    r"HTTP_ACCESS method=(\S+) path=(\S+) status=(\d{3}) durationMs=(\d+) correlationId=(\S+)\s*$"
)
JOB_LINE = (
    r"CV_PROCESSING_JOB_(STARTED|COMPLETED|FAILED) uploadId=(\S+) jobExecutionId=(\S+)"
    r" batchStatus=(\S+)(?: exitCode=(\S+))?\s*$"
)


def resolve_policy(method: Column, path: Column) -> Column:
    get = method == "GET"
    return (
        F.when((method == "POST") & (path == UPLOADS), "UPLOAD")
        .when(get & path.isin(*EXPORTS), "EXPORT")
        .when(get & ((path == CANDIDATES) | path.rlike(ONE_UPLOAD)), "READ")
    )


def bucket_key(policy: Column, principal: Column, prefix: str = "rate-limit") -> Column:
    return F.concat_ws(":", F.lit(prefix), F.lower(policy), F.sha2(principal, 256))


def is_known_principal(principal: Column) -> Column:
    return principal.isNotNull() & ~is_blank(principal) & (principal != "anonymousUser")


def is_health_path(path: Column) -> Column:
    return path.isin(*HEALTH_PATHS) | path.startswith(HEALTH_PREFIX)


def is_correlation_id(value: Column) -> Column:
    return F.coalesce(value.rlike(CORRELATION_ID) & ~value.endswith("\n"), F.lit(False))


def resolve_correlation_id(value: Column) -> Column:
    return F.when(is_correlation_id(value), value).otherwise(F.expr("uuid()"))

"""Queries over requests, logs and stored uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions.requests import bucket_key, is_correlation_id
from talentgrid.operators import logs as G
from talentgrid.operators import ratelimit as L
from talentgrid.operators import retention as C
from talentgrid.plans.catalog import oracle_step, query
from talentgrid.plans.fixtures import stored_tables
from talentgrid.schemas import TABLES
from talentgrid.settings import Retention

RETENTION = Retention(days=7, batch_size=50)


def _now():
    return F.to_timestamp_ntz(F.lit("2001-08-01 00:00:00"))


oracle_step(
    "policies",
    r"""
    SELECT *, CASE WHEN method = 'POST' AND path = '/api/v1/uploads' THEN 'UPLOAD'
        WHEN method <> 'GET' THEN NULL
        WHEN path IN ('/api/v1/candidates/export.csv', '/api/v1/candidates/export.xlsx') THEN 'EXPORT'
        WHEN path = '/api/v1/candidates' OR regexp_full_match(path, '/api/v1/uploads/[^/]+(/failures)?') THEN 'READ'
        END AS policy
    FROM requests""",
)
oracle_step(
    "eligible",
    """
    SELECT * FROM policies WHERE policy IS NOT NULL AND principal IS NOT NULL AND trim(principal) <> ''
        AND principal <> 'anonymousUser'""",
)
@query("resolve_policy", "SELECT request_id, policy FROM policies")
def _(t):
    return L.with_policy(t["requests"]).select("request_id", "policy")


@query(
    "bucket_key",
    "SELECT request_id, 'rate-limit:' || lower(policy) || ':' || sha256(principal) AS bucket_key FROM eligible",
)
def _(t):
    rows = L.eligible_requests(t["requests"])
    return rows.select("request_id", bucket_key(F.col("policy"), F.col("principal")).alias("bucket_key"))


@query("eligible_requests", "SELECT request_id, policy, principal FROM eligible")
def _(t):
    return L.eligible_requests(t["requests"]).select("request_id", "policy", "principal")


@query(
    "parse_access_log",
    r"""
    SELECT request_id, regexp_extract(line, 'method=(\S+)', 1) AS method, regexp_extract(line, ' path=(\S+)', 1) AS path,
        cast(regexp_extract(line, 'status=(\d+)', 1) AS int) AS status,
        cast(regexp_extract(line, 'durationMs=(\d+)', 1) AS bigint) AS duration_ms,
        nullif(regexp_extract(line, 'correlationId=(\S+)', 1), '-') AS correlation_id
    FROM access_log WHERE line LIKE '%correlationId=%'""",
)
def _(t):
    parsed, _ = G.parse_access_log(t["access_log"])
    return parsed


@query(
    "parse_access_log_rejects",
    "SELECT request_id, line FROM access_log WHERE line NOT LIKE '%correlationId=%'",
)
def _(t):
    return G.parse_access_log(t["access_log"])[1]


@query(
    "parse_job_log",
    r"""
    SELECT upload, regexp_extract(line, 'JOB_([A-Z]+)', 1) AS event, regexp_extract(line, 'uploadId=(\S+)', 1) AS upload_id,
        regexp_extract(line, 'jobExecutionId=(\S+)', 1) AS job_execution_id,
        regexp_extract(line, 'batchStatus=(\S+)', 1) AS batch_status,
        nullif(nullif(regexp_extract(line, 'exitCode=(\S+)', 1), ''), '-') AS exit_code
    FROM job_log WHERE line NOT LIKE '%JOB_UNKNOWN%'""",
)
def _(t):
    return G.parse_job_log(t["job_log"])[0]


@query(
    "drop_health_requests",
    """
    SELECT request_id, path FROM requests WHERE path NOT IN ('/livez', '/readyz', '/actuator/health')
        AND path NOT LIKE '/actuator/health/%'""",
)
def _(t):
    return G.drop_health_requests(t["requests"]).select("request_id", "path")


@query(
    "resolve_correlation_id",
    r"""
    SELECT request_id, coalesce(regexp_full_match(correlation_id, '[A-Za-z0-9._:-]{1,128}'), false) AS kept,
        CASE WHEN regexp_full_match(correlation_id, '[A-Za-z0-9._:-]{1,128}') THEN correlation_id END AS correlation_id
    FROM requests""",
)
def _(t):
    kept = t["requests"].withColumn("kept", is_correlation_id(F.col("correlation_id")))
    known = F.when(F.col("kept"), F.col("correlation_id")).alias("correlation_id")
    return G.with_correlation_id(kept).select("request_id", "kept", known)


oracle_step(
    "due_uploads",
    """
    SELECT * FROM cv_upload WHERE status IN ('COMPLETED', 'COMPLETED_WITH_ERRORS')
        AND completed_at <= TIMESTAMP '2001-07-25 00:00:00'""",
)
oracle_step(
    "cleanup_batch",
    """
    SELECT id, completed_at FROM due_uploads WHERE id NOT IN (SELECT upload_id FROM upload_storage_cleanup)
    ORDER BY completed_at, id LIMIT 50""",
)
oracle_step(
    "due_outcomes",
    """
    SELECT d.id, CASE WHEN l.upload_id IS NULL THEN 'already_absent' WHEN l.deletable THEN 'deleted'
        ELSE 'failed' END AS outcome
    FROM due_uploads AS d LEFT JOIN storage_listing AS l ON l.upload_id = d.id""",
)


@query("cleanup_eligible", "SELECT id, completed_at FROM due_uploads")
def _(t):
    return C.cleanup_eligible(t["cv_upload"], _now(), RETENTION).select("id", "completed_at")


@query("select_cleanup_batch", "SELECT id, completed_at FROM cleanup_batch")
def _(t):
    batch = C.select_cleanup_batch(t["cv_upload"], t["upload_storage_cleanup"], _now(), RETENTION)
    return batch.select("id", "completed_at")


def _outcomes(t):
    due = C.cleanup_eligible(t["cv_upload"], _now(), RETENTION)
    return C.cleanup_outcome(due, t["storage_listing"])


@query("cleanup_outcome", "SELECT id, outcome FROM due_outcomes")
def _(t):
    return _outcomes(t).select("id", "outcome")


@query(
    "append_cleanup_records",
    """
    SELECT id AS upload_id, TIMESTAMP '2001-08-01 00:00:00' AS cleaned_at FROM due_outcomes
    WHERE outcome <> 'failed' AND id NOT IN (SELECT upload_id FROM upload_storage_cleanup)""",
)
def _(t):
    return C.new_cleanup_records(t["upload_storage_cleanup"], C.cleanup_records(_outcomes(t), _now()))


@query(
    "guard_storage_path",
    r"""
    SELECT path, norm IN ('data/uploads', 'data/uploads/staging')
        OR norm NOT LIKE 'data/uploads/%' AS refused
    FROM (
        SELECT path, list_reduce(string_split(path, '/'),
            lambda a, p: CASE WHEN p IN ('', '.') THEN a
                WHEN p = '..' THEN CASE WHEN position('/' IN a) = 0 THEN '' ELSE regexp_replace(a, '/[^/]*$', '') END
                WHEN a = '' THEN p ELSE a || '/' || p END, '') AS norm
        FROM storage_paths
    ) AS p""",
)
def _(t):
    return C.guard_storage_path(t["storage_paths"], "/data/uploads")


@query(
    "cleanup_run_summary",
    """
    SELECT run_id, count(*) AS selected, count(*) FILTER (WHERE outcome = 'deleted') AS deleted,
        count(*) FILTER (WHERE outcome = 'already_absent') AS already_absent,
        count(*) FILTER (WHERE outcome = 'failed') AS failed,
        count(*) FILTER (WHERE outcome IN ('deleted', 'already_absent')) AS completed
    FROM cleanup_items GROUP BY run_id""",
)
def _(t):
    return C.cleanup_run_summary(t["cleanup_items"])


_SUMS = ", ".join(
    f"cast(sum(CASE WHEN run_failed THEN 0 ELSE {n} END) OVER w AS bigint) AS total_{n}"
    for n in ("selected", "deleted", "already_absent", "failed")
)


@query(
    "cleanup_metrics",
    f"""
    SELECT run_id, started_at, {_SUMS},
        cast(sum(CASE WHEN run_failed THEN 0 ELSE 1 END) OVER w AS bigint) AS total_runs,
        cast(sum(CASE WHEN run_failed THEN 1 ELSE 0 END) OVER w AS bigint) AS total_run_failures,
        cast(sum(duration_ms) OVER w AS bigint) AS total_duration_ms
    FROM cleanup_runs WINDOW w AS (ORDER BY started_at, run_id)""",
)
def _(t):
    return C.cleanup_metrics(t["cleanup_runs"])


@query(
    "cleanup_totals",
    """
    SELECT count(*) FILTER (WHERE NOT run_failed) AS runs, count(*) FILTER (WHERE run_failed) AS run_failures,
        cast(sum(selected) FILTER (WHERE NOT run_failed) AS bigint) AS selected,
        cast(sum(deleted) FILTER (WHERE NOT run_failed) AS bigint) AS deleted,
        cast(sum(already_absent) FILTER (WHERE NOT run_failed) AS bigint) AS already_absent,
        cast(sum(failed) FILTER (WHERE NOT run_failed) AS bigint) AS failed,
        count(*) AS duration_count, cast(sum(duration_ms) AS bigint) AS duration_sum_ms,
        cast(max(duration_ms) AS bigint) AS duration_max_ms,
        max(started_at) FILTER (WHERE NOT run_failed AND failed = 0) AS last_success
    FROM cleanup_runs""",
)
def _(t):
    return C.cleanup_totals(t["cleanup_runs"])


@query(
    "load_tables",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES),
)
def _(t):
    tables = stored_tables(t)
    parts = [tables[n].groupBy(F.lit(n).alias("table_name")).agg(F.count(F.lit(1)).alias("n")) for n in TABLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out

"""Queries of the ingest path. Test limits: chunks of 4 files, 3 skips, 12,000 characters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talentgrid.functions.text import clean_message
from talentgrid.operators import ingest as I
from talentgrid.operators.audit import audit_constraints, cascade_delete_uploads, delete_candidates
from talentgrid.operators.candidates import extract_candidates
from talentgrid.operators.documents import classify_document
from talentgrid.plans.archive_queries import LIMITS
from talentgrid.plans.catalog import oracle_step, query
from talentgrid.plans.extraction_queries import PARSING
from talentgrid.session import staging_folder
from talentgrid.settings import BatchLimits
from talentgrid.sources.buckets import CANDIDATES, FAILURES, Layout, bucketed
from talentgrid.sources.tables import new_failures

BATCH = BatchLimits(chunk_size=4, skip_limit=3)

oracle_step(
    "cv_files",
    r"""
    SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY rel_path) AS file_no
    FROM resume_files WHERE regexp_matches(lower(rel_path), '[.](pdf|docx)$')""",
)
oracle_step(
    "results",
    r"""
    SELECT n.upload_id, n.rel_path, n.file_no, cast(floor((n.file_no - 1) / 4) AS bigint) AS chunk_no,
        coalesce(c.error_code, CASE WHEN f.full_name IS NULL THEN 'CANDIDATE_EXTRACTION_FAILED' END) AS error_code,
        coalesce(c.error_message, CASE WHEN f.full_name IS NULL
            THEN 'Candidate full name could not be extracted' END) AS error_message,
        f.full_name, f.years, f.location, f.job_type, array_to_string(f.skills, '|') AS skills,
        regexp_replace(n.rel_path, '^.*/', '') AS filename
    FROM cv_files AS n
    JOIN classified AS c ON c.upload_id = n.upload_id AND c.rel_path = n.rel_path
    LEFT JOIN clean_fields AS f ON f.upload_id = n.upload_id AND f.rel_path = n.rel_path""",
)
oracle_step(
    "gated",
    """
    SELECT r.*, s.stop_chunk IS NOT NULL AS upload_failed,
        s.stop_chunk IS NULL OR r.chunk_no < s.stop_chunk AS kept
    FROM results AS r LEFT JOIN (
        SELECT upload_id, min(chunk_no) AS stop_chunk FROM (
            SELECT upload_id, chunk_no, sum(CASE WHEN error_code IS NOT NULL THEN 1 ELSE 0 END)
                OVER (PARTITION BY upload_id ORDER BY file_no) AS failed_so_far
            FROM results
        ) AS w WHERE failed_so_far > 3 GROUP BY upload_id
    ) AS s ON s.upload_id = r.upload_id""",
)
oracle_step("stored", "SELECT upload_id, source_filename FROM candidate WHERE segment = 'BUILDING'")
oracle_step(
    "first_drafts",
    """
    SELECT * FROM results WHERE error_code IS NULL
    QUALIFY row_number() OVER (PARTITION BY upload_id, filename ORDER BY file_no) = 1""",
)

_KEY = ["upload_id", "rel_path"]


def _now():
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))


def _stored(t):
    return t["candidate"].filter("segment = 'BUILDING'")


def _files(t):
    files, _ = I.discover_cv_files(t["uploads"], _listing(t))
    return files


def _listing(t):
    return t["resume_files"].select(*_KEY, F.lit(True).alias("is_regular"))


def _results(t):
    return I.ingest_results(t["resume_files"], PARSING, BATCH)


@query(
    "discover_cv_files",
    """
    SELECT upload_id, file_no, rel_path, NULL AS error FROM cv_files UNION ALL
    SELECT upload_id, NULL, NULL, 'No CV files found for upload: ' || upload_id FROM uploads
    WHERE upload_id NOT IN (SELECT upload_id FROM cv_files)""",
)
def _(t):
    files, empty = I.discover_cv_files(t["uploads"], _listing(t))
    found = files.select("upload_id", "file_no", "rel_path")
    return found.unionByName(empty.select("upload_id", "error"), allowMissingColumns=True)


@query(
    "process_documents",
    """
    SELECT c.upload_id, c.rel_path, f.full_name, CASE WHEN f.full_name IS NOT NULL THEN f.years END AS years_of_experience,
        CASE WHEN f.full_name IS NOT NULL THEN f.location END AS preferred_location,
        CASE WHEN f.full_name IS NOT NULL THEN f.job_type END AS preferred_job_type,
        CASE WHEN f.full_name IS NOT NULL THEN array_to_string(f.skills, '|') END AS skills,
        coalesce(c.error_code, CASE WHEN f.full_name IS NULL THEN 'CANDIDATE_EXTRACTION_FAILED' END) AS error_code
    FROM classified AS c
    LEFT JOIN clean_fields AS f ON f.upload_id = c.upload_id AND f.rel_path = c.rel_path""",
)
def _(t):
    results = I.process_documents(t["resume_files"], PARSING)
    return results.select(
        *_KEY,
        "full_name",
        "years_of_experience",
        "preferred_location",
        "preferred_job_type",
        F.array_join("skills", "|").alias("skills"),
        "error_code",
    )


@query(
    "validate_drafts",
    """
    SELECT id, CASE WHEN full_name IS NULL THEN 'CandidateDraft must not be null'
        WHEN trim(name) = '' THEN 'Candidate sourceFilename must not be blank' END AS error
    FROM (SELECT *, CASE preferred_job_type WHEN 'REMOTE' THEN '  ' ELSE source_filename END AS name
        FROM candidate) AS c""",
)
def _(t):
    blanked = F.when(F.col("preferred_job_type") == "REMOTE", "  ").otherwise(F.col("source_filename"))
    drafts = t["candidate"].withColumns(
        {"source_filename": blanked, "is_null_draft": F.col("full_name").isNull()}
    )
    good, bad = I.validate_drafts(drafts)
    return good.select("id").unionByName(bad.select("id", "error"), allowMissingColumns=True)


@query("dedupe_drafts", "SELECT upload_id, filename AS source_filename, rel_path FROM first_drafts")
def _(t):
    drafts = _results(t).filter("error_code IS NULL")
    return I.dedupe_drafts(drafts).select("upload_id", "source_filename", "rel_path")


@query(
    "find_existing_filenames",
    """
    SELECT upload_id, source_filename FROM stored AS s
    WHERE EXISTS (SELECT 1 FROM cv_files AS f WHERE f.upload_id = s.upload_id
        AND regexp_replace(f.rel_path, '^.*/', '') = s.source_filename)""",
)
def _(t):
    wanted = _files(t).withColumn("source_filename", F.substring_index("rel_path", "/", -1))
    return I.find_existing_filenames(_stored(t), wanted)


@query(
    "insert_new_candidates",
    """
    SELECT sha256(upload_id || '/' || filename) AS id, upload_id, filename AS source_filename, full_name,
        years AS years_of_experience, location AS preferred_location, job_type AS preferred_job_type, skills
    FROM first_drafts AS d WHERE NOT EXISTS (
        SELECT 1 FROM stored AS s WHERE s.upload_id = d.upload_id AND s.source_filename = d.filename)""",
)
def _(t):
    drafts = _results(t).filter("error_code IS NULL")
    return I.insert_new_candidates(drafts, _stored(t)).select(
        "id",
        "upload_id",
        "source_filename",
        "full_name",
        "years_of_experience",
        "preferred_location",
        "preferred_job_type",
        F.array_join("skills", "|").alias("skills"),
    )


@query(
    "skip_limit_gate",
    "SELECT upload_id, rel_path, file_no, chunk_no, upload_failed, kept FROM gated",
)
def _(t):
    return _results(t).select(*_KEY, "file_no", "chunk_no", "upload_failed", "kept")


@query(
    "resolve_error_code",
    """
    SELECT c.upload_id, c.rel_path, CASE WHEN c.error_code IS NOT NULL THEN c.error_code
        WHEN f.full_name IS NULL THEN 'CANDIDATE_EXTRACTION_FAILED' ELSE 'PROCESSING_FAILED' END AS code
    FROM classified AS c
    LEFT JOIN clean_fields AS f ON f.upload_id = c.upload_id AND f.rel_path = c.rel_path""",
)
def _(t):
    tried = extract_candidates(classify_document(t["resume_files"], PARSING))
    return tried.select(*_KEY, I.resolve_error_code(F.col("error_code"), F.col("error")).alias("code"))


@query(
    "sanitize_error_message",
    r"""
    SELECT upload_id, rel_path, CASE WHEN text IS NULL THEN 'Unknown processing failure'
        WHEN NOT regexp_matches(text, '\S') THEN 'ParseError' ELSE substring(regexp_replace(
            regexp_replace(text, '[\r\n]+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), 1, 1000) END AS message
    FROM resume_files""",
)
def _(t):
    return t["resume_files"].select(*_KEY, clean_message(F.col("text"), "ParseError").alias("message"))


@query(
    "build_failures",
    """
    SELECT sha256(upload_id || '/' || rel_path) AS id, upload_id, filename, error_code, error_message,
        TIMESTAMP '2024-02-01 00:00:00' AS created_at
    FROM gated WHERE kept AND error_code IS NOT NULL""",
)
def _(t):
    return I.build_failures(_results(t).filter("kept"), _now())


@query(
    "append_failures",
    "SELECT id, error_code FROM processing_failure WHERE error_code <> 'PARSE_FAILED'",
)
def _(t):
    failures = t["processing_failure"]
    delivered_twice = failures.unionAll(failures)
    stored = failures.filter("error_code = 'PARSE_FAILED'")
    return new_failures(stored, delivered_twice).select("id", "error_code")


def _bucketed(t, layout: Layout, stored, rows):
    """A new bucketed table with the stored rows, to which the others are appended twice."""
    name = f"stored_{uuid.uuid4().hex}"
    table = bucketed(t.spark, name, f"{staging_folder(t.spark)}/{name}", layout, buckets=16)
    for part in (stored, rows, rows):
        table.append(part)
    return table.rows()


@query(
    "append_candidates",
    """
    SELECT upload_id, source_filename, id, full_name FROM candidate WHERE segment = 'BUILDING'
    UNION ALL SELECT d.upload_id, d.filename, sha256(d.upload_id || '/' || d.rel_path), d.full_name
    FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, filename
            ORDER BY sha256(upload_id || '/' || rel_path)) AS nth FROM results WHERE error_code IS NULL) AS d
    WHERE d.nth = 1 AND NOT EXISTS (
        SELECT 1 FROM stored AS s WHERE s.upload_id = d.upload_id AND s.source_filename = d.filename)""",
)
def _(t):
    drafts = _results(t).filter("error_code IS NULL").withColumns(
        {"id": F.sha2(F.concat_ws("/", *_KEY), 256), "created_at": _now().cast("timestamp")}
    )
    stored = _stored(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = _bucketed(t, CANDIDATES, stored, drafts)
    return rows.select("upload_id", "source_filename", "id", "full_name")


@query(
    "append_failures_by_bucket",
    """
    SELECT sha256(upload_id || '/' || rel_path) AS id, upload_id, filename, error_code FROM results
    WHERE error_code IS NOT NULL""",
)
def _(t):
    failures = I.build_failures(_results(t), _now().cast("timestamp"))
    rows = _bucketed(t, FAILURES, failures.filter("error_code = 'PARSE_FAILED'"), failures.unionAll(failures))
    return rows.select("id", "upload_id", "filename", "error_code")


@query(
    "upload_progress",
    """
    SELECT upload_id, cast(count(*) FILTER (WHERE error_code IS NULL) AS int) AS processed_files,
        cast(count(*) FILTER (WHERE error_code IS NOT NULL) AS int) AS failed_files
    FROM gated WHERE kept GROUP BY upload_id""",
)
def _(t):
    return I.upload_progress(_results(t).filter("kept"))


@query(
    "derive_upload_status",
    """
    SELECT id, CASE WHEN status = 'UPLOADED' THEN 'UPLOADED' WHEN priority = '1-URGENT' THEN 'FAILED'
        WHEN completed_at IS NULL THEN 'PROCESSING' WHEN failed_files = 0 THEN 'COMPLETED'
        ELSE 'COMPLETED_WITH_ERRORS' END AS status,
        CASE WHEN status <> 'UPLOADED' AND (priority = '1-URGENT' OR completed_at IS NOT NULL)
            THEN TIMESTAMP '2024-02-01 00:00:00' END AS completed_at
    FROM cv_upload""",
)
def _(t):
    given = t["cv_upload"].withColumns(
        {
            "started": F.col("status") != "UPLOADED",
            "finished": F.col("completed_at").isNotNull(),
            "job_failed": F.col("priority") == "1-URGENT",
        }
    )
    return I.derive_upload_status(given, _now()).select("id", "status", "completed_at")


@query(
    "check_progress_invariant",
    """
    SELECT upload_id, CASE WHEN total_files <= 0 THEN 'total_files must be positive'
        WHEN processed_files < 0 THEN 'processed_files must not be negative'
        WHEN failed_files < 0 THEN 'failed_files must not be negative'
        ELSE 'processed_files + failed_files exceeds total_files' END AS violation
    FROM (
        SELECT upload_id, count(DISTINCT entry_name) FILTER (WHERE size_bytes > 20000) AS total_files,
            count(*) FILTER (WHERE NOT is_directory) AS processed_files, count(*) FILTER (WHERE is_directory) AS failed_files
        FROM zip_manifest GROUP BY upload_id
    ) AS c WHERE total_files <= 0 OR processed_files + failed_files > total_files""",
)
def _(t):
    counts = t["zip_entries"].groupBy("upload_id").agg(
        F.count_distinct(F.when(F.col("size_bytes") > 20000, F.col("entry_name"))).alias("total_files"),
        F.count_if(~F.col("is_directory")).alias("processed_files"),
        F.count_if("is_directory").alias("failed_files"),
    )
    return I.progress_violations(counts).select("upload_id", "violation")


def _dirty_tables(t):
    """Stored tables with broken rows, from whole supplied tables."""
    candidates = t["candidate"].withColumns(
        {
            "years_of_experience": F.floor(F.col("balance") / 100).cast("int"),
            "preferred_job_type": F.when(F.col("segment") != "MACHINERY", F.col("preferred_job_type")).otherwise(
                F.lit("OFFICE")
            ),
            "upload_id": F.when(F.col("segment") == "FURNITURE", F.lit("u-none")).otherwise(F.col("upload_id")),
            "source_filename": F.when(F.col("segment") == "HOUSEHOLD", F.lit("same.pdf")).otherwise(
                F.col("source_filename")
            ),
        }
    )
    skills = t["candidate_skill"]
    doubled = skills.unionAll(skills.filter("skill = 'Python'"))
    failures = t["processing_failure"].withColumn(
        "error_message", F.repeat("error_message", F.when(F.col("error_code") == "PARSE_FAILED", 60).otherwise(1))
    )
    return {
        "cv_upload": t["cv_upload"].withColumn("failed_files", F.col("failed_files") - F.expr("total_files div 9")),
        "candidate": candidates,
        "candidate_skill": doubled,
        "processing_failure": failures,
        "upload_storage_cleanup": t["upload_storage_cleanup"],
    }


oracle_step(
    "dirty_candidate",
    """
    SELECT id, CASE segment WHEN 'FURNITURE' THEN 'u-none' ELSE upload_id END AS upload_id,
        cast(floor(balance / 100) AS int) AS years, full_name,
        CASE segment WHEN 'MACHINERY' THEN 'OFFICE' ELSE preferred_job_type END AS job_type,
        CASE segment WHEN 'HOUSEHOLD' THEN 'same.pdf' ELSE source_filename END AS source_filename
    FROM candidate""",
)


@query(
    "audit_constraints",
    """
    SELECT 'candidate.years_of_experience >= 0' AS rule, id AS key, count(*) AS violations
        FROM dirty_candidate WHERE years < 0 GROUP BY id
    UNION ALL SELECT 'candidate.preferred_job_type enum', id, count(*) FROM dirty_candidate
        WHERE job_type NOT IN ('ONSITE', 'REMOTE', 'HYBRID', 'UNKNOWN') GROUP BY id
    UNION ALL SELECT 'candidate unique (upload_id, source_filename)', upload_id || '/' || source_filename, count(*)
        FROM dirty_candidate GROUP BY upload_id, source_filename HAVING count(*) > 1
    UNION ALL SELECT 'candidate.upload_id references cv_upload', upload_id, count(*) FROM dirty_candidate
        WHERE upload_id NOT IN (SELECT id FROM cv_upload) GROUP BY upload_id
    UNION ALL SELECT 'candidate_skill primary key', candidate_id || '/' || skill, 2 FROM candidate_skill
        WHERE skill = 'Python'
    UNION ALL SELECT 'processing_failure.error_message length', id, 1 FROM processing_failure
        WHERE error_code = 'PARSE_FAILED' AND length(error_message) * 60 > 1000
    UNION ALL SELECT 'cv_upload.failed_files >= 0', id, 1 FROM cv_upload
        WHERE failed_files - (CASE WHEN total_files = 9 THEN 1 ELSE 0 END) < 0""",
)
def _(t):
    return audit_constraints(_dirty_tables(t))


@query(
    "cascade_delete_uploads",
    """
    SELECT 'blocked' AS table_name, id AS key FROM cv_upload WHERE status = 'FAILED'
        AND id IN (SELECT upload_id FROM candidate)
    UNION ALL SELECT 'cv_upload', id FROM cv_upload WHERE status <> 'FAILED'
        OR id IN (SELECT upload_id FROM candidate)
    UNION ALL SELECT 'processing_failure', f.id FROM processing_failure AS f JOIN cv_upload AS u ON u.id = f.upload_id
        WHERE u.status <> 'FAILED' OR u.id IN (SELECT upload_id FROM candidate)
    UNION ALL SELECT 'upload_storage_cleanup', c.upload_id FROM upload_storage_cleanup AS c
    UNION ALL SELECT 'candidate_skill', s.candidate_id || '/' || s.skill FROM candidate_skill AS s
        JOIN candidate AS c ON c.id = s.candidate_id WHERE c.segment <> 'BUILDING'""",
)
def _(t):
    tables = {
        n: t[n]
        for n in ("cv_upload", "candidate", "candidate_skill", "processing_failure", "upload_storage_cleanup")
    }
    doomed = t["cv_upload"].filter("status = 'FAILED'").select(F.col("id").alias("upload_id"))
    left = cascade_delete_uploads(tables, doomed)
    gone = _stored(t).select(F.col("id").alias("candidate_id"))
    skills = delete_candidates(tables, gone)["candidate_skill"]

    def named(table, df, key):
        return df.select(F.lit(table).alias("table_name"), F.expr(key).alias("key"))

    parts = named("blocked", left["blocked"], "upload_id")
    parts = parts.unionAll(named("cv_upload", left["cv_upload"], "id"))
    parts = parts.unionAll(named("processing_failure", left["processing_failure"], "id"))
    parts = parts.unionAll(named("upload_storage_cleanup", left["upload_storage_cleanup"], "upload_id"))
    return parts.unionAll(named("candidate_skill", skills, "concat(candidate_id, '/', skill)"))


oracle_step(
    "accepted_files",
    r"""
    SELECT g.* FROM gated AS g
    JOIN verdicts AS v ON v.upload_id = g.upload_id WHERE v.accepted""",
)


def _ingested(t):
    return I.ingest_uploads(
        t["uploads"], t["zip_manifest"], t["resume_files"], _stored(t), _now(), LIMITS, PARSING, BATCH
    )


@query(
    "ingest_candidates",
    """
    SELECT sha256(a.upload_id || '/' || a.filename) AS id, a.upload_id, a.filename AS source_filename, a.full_name,
        a.years AS years_of_experience, a.location AS preferred_location, a.job_type AS preferred_job_type, a.skills
    FROM (
        SELECT *, row_number() OVER (PARTITION BY upload_id, filename ORDER BY file_no) AS nth FROM accepted_files
        WHERE kept AND error_code IS NULL
    ) AS a LEFT JOIN stored AS s ON s.upload_id = a.upload_id AND s.source_filename = a.filename
    WHERE a.nth = 1 AND s.source_filename IS NULL""",
)
def _(t):
    return _ingested(t).candidates.select(
        "id",
        "upload_id",
        "source_filename",
        "full_name",
        "years_of_experience",
        "preferred_location",
        "preferred_job_type",
        F.array_join("skills", "|").alias("skills"),
    )


@query(
    "ingest_failures",
    """
    SELECT sha256(upload_id || '/' || rel_path) AS id, upload_id, filename, error_code, error_message,
        TIMESTAMP '2024-02-01 00:00:00' AS created_at
    FROM accepted_files WHERE kept AND error_code IS NOT NULL""",
)
def _(t):
    return _ingested(t).failures


@query(
    "ingest_uploads",
    """
    SELECT v.upload_id, cast(any_value(v.file_count) AS int) AS total_files,
        cast(count(*) FILTER (WHERE a.kept AND a.error_code IS NULL) AS int) AS processed_files,
        cast(count(*) FILTER (WHERE a.kept AND a.error_code IS NOT NULL) AS int) AS failed_files,
        cast(count(*) FILTER (WHERE a.kept AND a.error_code IS NULL AND s.source_filename IS NULL
            AND a.nth = 1) AS int) AS inserted_files,
        CASE WHEN count(a.upload_id) = 0 OR bool_or(a.upload_failed) THEN 'FAILED'
            WHEN count(*) FILTER (WHERE a.kept AND a.error_code IS NOT NULL) = 0 THEN 'COMPLETED'
            ELSE 'COMPLETED_WITH_ERRORS' END AS status
    FROM verdicts AS v LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY upload_id, filename, kept AND error_code IS NULL
            ORDER BY file_no) AS nth FROM accepted_files
    ) AS a ON a.upload_id = v.upload_id
    LEFT JOIN stored AS s ON s.upload_id = a.upload_id AND s.source_filename = a.filename
    WHERE v.accepted GROUP BY v.upload_id""",
)
def _(t):
    return _ingested(t).uploads.select(
        "upload_id", "total_files", "processed_files", "failed_files", "inserted_files", "status"
    )

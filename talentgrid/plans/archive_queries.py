"""Queries over archive manifests. Test limits: 6 entries, 95,000 bytes a file, 300,000 in all."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import archive as A
from talentgrid.operators.ingest import register_discovered_files
from talentgrid.plans.catalog import oracle_step, query
from talentgrid.settings import ArchiveLimits

LIMITS = ArchiveLimits(max_entries=6, max_total_bytes=300_000, max_single_bytes=95_000)

# The oracle walks each name with list_reduce; '!' marks a path that left its root.
oracle_step(
    "named",
    """
    SELECT *, CASE WHEN trim(entry_name) = '' THEN 'ZIP contains an invalid entry name'
        WHEN norm = '!' THEN 'ZIP contains an unsafe path' END AS error
    FROM (
        SELECT *, CASE WHEN entry_name LIKE '/%' THEN '!' ELSE list_reduce(
            string_split(entry_name, '/'),
            lambda a, p: CASE WHEN a = '!' THEN '!' WHEN p IN ('', '.') THEN a
                WHEN p = '..' THEN CASE WHEN a = '' THEN '!' WHEN position('/' IN a) = 0 THEN ''
                    ELSE regexp_replace(a, '/[^/]*$', '') END
                WHEN a = '' THEN p ELSE a || '/' || p END, '') END AS norm
        FROM zip_manifest
    ) AS walked""",
)
oracle_step(
    "safe_entries",
    "SELECT * FROM named WHERE error IS NULL",
)
oracle_step(
    "folders",
    """
    SELECT upload_id, entry_no, array_to_string(list_slice(parts, 1, depth), '/') AS folder
    FROM (
        SELECT upload_id, entry_no, parts,
            unnest(range(1, len(parts) + CASE WHEN is_directory THEN 1 ELSE 0 END)) AS depth
        FROM (SELECT *, string_split(norm, '/') AS parts FROM safe_entries WHERE norm <> '') AS p
    ) AS q""",
)
oracle_step(
    "repeated",
    """
    SELECT e.upload_id, e.entry_no, e.entry_name, e.norm FROM safe_entries AS e
    WHERE NOT e.is_directory AND e.norm <> '' AND (
        EXISTS (SELECT 1 FROM safe_entries AS f WHERE f.upload_id = e.upload_id AND f.norm = e.norm
            AND NOT f.is_directory AND f.entry_no < e.entry_no)
        OR EXISTS (SELECT 1 FROM folders AS d WHERE d.upload_id = e.upload_id AND d.folder = e.norm
            AND d.entry_no < e.entry_no))""",
)
oracle_step(
    "blocked",
    """
    SELECT DISTINCT d.upload_id, d.entry_no FROM folders AS d
    JOIN safe_entries AS f ON f.upload_id = d.upload_id AND f.norm = d.folder
        AND NOT f.is_directory AND f.entry_no < d.entry_no""",
)
oracle_step(
    "sized",
    """
    SELECT *, coalesce(sum(CASE WHEN NOT is_directory THEN size_bytes END) OVER (
        PARTITION BY upload_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM named""",
)
oracle_step(
    "judged_entries",
    """
    SELECT s.upload_id, s.entry_no, s.is_directory, s.size_bytes, CASE
        WHEN s.entry_no > 6 THEN 'ZIP contains too many entries'
        WHEN s.error IS NOT NULL THEN s.error
        WHEN NOT s.is_directory AND NOT regexp_matches(lower(s.norm), '[.](pdf|docx)$')
            THEN 'ZIP may contain only PDF and DOCX files'
        WHEN r.entry_no IS NOT NULL THEN 'ZIP contains duplicate file paths'
        WHEN b.entry_no IS NOT NULL THEN 'Failed to extract ZIP archive'
        WHEN s.is_directory THEN NULL
        WHEN s.size_bytes > 95000 AND (95000 <= 300000 - s.before OR s.before + s.size_bytes <= 300000)
            THEN 'A CV exceeds the maximum allowed size'
        WHEN s.before + s.size_bytes > 300000 THEN 'ZIP expands beyond the maximum allowed size'
        END AS reason
    FROM sized AS s
    LEFT JOIN repeated AS r ON r.upload_id = s.upload_id AND r.entry_no = s.entry_no
    LEFT JOIN blocked AS b ON b.upload_id = s.upload_id AND b.entry_no = s.entry_no""",
)
oracle_step(
    "verdicts",
    """
    SELECT u.upload_id, v.reason IS NULL AND coalesce(v.files, 0) > 0 AS accepted,
        coalesce(v.reason, CASE WHEN coalesce(v.files, 0) = 0
            THEN 'ZIP does not contain any supported CV files' END) AS reason,
        CASE WHEN v.reason IS NULL AND v.files > 0 THEN v.files END AS file_count,
        CASE WHEN v.reason IS NULL AND v.files > 0 THEN v.bytes END AS total_bytes
    FROM uploads AS u LEFT JOIN (
        SELECT upload_id, arg_min(reason, entry_no) FILTER (WHERE reason IS NOT NULL) AS reason,
            count(*) FILTER (WHERE NOT is_directory) AS files,
            cast(sum(size_bytes) FILTER (WHERE NOT is_directory) AS bigint) AS bytes
        FROM judged_entries GROUP BY upload_id
    ) AS v ON v.upload_id = u.upload_id""",
)


@query(
    "validate_upload_request",
    """
    SELECT upload_id, CASE WHEN size_bytes <= 0 THEN 'Uploaded file must not be empty'
        WHEN lower(right(original_filename, 4)) <> '.zip' THEN 'Only ZIP archives are supported' END AS error
    FROM (
        SELECT id AS upload_id, processed_files AS size_bytes, CASE priority WHEN '5-LOW' THEN id || '.rar'
            WHEN '1-URGENT' THEN id || '.ZIP' ELSE original_filename END AS original_filename
        FROM cv_upload
    ) AS r""",
)
def _(t):
    uploads = t["cv_upload"]
    name = (
        F.when(F.col("priority") == "5-LOW", F.concat("id", F.lit(".rar")))
        .when(F.col("priority") == "1-URGENT", F.concat("id", F.lit(".ZIP")))
        .otherwise(F.col("original_filename"))
    )
    given = uploads.select(
        F.col("id").alias("upload_id"),
        name.alias("original_filename"),
        F.col("processed_files").alias("size_bytes"),
    )
    return A.validate_upload_request(given).select("upload_id", "error")


@query(
    "zip_entry_count",
    "SELECT upload_id, entry_no, entry_name FROM zip_manifest WHERE entry_no > 6",
)
def _(t):
    return A.zip_entry_count(t["zip_manifest"], LIMITS).select("upload_id", "entry_no", "entry_name")


@query(
    "zip_safe_path",
    """
    SELECT upload_id, entry_no, error, CASE WHEN error IS NULL THEN norm END AS norm_path FROM named""",
)
def _(t):
    norm = F.when(F.col("error").isNull(), F.col("norm_path")).alias("norm_path")
    return A.zip_safe_path(t["zip_manifest"]).select("upload_id", "entry_no", "error", norm)


@query(
    "zip_allowed_extension",
    """
    SELECT upload_id, entry_no, norm AS norm_path FROM named
    WHERE error IS NULL AND NOT is_directory AND NOT regexp_matches(lower(norm), '[.](pdf|docx)$')""",
)
def _(t):
    return A.zip_allowed_extension(t["zip_manifest"]).select("upload_id", "entry_no", "norm_path")


@query(
    "zip_duplicate_path",
    "SELECT upload_id, entry_no, entry_name, norm AS norm_path FROM repeated",
)
def _(t):
    return A.zip_duplicate_path(t["zip_manifest"])


@query(
    "zip_single_file_size",
    """
    SELECT upload_id, entry_no, size_bytes FROM zip_manifest
    WHERE NOT is_directory AND size_bytes > 95000""",
)
def _(t):
    return A.zip_single_file_size(t["zip_manifest"], LIMITS).select("upload_id", "entry_no", "size_bytes")


@query(
    "zip_total_size",
    """
    SELECT upload_id, entry_no, cast(before + size_bytes AS bigint) AS total_bytes FROM sized
    WHERE NOT is_directory AND before + size_bytes > 300000""",
)
def _(t):
    return A.zip_total_size(t["zip_manifest"], LIMITS).select("upload_id", "entry_no", "total_bytes")


@query(
    "zip_has_files",
    """
    SELECT upload_id FROM uploads AS u WHERE NOT EXISTS (
        SELECT 1 FROM zip_manifest AS m WHERE m.upload_id = u.upload_id AND NOT m.is_directory)""",
)
def _(t):
    return A.zip_has_files(t["uploads"], t["zip_manifest"])


@query("zip_verdict", "SELECT * FROM verdicts")
def _(t):
    return A.zip_verdict(t["uploads"], t["zip_manifest"], LIMITS)


@query(
    "register_discovered_files",
    """
    SELECT u.upload_id, u.original_filename, 'UPLOADED' AS status, cast(v.file_count AS int) AS total_files,
        0 AS processed_files, 0 AS failed_files, u.created_at
    FROM verdicts AS v JOIN uploads AS u ON u.upload_id = v.upload_id WHERE v.accepted""",
)
def _(t):
    verdicts = A.zip_verdict(t["uploads"], t["zip_manifest"], LIMITS)
    return register_discovered_files(t["uploads"], verdicts)

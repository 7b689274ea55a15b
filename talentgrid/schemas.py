"""Explicit schemas of the stored tables and of the records in flight."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_TEXT, _INT, _LONG, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()
_TEXTS = T.ArrayType(T.StringType(), containsNull=False)

CV_UPLOAD = _table(
    ("id", _TEXT, False),
    ("original_filename", _TEXT, False),
    ("status", _TEXT, False),
    ("total_files", _INT, False),
    ("processed_files", _INT, False),
    ("failed_files", _INT, False),
    ("created_at", _TIME, False),
    ("completed_at", _TIME, True),
)
CANDIDATE = _table(
    ("id", _TEXT, False),
    ("upload_id", _TEXT, False),
    ("full_name", _TEXT, True),
    ("years_of_experience", _INT, True),
    ("preferred_location", _TEXT, True),
    ("preferred_job_type", _TEXT, True),
    ("source_filename", _TEXT, False),
    ("created_at", _TIME, False),
    ("skills", _TEXTS, True),
)
CANDIDATE_SKILL = _table(("candidate_id", _TEXT, False), ("skill", _TEXT, False))
PROCESSING_FAILURE = _table(
    ("id", _TEXT, False),
    ("upload_id", _TEXT, False),
    ("filename", _TEXT, False),
    ("error_code", _TEXT, False),
    ("error_message", _TEXT, True),
    ("created_at", _TIME, False),
)
UPLOAD_STORAGE_CLEANUP = _table(("upload_id", _TEXT, False), ("cleaned_at", _TIME, False))


def with_day(table: T.StructType) -> T.StructType:
    """A table that is stored by the day its rows arrived."""
    return T.StructType([*table.fields, T.StructField("arrived_day", T.DateType(), True)])


TABLES = {
    "cv_upload": CV_UPLOAD,
    "candidate": CANDIDATE,
    "candidate_skill": CANDIDATE_SKILL,
    "processing_failure": PROCESSING_FAILURE,
    "upload_storage_cleanup": UPLOAD_STORAGE_CLEANUP,
}

# Length limits in characters, checked by audit_constraints.
LENGTHS = {
    "cv_upload": {"original_filename": 255, "status": 30},
    "candidate": {
        "full_name": 255,
        "preferred_location": 255,
        "preferred_job_type": 50,
        "source_filename": 255,
    },
    "candidate_skill": {"skill": 100},
    "processing_failure": {"filename": 255, "error_code": 100, "error_message": 1000},
}

MANIFEST = _table(
    ("upload_id", _TEXT, False),
    ("entry_no", _INT, True),
    ("entry_name", _TEXT, True),
    ("is_directory", T.BooleanType(), True),
    ("size_bytes", _LONG, True),
    ("content", T.BinaryType(), True),
    ("archive_error", _TEXT, True),
)
DOCUMENT = _table(
    ("upload_id", _TEXT, False),
    ("rel_path", _TEXT, False),
    ("media_type", _TEXT, True),
    ("text", _TEXT, True),
    ("error_code", _TEXT, True),
)

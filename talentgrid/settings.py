"""Limits and defaults, passed to the operators as parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Default limits, messages and names that results must show unchanged.
PDF_TYPE = "application/pdf"
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
UPLOAD_STATUSES = ("UPLOADED", "PROCESSING", "COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED")
JOB_TYPES = ("ONSITE", "REMOTE", "HYBRID", "UNKNOWN")
SORT_FIELDS = {
    "fullName": "full_name",
    "yearsOfExperience": "years_of_experience",
    "preferredLocation": "preferred_location",
    "preferredJobType": "preferred_job_type",
    "sourceFilename": "source_filename",
}
MAX_PAGE_SIZE = 100


class InvalidQuery(ValueError):
    """A search, paging or sort argument that is not allowed."""


class CandidateLost(LookupError):
    """A candidate of a page was gone when its row was fetched."""


class UploadNotFound(LookupError):
    """The upload asked for is not in the upload table."""


@dataclass(frozen=True)
class ArchiveLimits:
    max_entries: int = 5000
    max_total_bytes: int = 1 << 30
    max_single_bytes: int = 25 << 20


@dataclass(frozen=True)
class ParsingLimits:
    max_text_length: int = 1_000_000


@dataclass(frozen=True)
class BatchLimits:
    chunk_size: int = 10
    skip_limit: int = 50


@dataclass(frozen=True)
class Retention:
    enabled: bool = True
    days: int = 7
    batch_size: int = 100

    def __post_init__(self):
        if self.days <= 0:
            raise ValueError("retention must be positive")
        if not 1 <= self.batch_size <= 1000:
            raise ValueError("batch size must be between 1 and 1000")

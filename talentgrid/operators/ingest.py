"""The ingest path: numbered files, drafts or failures, insert-only merge, progress and status."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.paths import is_cv_name
from talentgrid.functions.text import basename, clean_message, is_blank
from talentgrid.operators.archive import validate_upload_request, zip_verdict
from talentgrid.operators.candidates import DRAFT, extract_candidates
from talentgrid.operators.documents import classify_document
from talentgrid.operators.joins import join_per_key
from talentgrid.operators.ordered import first_per_key, running
from talentgrid.session import fixed
from talentgrid.settings import ArchiveLimits, BatchLimits, ParsingLimits

# Failure codes and messages.
EXTRACTION_FAILED = "CANDIDATE_EXTRACTION_FAILED"
PROCESSING_FAILED = "PROCESSING_FAILED"
NO_CV_FILES = "No CV files found for upload: "
NULL_DRAFT = "CandidateDraft must not be null"
BLANK_FILENAME = "Candidate sourceFilename must not be blank"

# So many upload ids at most (some 10 MB) are sent to every task.
TOLD_UPLOADS = 200_000
# Default of spark.sql.optimizer.windowGroupLimitThreshold.
PRUNED_RANKS = 1000


def cv_files(documents: DataFrame) -> DataFrame:
    """The documents whose names say that they are CVs, for batch and stream alike."""
    return documents.filter(is_cv_name(F.col("rel_path")))


def discover_cv_files(uploads: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CV files of each upload numbered by path, and the uploads that have none."""
    cvs = listing.filter(F.col("is_regular") & is_cv_name(F.col("rel_path")))
    known = cvs.select("upload_id").distinct()
    empty = uploads.select("upload_id").join(known, "upload_id", "left_anti")
    files = running(cvs, ["upload_id"], ["rel_path"], number="file_no")
    message = F.concat(F.lit(NO_CV_FILES), F.col("upload_id"))
    return files, empty.withColumn("error", message)


def assign_chunks(files: DataFrame, limits: BatchLimits) -> DataFrame:
    chunk = F.floor((F.col("file_no") - 1) / limits.chunk_size).cast("long")
    return files.withColumn("chunk_no", chunk)


def resume_from_checkpoint(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files after the index each upload was committed to (upload_id, last_index)."""
    joined = join_per_key(files, checkpoints, ["upload_id"], "left", ["file_no"])
    return joined.filter(F.col("file_no") > F.coalesce("last_index", F.lit(0))).drop("last_index")


def resolve_error_code(document_code: Column, extraction_error: Column) -> Column:
    return F.coalesce(
        document_code,
        F.when(extraction_error.isNotNull(), EXTRACTION_FAILED),
        F.lit(PROCESSING_FAILED),
    )


def process_documents(documents: DataFrame, limits: ParsingLimits = ParsingLimits()) -> DataFrame:
    """One row per file: draft columns, or error_code and error_message."""
    read = classify_document(documents, limits)
    tried = extract_candidates(read)
    unread = F.col("error_code").isNotNull()
    failed = unread | F.col("error").isNotNull()
    code = F.when(failed, resolve_error_code(F.col("error_code"), F.col("error")))
    message = F.when(unread, F.col("error_message")).otherwise(F.col("error"))
    return tried.withColumns(
        {"error_code": code, "error_message": F.when(failed, clean_message(message))}
    ).drop("error", "text")


def draft_error(draft_missing: Column, filename: Column) -> Column:
    return F.when(draft_missing, NULL_DRAFT).when(
        filename.isNull() | is_blank(filename), BLANK_FILENAME
    )


def validate_drafts(drafts: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good drafts and rejected ones; in strict mode a bad draft fails the job."""
    error = draft_error(F.col("is_null_draft"), F.col("source_filename"))
    checked = drafts.withColumn("error", error)
    if strict:
        stop = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string"))
        return checked.withColumn("error", stop).filter(F.col("error").isNull()), checked.limit(0)
    good = checked.filter(F.col("error").isNull()).drop("error")
    return good, checked.filter(F.col("error").isNotNull())


def dedupe_drafts(drafts: DataFrame) -> DataFrame:
    return first_per_key(drafts, ["upload_id", "source_filename"], ["file_no"])


def find_existing_filenames(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    keys = ["upload_id", "source_filename"]
    return stored.select(*keys).join(wanted.select(*keys).distinct(), keys, "left_semi")


def candidate_id(upload_id: Column, filename: Column) -> Column:
    """Same file, same id: a rerun writes the same row."""
    return F.sha2(F.concat(upload_id, F.lit("/"), filename), 256)


def insert_new_candidates(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts to append: first per (upload, filename), and not stored yet.

    The drafts are reduced to one row per key before the anti-join, so the join key has no hot value.
    """
    keys = ["upload_id", "source_filename"]
    uploads = drafts.select("upload_id").distinct()
    known = stored.select(*keys).join(uploads, "upload_id", "left_semi")
    fresh = dedupe_drafts(drafts).join(known, keys, "left_anti")
    return fresh.withColumn("id", candidate_id(F.col("upload_id"), F.col("source_filename")))


def stop_points(results: DataFrame, limits: BatchLimits) -> DataFrame:
    """(upload_id, stop_chunk): the chunk where an upload exceeds its skip limit.

    Only failure number skip_limit + 1 of an upload matters, so the rank filter bounds what each map
    task sends to the window. Spark applies it up to PRUNED_RANKS; larger limits number in slices.
    """
    failures = results.filter(F.col("error_code").isNotNull()).select("upload_id", "file_no")
    if limits.skip_limit < PRUNED_RANKS:
        order = Window.partitionBy("upload_id").orderBy("file_no")
        ranked = failures.withColumn("nth", F.row_number().over(order))
    else:
        ranked = running(failures, ["upload_id"], ["file_no"], number="nth")
    last = ranked.filter(F.col("nth") == limits.skip_limit + 1)
    return assign_chunks(last, limits).select("upload_id", F.col("chunk_no").alias("stop_chunk"))


def skip_limit_gate(results: DataFrame, limits: BatchLimits) -> DataFrame:
    """Add chunk_no, upload_failed and kept (the row's chunk was committed)."""
    chunked = assign_chunks(results, limits)
    stops = stop_points(results, limits)
    joined = join_per_key(chunked, stops, ["upload_id"], "left", ["file_no"])
    failed = F.col("stop_chunk").isNotNull()
    kept = ~failed | (F.col("chunk_no") < F.col("stop_chunk"))
    return joined.withColumn("upload_failed", failed).withColumn("kept", kept).drop("stop_chunk")


def build_failures(results: DataFrame, now: dt.datetime | Column, *keep: str) -> DataFrame:
    created = now if isinstance(now, Column) else F.lit(now)
    name = F.coalesce(basename(F.col("rel_path")), F.lit("unknown"))
    key = F.concat(F.col("upload_id"), F.lit("/"), F.coalesce("rel_path", F.lit("unknown")))
    return results.filter(F.col("error_code").isNotNull()).select(
        F.sha2(key, 256).alias("id"),
        "upload_id",
        name.alias("filename"),
        "error_code",
        clean_message(F.col("error_message")).alias("error_message"),
        created.alias("created_at"),
        *keep,
    )


def upload_progress(results: DataFrame) -> DataFrame:
    """Processed (duplicates included) and failed files per upload."""
    failed = F.col("error_code").isNotNull()
    return results.groupBy("upload_id").agg(
        F.count_if(~failed).cast("int").alias("processed_files"),
        F.count_if(failed).cast("int").alias("failed_files"),
    )


def upload_status(started: Column, finished: Column, job_failed: Column, failed_files: Column) -> Column:
    return (
        F.when(~started, "UPLOADED")
        .when(job_failed, "FAILED")
        .when(~finished, "PROCESSING")
        .when(failed_files == 0, "COMPLETED")
        .otherwise("COMPLETED_WITH_ERRORS")
    )


def derive_upload_status(uploads: DataFrame, now: Column) -> DataFrame:
    """Status and completed_at from started, job_failed, finished and the counts."""
    ended = F.col("started") & (F.col("job_failed") | F.col("finished"))
    status = upload_status(
        F.col("started"), F.col("finished"), F.col("job_failed"), F.col("failed_files")
    )
    return uploads.withColumns({"status": status, "completed_at": F.when(ended, now)})


def progress_violations(uploads: DataFrame) -> DataFrame:
    """Uploads whose counts break a rule, with the first rule broken."""
    total, done, failed = (F.col(c) for c in ("total_files", "processed_files", "failed_files"))
    rule = (
        F.when(total <= 0, "total_files must be positive")
        .when(done < 0, "processed_files must not be negative")
        .when(failed < 0, "failed_files must not be negative")
        .when(done + failed > total, "processed_files + failed_files exceeds total_files")
    )
    return uploads.withColumn("violation", rule).filter(F.col("violation").isNotNull())


def register_discovered_files(uploads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New upload rows of accepted archives."""
    accepted = verdicts.filter("accepted").select(
        "upload_id", F.col("file_count").cast("int").alias("total_files")
    )
    return uploads.join(accepted, "upload_id").select(
        "upload_id",
        "original_filename",
        F.lit("UPLOADED").alias("status"),
        "total_files",
        F.lit(0).alias("processed_files"),
        F.lit(0).alias("failed_files"),
        "created_at",
    )


@dataclass(frozen=True)
class Ingested:
    candidates: DataFrame
    failures: DataFrame
    uploads: DataFrame


def flag_inserts(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``inserted``: the row is a committed draft, first of its name, and not stored yet."""
    keys = ["upload_id", "source_filename"]
    drafts = results.filter(F.col("kept") & F.col("error_code").isNull())
    fresh = insert_new_candidates(drafts.select(*keys, "file_no"), stored)
    marks = fresh.select("upload_id", "file_no", F.lit(True).alias("inserted"))
    joined = results.join(marks, ["upload_id", "file_no"], "left")
    return joined.withColumn("inserted", F.coalesce("inserted", F.lit(False)))


def summarize_ingest(uploads: DataFrame, flagged: DataFrame, now: Column) -> DataFrame:
    """Final row of each upload (with total_files); one without CV files has failed."""
    failed = F.col("error_code").isNotNull()
    counts = flagged.groupBy("upload_id").agg(
        F.count_if(F.col("kept") & ~failed).cast("int").alias("processed_files"),
        F.count_if(F.col("kept") & failed).cast("int").alias("failed_files"),
        F.count_if("inserted").cast("int").alias("inserted_files"),
        F.max("upload_failed").alias("job_failed"),
    )
    none = {c: F.coalesce(c, F.lit(0)) for c in ("processed_files", "failed_files", "inserted_files")}
    rows = uploads.join(counts, "upload_id", "left").withColumns(
        {**none, "started": F.lit(True), "finished": F.lit(True), "job_failed": F.coalesce("job_failed", F.lit(True))}
    )
    return derive_upload_status(rows, now).drop("started", "finished", "job_failed")


def ingest_results(
    documents: DataFrame,
    parsing: ParsingLimits = ParsingLimits(),
    batch: BatchLimits = BatchLimits(),
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Numbered CV files with their draft or failure, gated by the skip limit; of the `wanted` uploads (upload_id).

    Texts end where they are read: what is joined, numbered and gated are results without texts. They are written
    once, as all of these read them; otherwise every text would be extracted again for each.
    """
    cvs = cv_files(documents)
    few = wanted is not None and wanted.count() <= TOLD_UPLOADS
    if few:  # told to every task, so that texts of other uploads are not even read for fields
        cvs = cvs.join(F.broadcast(wanted), "upload_id", "left_semi")
    results = process_documents(cvs, parsing)
    if wanted is not None and not few:
        results = join_per_key(results, wanted, ["upload_id"], "left_semi", ["rel_path"])
    numbered = running(fixed(results), ["upload_id"], ["rel_path"], number="file_no")
    return skip_limit_gate(fixed(numbered), batch)


def ingest_uploads(
    uploads: DataFrame,
    manifest: DataFrame,
    documents: DataFrame,
    stored: DataFrame,
    now: Column,
    archive: ArchiveLimits = ArchiveLimits(),
    parsing: ParsingLimits = ParsingLimits(),
    batch: BatchLimits = BatchLimits(),
) -> Ingested:
    """Accepted archives to candidate rows, failure rows and final upload rows, many at once.

    Where uploads tell size_bytes, the request is checked first and a refused one is not opened.
    """
    if "size_bytes" in uploads.columns:
        uploads = validate_upload_request(uploads).filter("error is null").drop("error")
    verdicts = zip_verdict(uploads, manifest, archive)
    # Written once: the file numbering, the extraction and the summary all start from it.
    files = F.col("file_count").cast("int").alias("total_files")
    accepted = fixed(verdicts.filter("accepted").select("upload_id", files))
    flagged = flag_inserts(ingest_results(documents, parsing, batch, accepted.select("upload_id")), stored)
    candidates = flagged.filter("inserted").select(
        candidate_id(F.col("upload_id"), F.col("source_filename")).alias("id"),
        "upload_id",
        *DRAFT,
        now.alias("created_at"),
    )
    failures = build_failures(flagged.filter("kept"), now)
    taken = uploads.drop("total_files", "processed_files", "failed_files").join(accepted, "upload_id")
    return Ingested(candidates, failures, summarize_ingest(taken, flagged, now))

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import audit
from talentgrid.operators import ingest as I
from talentgrid.schemas import TABLES
from talentgrid.settings import PDF_TYPE, ArchiveLimits, BatchLimits, ParsingLimits

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DOC = "upload_id string, rel_path string, media_type string, file_exists boolean, text string"
MANIFEST = "upload_id string, entry_no int, entry_name string, is_directory boolean, size_bytes long"
STORED = "upload_id string, source_filename string"
UPLOAD = "upload_id string, original_filename string, created_at timestamp"


def doc(upload, path, text="Ann Lee\nJava"):
    return upload, path, PDF_TYPE, True, text


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_discovery(spark):
    rows = [
        ("u1", "b/z.pdf", True),
        ("u1", "a.DOCX", True),
        ("u1", "B.pdf", True),
        ("u1", "notes.txt", True),
        ("u1", "dir.pdf", False),
        ("u2", "x.txt", True),
    ]
    listing = spark.createDataFrame(rows, "upload_id string, rel_path string, is_regular boolean")
    uploads = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "upload_id string")
    files, empty = I.discover_cv_files(uploads, listing)
    got = [(r.file_no, r.rel_path) for r in files.orderBy("file_no").collect()]
    assert got == [(1, "B.pdf"), (2, "a.DOCX"), (3, "b/z.pdf")]
    assert {r.upload_id: r.error for r in empty.collect()} == {
        "u2": "No CV files found for upload: u2",
        "u3": "No CV files found for upload: u3",
    }


def test_resume(spark):
    files = spark.createDataFrame([("u1", n) for n in range(1, 6)] + [("u2", 1)], "upload_id string, file_no long")
    points = spark.createDataFrame([("u1", 2)], "upload_id string, last_index long")
    left = I.resume_from_checkpoint(files, points).collect()
    assert sorted((r.upload_id, r.file_no) for r in left) == [("u1", 3), ("u1", 4), ("u1", 5), ("u2", 1)]


def test_validation(spark):
    rows = [(1, False, "a.pdf"), (2, True, "a.pdf"), (3, False, "  "), (4, False, None)]
    drafts = spark.createDataFrame(rows, "id int, is_null_draft boolean, source_filename string")
    good, bad = I.validate_drafts(drafts)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.error for r in bad.collect()} == {2: I.NULL_DRAFT, 3: I.BLANK_FILENAME, 4: I.BLANK_FILENAME}
    with pytest.raises(Exception, match="must not be null"):
        I.validate_drafts(drafts.filter("id <= 2"), strict=True)[0].collect()
    assert I.validate_drafts(drafts.filter("id = 1"), strict=True)[0].count() == 1


def test_merge_inserts_once(spark):
    rows = [("u1", "a.pdf", 1), ("u1", "a.pdf", 2), ("u1", "b.pdf", 3), ("u2", "a.pdf", 1)]
    drafts = spark.createDataFrame(rows, "upload_id string, source_filename string, file_no long")
    stored = spark.createDataFrame([("u1", "b.pdf")], STORED)
    fresh = I.insert_new_candidates(drafts, stored)
    assert sorted((r.upload_id, r.source_filename, r.file_no) for r in fresh.collect()) == [
        ("u1", "a.pdf", 1),
        ("u2", "a.pdf", 1),
    ]
    again = I.insert_new_candidates(drafts, stored.union(fresh.select("upload_id", "source_filename")))
    assert again.count() == 0


def test_skip_limit(spark):
    # Chunks of 2, one skip allowed: the second failure of u1 is file 5, in chunk 2.
    rows = [("u1", n, "X" if n in (2, 5, 6) else None) for n in range(1, 8)]
    rows += [("u2", n, "X" if n == 1 else None) for n in range(1, 4)]
    results = spark.createDataFrame(rows, "upload_id string, file_no long, error_code string")
    out = I.skip_limit_gate(results, BatchLimits(chunk_size=2, skip_limit=1)).collect()
    kept = {(r.upload_id, r.file_no) for r in out if r.kept}
    assert kept == {("u1", n) for n in range(1, 5)} | {("u2", n) for n in range(1, 4)}
    assert {r.upload_id: r.upload_failed for r in out} == {"u1": True, "u2": False}
    none = I.skip_limit_gate(results, BatchLimits(chunk_size=2, skip_limit=0)).collect()
    assert {(r.upload_id, r.file_no) for r in none if r.kept} == set()


def test_status_and_progress(spark):
    rows = [
        ("new", False, False, False, 0),
        ("running", True, False, False, 0),
        ("clean", True, True, False, 0),
        ("errors", True, True, False, 2),
        ("failed", True, False, True, 2),
    ]
    uploads = spark.createDataFrame(
        rows, "id string, started boolean, finished boolean, job_failed boolean, failed_files int"
    )
    out = {r.id: (r.status, r.completed_at is not None) for r in I.derive_upload_status(uploads, F.lit(NOW)).collect()}
    assert out == {
        "new": ("UPLOADED", False),
        "running": ("PROCESSING", False),
        "clean": ("COMPLETED", True),
        "errors": ("COMPLETED_WITH_ERRORS", True),
        "failed": ("FAILED", True),
    }
    counts = spark.createDataFrame(
        [("a", 0, 0, 0), ("b", 2, -1, 0), ("c", 2, 0, -1), ("d", 2, 2, 1), ("e", 2, 1, 1)],
        "id string, total_files int, processed_files int, failed_files int",
    )
    assert sorted(r.id for r in I.progress_violations(counts).collect()) == ["a", "b", "c", "d"]


def test_whole_ingest(spark):
    uploads = spark.createDataFrame([(u, u + ".zip", NOW) for u in ("ok", "bad", "evil")], UPLOAD)
    docs = documents(
        spark,
        [
            doc("ok", "a/x.pdf"),
            doc("ok", "b/x.pdf", "Bob Ray\nKafka"),
            doc("ok", "c.pdf", "12345"),
            doc("ok", "d.pdf", "  "),
            doc("ok", "e.pdf", "Eve Fox"),
            doc("bad", "1.pdf"),
            doc("bad", "2.pdf", "1"),
            doc("bad", "3.pdf", "2"),
            doc("bad", "4.pdf", "3"),
            doc("evil", "x.exe"),
        ],
    )
    entries = [(d.upload_id, d.rel_path) for d in docs.select("upload_id", "rel_path").collect()]
    numbers = {}
    rows = []
    for upload, path in entries:
        numbers[upload] = numbers.get(upload, 0) + 1
        rows.append((upload, numbers[upload], path, False, 5))
    manifest = spark.createDataFrame(rows, MANIFEST)
    stored = spark.createDataFrame([("ok", "e.pdf"), ("bad", "x.pdf")], STORED)
    done = I.ingest_uploads(
        uploads, manifest, docs, stored, F.lit(NOW), ArchiveLimits(), ParsingLimits(), BatchLimits(1, 2)
    )
    out = {r.upload_id: r for r in done.uploads.collect()}
    assert sorted(out) == ["bad", "ok"]
    ok, bad = out["ok"], out["bad"]
    assert (ok.total_files, ok.processed_files, ok.failed_files, ok.inserted_files) == (5, 3, 2, 1)
    assert ok.status == "COMPLETED_WITH_ERRORS"
    assert (bad.status, bad.processed_files, bad.failed_files, bad.inserted_files) == ("FAILED", 1, 2, 1)
    people = {(r.upload_id, r.source_filename): r for r in done.candidates.collect()}
    assert set(people) == {("ok", "x.pdf"), ("bad", "1.pdf")}
    assert people[("ok", "x.pdf")].full_name == "Ann Lee" and people[("ok", "x.pdf")].skills == ["Java"]
    failures = {(r.upload_id, r.filename): r.error_code for r in done.failures.collect()}
    assert failures == {
        ("ok", "c.pdf"): "CANDIDATE_EXTRACTION_FAILED",
        ("ok", "d.pdf"): "EMPTY_DOCUMENT",
        ("bad", "2.pdf"): "CANDIDATE_EXTRACTION_FAILED",
        ("bad", "3.pdf"): "CANDIDATE_EXTRACTION_FAILED",
    }
    rerun = I.ingest_uploads(
        uploads, manifest, docs, stored.union(done.candidates.select("upload_id", "source_filename")), F.lit(NOW),
        batch=BatchLimits(1, 2),
    )
    assert rerun.candidates.count() == 0
    assert rerun.failures.select("id").exceptAll(done.failures.select("id")).count() == 0


def test_audit_of_clean_tables(spark):
    uploads = spark.createDataFrame(
        [("u1", "a.zip", "COMPLETED", 1, 1, 0, NOW, NOW)],
        "id string, original_filename string, status string, total_files int, processed_files int,"
        " failed_files int, created_at timestamp, completed_at timestamp",
    )
    people = spark.createDataFrame(
        [("c1", "u1", "A B", 1, None, "REMOTE", "a.pdf", NOW)],
        "id string, upload_id string, full_name string, years_of_experience int, preferred_location string,"
        " preferred_job_type string, source_filename string, created_at timestamp",
    )
    skills = spark.createDataFrame([("c1", "Java")], "candidate_id string, skill string")
    failures = spark.createDataFrame(
        [("f1", "u1", "b.pdf", "X", None, NOW)],
        "id string, upload_id string, filename string, error_code string, error_message string, created_at timestamp",
    )
    cleanup = spark.createDataFrame([("u1", NOW)], "upload_id string, cleaned_at timestamp")
    tables = {
        "cv_upload": uploads,
        "candidate": people,
        "candidate_skill": skills,
        "processing_failure": failures,
        "upload_storage_cleanup": cleanup,
    }
    assert audit.audit_constraints(tables).collect() == []
    broken = {**tables, "cv_upload": uploads.withColumn("status", F.lit("ODD")).withColumn("id", F.lit("u2"))}
    rules = {r.rule for r in audit.audit_constraints(broken).collect()}
    assert rules == {
        "cv_upload.status enum",
        "candidate.upload_id references cv_upload",
        "processing_failure.upload_id references cv_upload",
        "upload_storage_cleanup.upload_id references cv_upload",
    }
    doomed = spark.createDataFrame([("u1",)], "upload_id string")
    kept = audit.cascade_delete_uploads(tables, doomed)
    assert [r.upload_id for r in kept["blocked"].collect()] == ["u1"] and kept["cv_upload"].count() == 1
    emptied = audit.delete_candidates(tables, spark.createDataFrame([("c1",)], "candidate_id string"))
    assert emptied["candidate_skill"].count() == 0
    gone = audit.cascade_delete_uploads(emptied, doomed)
    assert [gone[n].count() for n in ("cv_upload", "processing_failure", "upload_storage_cleanup")] == [0, 0, 0]


def test_audit_counts_keys_and_references_together(spark):
    rows = {
        "cv_upload": [("u1",), ("u1",), ("u2",), (None,)],
        "candidate": [("c1", "u1", "a"), ("c1", "u9", "a"), ("c2", "u9", "a"), ("c3", None, "b"), ("c4", None, "b")],
        "candidate_skill": [("c1", "x"), ("c1", "x"), ("c7", "y")],
        "processing_failure": [("f1", "u9")],
        "upload_storage_cleanup": [("u1",)],
    }
    named = {
        "cv_upload": ["id"],
        "candidate": ["id", "upload_id", "source_filename"],
        "candidate_skill": ["candidate_id", "skill"],
        "processing_failure": ["id", "upload_id"],
        "upload_storage_cleanup": ["upload_id"],
    }
    tables = {}
    for name, held in rows.items():
        df = spark.createDataFrame(held, ", ".join(f"{c} string" for c in named[name]))
        absent = [f for f in TABLES[name].fields if f.name not in named[name]]
        tables[name] = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])
    found = audit.audit_constraints(tables).filter("rule not like '%not null'")
    assert sorted((r.rule, r.key, r.violations) for r in found.collect()) == [
        ("candidate primary key", "c1", 2),
        ("candidate unique (upload_id, source_filename)", "b", 2),
        ("candidate unique (upload_id, source_filename)", "u9/a", 2),
        ("candidate.upload_id references cv_upload", "u9", 2),
        ("candidate_skill primary key", "c1/x", 2),
        ("candidate_skill.candidate_id references candidate", "c7", 1),
        ("cv_upload primary key", "u1", 2),
        ("processing_failure.upload_id references cv_upload", "u9", 1),
    ]

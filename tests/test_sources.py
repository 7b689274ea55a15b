import datetime as dt
import glob
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import archive as A
from talentgrid.operators import export as X
from talentgrid.operators.ingest import ingest_uploads
from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE, TABLES, with_day
from talentgrid.settings import DOCX_TYPE, PDF_TYPE, ArchiveLimits
from talentgrid.sources import archives, documents, logs, tables

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(entries, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def docx(lines) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    xml = f'<?xml version="1.0"?><w:document {WORD}><w:body>{body}</w:body></w:document>'
    return packed([("[Content_Types].xml", "<Types/>"), ("word/document.xml", xml)])


def broken_pdf(content: bytes) -> str:
    raise ValueError("not a readable PDF")


DECODERS = {**documents.DECODERS, PDF_TYPE: broken_pdf}


def store(folder, files):
    for name, data in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_archives_to_verdicts_and_texts(spark, folder):
    good = packed([("team/", b""), ("team/ann.docx", docx(["Ann Lee", "Java"])), ("b.pdf", b"%PDF-1.4 x")])
    store(
        folder,
        {
            "in/good.zip": good,
            "in/sub/slip.ZIP": packed([("../x.pdf", b"1")]),
            "in/none.zip": packed([]),
            "in/torn.zip": good[: len(good) // 2],
            "in/text.zip": b"not a zip",
            "in/bomb.zip": packed([("a.pdf", b"0" * 5000)]),
            "in/note.txt": b"skipped",
        },
    )
    limits = ArchiveLimits(max_single_bytes=2000)
    manifest = archives.archive_manifest(spark, folder + "/in", limits).cache()
    rows = {(r.upload_id, r.entry_no): r for r in manifest.collect()}
    assert [rows[("good", i)].entry_name for i in (1, 2, 3)] == ["team/", "team/ann.docx", "b.pdf"]
    assert rows[("good", 1)].is_directory and rows[("bomb", 1)].size_bytes == 5000
    assert rows[("bomb", 1)].content is None
    uploads = spark.createDataFrame(
        [(u,) for u in ("good", "sub/slip", "none", "torn", "text", "bomb")], "upload_id string"
    )
    verdicts = A.zip_verdict(uploads, manifest, limits).cache()
    assert {r.upload_id: r.reason for r in verdicts.collect()} == {
        "good": None,
        "sub/slip": A.UNSAFE_PATH,
        "none": A.NO_FILES,
        "torn": A.CANNOT_EXTRACT,
        "text": A.NO_FILES,
        "bomb": A.TOO_LARGE_FILE,
    }
    files = documents.files_of_manifest(manifest, verdicts)
    texts = {r.rel_path: r for r in documents.extract_document_text(files, DECODERS).collect()}
    assert texts["team/ann.docx"].text == "Ann Lee\nJava" and texts["team/ann.docx"].error_code is None
    assert texts["b.pdf"].error_code == "PARSE_FAILED"
    pdf = documents.extract_document_text(files, {**documents.DECODERS, PDF_TYPE: lambda b: "pdf text"})
    assert {r.rel_path: r.text for r in pdf.collect()}["b.pdf"] == "pdf text"


def test_archives_to_candidates(spark, folder):
    cv = docx(["Ann Lee", "Backend Developer", "Location: Porto", "7 years of experience", "Java &amp; Kafka"])
    store(
        folder,
        {
            "in/u1.zip": packed([("ann.docx", cv), ("b.pdf", b"%PDF-1.4"), ("c.docx", b"text"), ("d.docx", docx([""]))]),
            "in/u2.zip": packed([("ann.docx", cv), ("run.exe", b"x")]),
            "in/u3.zip": b"PK",
        },
    )
    archives.archive_manifest(spark, folder + "/in").write.parquet(folder + "/manifest")
    manifest = spark.read.parquet(folder + "/manifest")
    now = F.lit(dt.datetime(2024, 1, 1))
    uploads = spark.createDataFrame([(u, u + ".zip") for u in ("u1", "u2", "u3")], "upload_id string, original_filename string")
    docs = documents.documents_of_archives(manifest, A.zip_verdict(uploads, manifest, ArchiveLimits()), DECODERS)
    stored = spark.createDataFrame([], CANDIDATE)
    done = ingest_uploads(uploads, manifest, docs, stored, now)
    (ann,) = done.candidates.collect()
    assert (ann.upload_id, ann.full_name, ann.years_of_experience, ann.preferred_location) == ("u1", "Ann Lee", 7, "Porto")
    assert sorted(ann.skills) == ["Java", "Kafka"]
    assert {r.filename: r.error_code for r in done.failures.collect()} == {
        "b.pdf": "PARSE_FAILED",
        "c.docx": "UNSUPPORTED_MEDIA_TYPE",
        "d.docx": "EMPTY_DOCUMENT",
    }
    assert [(r.upload_id, r.status) for r in done.uploads.collect()] == [("u1", "COMPLETED_WITH_ERRORS")]


def test_types_come_from_content(spark, folder):
    store(
        folder,
        {
            "cvs/u1/a.pdf": b"%PDF-1.7",
            "cvs/u1/x/b.docx": docx(["Ann"]),
            "cvs/u1/c.PDF": b"plain text",
            "cvs/u2/d.docx": packed([("a.txt", b"x")]),
            "cvs/u2/e.docx": docx(["A"])[:-30],
            "cvs/u2/f.txt": b"skipped",
        },
    )
    files = documents.list_cv_files(spark, folder + "/cvs")
    got = {
        (r.upload_id, r.rel_path): (r.media_type, r.error_code)
        for r in documents.extract_document_text(files, DECODERS).collect()
    }
    assert got == {
        ("u1", "a.pdf"): (PDF_TYPE, "PARSE_FAILED"),
        ("u1", "x/b.docx"): (DOCX_TYPE, None),
        ("u1", "c.PDF"): ("text/plain", "UNSUPPORTED_MEDIA_TYPE"),
        ("u2", "d.docx"): ("application/zip", "UNSUPPORTED_MEDIA_TYPE"),
        ("u2", "e.docx"): (DOCX_TYPE, "PARSE_FAILED"),
    }
    with pytest.raises(ValueError, match="application/pdf"):
        documents.extract_document_text(files, documents.DECODERS)


def candidates(spark, n):
    when = dt.datetime(2024, 1, 1)
    rows = [(f"id{i:03d}", "u1", f"Name {i % 50:02d}", i % 7, None, "REMOTE", f"{i}.pdf", when, ["B", "a"]) for i in range(n)]
    return spark.createDataFrame(rows, CANDIDATE)


def test_csv_sink_keeps_order_over_parts(spark, folder):
    exported = X.export_candidates(candidates(spark, 260))
    tables.write_candidates_csv(exported, folder + "/csv")
    parts = sorted(glob.glob(folder + "/csv/part-*"))
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in parts)
    assert text.startswith('﻿"candidateId","uploadId"')
    lines = text.splitlines()
    assert len(lines) == 261
    keys = [(line.split(",")[2], line.split(",")[0]) for line in lines[1:]]
    assert keys == sorted(keys) and lines[1].split(",")[6] == '"a | B"'
    tables.write_candidates_csv(exported.filter("false"), folder + "/none")
    assert len("".join(open(p).read() for p in glob.glob(folder + "/none/part-*")).splitlines()) == 1


def test_failed_export_leaves_the_former_document(spark, folder):
    exported = X.export_candidates(candidates(spark, 30))
    tables.write_candidates_csv(exported, folder + "/csv")
    before = {p: open(p, encoding="utf-8").read() for p in glob.glob(folder + "/csv/part-*")}
    broken = exported.withColumn("full_name", F.when(F.col("id") == "id017", F.raise_error("lost")).otherwise("x"))
    for target in ("/csv", "/new"):
        with pytest.raises(Exception, match="lost"):
            tables.write_candidates_csv(broken, folder + target)
    assert {p: open(p, encoding="utf-8").read() for p in glob.glob(folder + "/csv/part-*")} == before
    assert os.listdir(folder) == ["csv"]
    tables.write_candidates_csv(exported.filter("id = 'id003'"), folder + "/csv")
    assert len("".join(open(p, encoding="utf-8").read() for p in glob.glob(folder + "/csv/part-*")).splitlines()) == 2


def stored_failures(spark, folder, days):
    when = dt.datetime(2024, 1, 1)
    rows = [(f"{d}/{u}/{i}", u, f"{i}.pdf", "X", None, when, d) for d, uploads in days.items() for u in uploads for i in range(3)]
    tables.append_days(spark.createDataFrame(rows, with_day(PROCESSING_FAILURE)), folder, ["upload_id"])


def files_by_day(folder):
    return {d.rsplit("=")[1]: sorted(os.path.basename(p) for p in glob.glob(d + "/*.parquet")) for d in glob.glob(folder + "/arrived_day=*")}


def test_delete_rewrites_touched_days_alone(spark, folder):
    days = [dt.date(2024, 1, i) for i in range(1, 5)]
    held = {days[0]: ["u1", "u2"], days[1]: ["u3"], days[2]: ["u2"], days[3]: ["u1", "u3"], None: ["u2", "u4"]}
    stored_failures(spark, folder + "/failure", held)
    schema = with_day(PROCESSING_FAILURE)
    before = files_by_day(folder + "/failure")
    doomed = spark.createDataFrame([("u2",), ("u2",), ("u9",), (None,)], "upload_id string")
    assert tables.delete_days(spark, folder + "/failure", schema, doomed) == 3
    after = files_by_day(folder + "/failure")
    assert all(after[str(d)] == before[str(d)] for d in (days[1], days[3])) and str(days[2]) not in after
    assert not set(after[str(days[0])]) & set(before[str(days[0])])
    left = tables.stored_table(spark, folder + "/failure", schema)
    got = sorted((str(r.arrived_day), r.upload_id, r.id) for r in left.collect())
    assert got == sorted((str(d), u, f"{d}/{u}/{i}") for d, us in held.items() for u in us if u != "u2" for i in range(3))
    assert tables.delete_days(spark, folder + "/failure", schema, doomed) == 0 and files_by_day(folder + "/failure") == after


def test_stored_cascade_spares_uploads_with_candidates(spark, folder):
    day = dt.date(2024, 1, 1)
    stored_failures(spark, folder + "/failure", {day: ["u1", "u2"]})
    doomed = spark.createDataFrame([("u1",), ("u2",)], "upload_id string")
    people = candidates(spark, 2).withColumn("arrived_day", F.lit(day))
    tables.append_days(people, folder + "/candidate", ["upload_id"])
    blocked = tables.cascade_delete_days(spark, folder + "/candidate", folder + "/failure", doomed)
    assert [r.upload_id for r in blocked.collect()] == ["u1"]
    left = tables.stored_table(spark, folder + "/failure", with_day(PROCESSING_FAILURE))
    assert {r.upload_id for r in left.collect()} == {"u1"}
    none = tables.cascade_delete_days(spark, folder + "/nobody", folder + "/none", doomed)
    assert none.count() == 0


def test_typed_sink_and_tables(spark, folder):
    people = candidates(spark, 5)
    tables.write_candidates_typed(X.export_candidates(people), folder + "/typed")
    assert spark.read.parquet(folder + "/typed").schema["years_of_experience"].dataType.typeName() == "integer"
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/db/{name}")
    tables.append_candidates(people, folder + "/db/candidate")
    tables.explode_skills(people).write.mode("append").parquet(folder + "/db/candidate_skill")
    failures = people.select(
        "id",
        "upload_id",
        F.col("source_filename").alias("filename"),
        F.lit("X").alias("error_code"),
        F.lit(None).cast("string").alias("error_message"),
        "created_at",
    )
    tables.append_failures(failures, folder + "/db/processing_failure")
    extra = people.select("upload_id", F.col("created_at").alias("cleaned_at"))
    for _ in range(2):
        known = tables.load_tables(spark, folder + "/db")["upload_storage_cleanup"]
        tables.append_cleanup_records(known, extra, folder + "/db/upload_storage_cleanup")
    counts = {n: df.count() for n, df in tables.load_tables(spark, folder + "/db").items()}
    assert counts == {
        "cv_upload": 0,
        "candidate": 5,
        "candidate_skill": 10,
        "processing_failure": 5,
        "upload_storage_cleanup": 1,
    }


def test_log_lines(spark, folder):
    store(folder, {"app.log": b"one\ntwo\n"})
    assert [r.line for r in logs.read_lines(spark, folder + "/app.log").collect()] == ["one", "two"]

import random

import pytest
from pyspark.sql import functions as F

from talentgrid.functions.paths import normalize_path, parents
from talentgrid.operators import archive as A
from talentgrid.settings import ArchiveLimits

LIMITS = ArchiveLimits(max_entries=4, max_total_bytes=20, max_single_bytes=10)
SCHEMA = "upload_id string, entry_no int, entry_name string, is_directory boolean, size_bytes long"


def manifest(spark, archives):
    rows = [
        (uid, no, name, name.endswith("/"), size)
        for uid, entries in archives.items()
        for no, (name, size) in enumerate(entries, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


ARCHIVES = {
    "good": ([("a.pdf", 5), ("dir/", 0), ("dir/b.DOCX", 5)], None),
    "none": ([], A.NO_FILES),
    "folders": ([("d/", 0)], A.NO_FILES),
    "many": ([("a.pdf", 1), ("b.pdf", 1), ("c/", 0), ("d.pdf", 1), ("e.pdf", 1)], A.TOO_MANY),
    "five": ([("a.pdf", 1), ("b.pdf", 1), ("c/", 0), ("d.pdf", 1), ("e.exe", 1)], A.TOO_MANY),
    "slip": ([("../../evil.pdf", 1)], A.UNSAFE_PATH),
    "root": ([("/etc/x.pdf", 1)], A.UNSAFE_PATH),
    "blank": ([("  ", 1)], A.INVALID_NAME),
    "nul": ([("a\0.pdf", 1)], A.INVALID_PATH),
    "exe": ([("virus.exe", 1)], A.BAD_EXTENSION),
    "same": ([("a.pdf", 1), ("x/../a.pdf", 1)], A.DUPLICATE),
    "case": ([("a.pdf", 1), ("A.pdf", 1)], None),
    "twice_folder": ([("a/", 0), ("a/", 0), ("a/b.pdf", 1)], None),
    "folder_then_file": ([("a.pdf/", 0), ("a.pdf", 1)], A.DUPLICATE),
    "implied_folder": ([("a.pdf/b.pdf", 1), ("a.pdf", 1)], A.DUPLICATE),
    "file_as_folder": ([("a.pdf", 1), ("a.pdf/b.pdf", 1)], A.CANNOT_EXTRACT),
    "file_then_folder": ([("a.pdf", 1), ("a.pdf/", 0)], A.CANNOT_EXTRACT),
    "large": ([("a.pdf", 11)], A.TOO_LARGE_FILE),
    "limit": ([("a.pdf", 10), ("b.pdf", 10)], None),
    "total": ([("a.pdf", 9), ("b.pdf", 9), ("c.pdf", 3)], A.TOO_LARGE_TOTAL),
    "both_total_first": ([("a.pdf", 9), ("b.pdf", 9), ("c.pdf", 11)], A.TOO_LARGE_TOTAL),
    "both_file_first": ([("a.pdf", 9), ("b.pdf", 12)], A.TOO_LARGE_FILE),
    "first_wins": ([("a.pdf", 11), ("../b.pdf", 1)], A.TOO_LARGE_FILE),
    "itself": ([("x/..", 1)], A.BAD_EXTENSION),
}


def test_verdicts(spark):
    df = manifest(spark, {k: e for k, (e, _) in ARCHIVES.items()})
    uploads = spark.createDataFrame([(k,) for k in ARCHIVES], "upload_id string")
    out = {r.upload_id: r for r in A.zip_verdict(uploads, df, LIMITS).collect()}
    assert {k: r.reason for k, r in out.items()} == {k: reason for k, (_, reason) in ARCHIVES.items()}
    assert (out["good"].accepted, out["good"].file_count, out["good"].total_bytes) == (True, 2, 10)
    assert (out["many"].accepted, out["many"].file_count) == (False, None)


def test_entries_past_the_limit_are_dropped_in_the_scan(spark, folder):
    # One archive holds most rows; only the first limit + 1 may reach the windows.
    rows = [("hot", i, f"f{i}.pdf", False, 1) for i in range(1, 5001)] + [("ok", 1, "a.pdf", False, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder + "/m")
    df = spark.read.parquet(folder + "/m")
    uploads = spark.createDataFrame([("hot",), ("ok",)], "upload_id string")
    verdict = A.zip_verdict(uploads, df, LIMITS)
    assert {r.upload_id: r.reason for r in verdict.collect()} == {"hot": A.TOO_MANY, "ok": None}
    assert "LessThanOrEqual(entry_no,5)" in verdict._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, norm",
    [
        ("a.pdf", "a.pdf"),
        ("a/./b//c.pdf", "a/b/c.pdf"),
        ("a/../b.pdf", "b.pdf"),
        ("a/b/../../c/", "c"),
        ("../a", ".."),
        ("a/../../a/b", ".."),
        ("/a", ".."),
        ("..a/b", "..a/b"),
        ("a/..", ""),
        ("a\\..\\b", "a\\..\\b"),
    ],
)
def test_paths(spark, name, norm):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(normalize_path(F.col("n"))).first()[0] == norm


def test_parents(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",)], "n string")
    assert [r[0] for r in df.select(parents(F.col("n"))).collect()] == [["a", "a/b"], []]


def test_upload_requests(spark):
    rows = [("a.zip", 0), (None, 5), ("a.rar", 5), ("A.ZIP", 5), ("a.zip", None)]
    out = A.validate_upload_request(spark.createDataFrame(rows, "original_filename string, size_bytes long"))
    assert [r.error for r in out.collect()] == [
        A.EMPTY_UPLOAD,
        A.NOT_A_ZIP_NAME,
        A.NOT_A_ZIP_NAME,
        None,
        A.EMPTY_UPLOAD,
    ]


def sequential_verdict(entries):
    """First broken rule of an archive, read entry by entry as an unpacker would."""
    files, folders, total = set(), set(), 0
    for number, (name, size) in enumerate(entries, 1):
        if number > LIMITS.max_entries:
            return A.TOO_MANY
        folder = name.endswith("/")
        path = name.rstrip("/").split("/")
        above = {"/".join(path[:i]) for i in range(1, len(path))}
        own = "/".join(path)
        if not folder and not own.endswith((".pdf", ".docx")):
            return A.BAD_EXTENSION
        if not folder and own in files | folders:
            return A.DUPLICATE
        if (above | ({own} if folder else set())) & files:
            return A.CANNOT_EXTRACT
        if not folder:
            room = LIMITS.max_total_bytes - total
            if size > LIMITS.max_single_bytes and (size <= room or room >= LIMITS.max_single_bytes):
                return A.TOO_LARGE_FILE
            if size > room:
                return A.TOO_LARGE_TOTAL
            files.add(own)
            total += size
        folders |= above | ({own} if folder else set())
    return None if files else A.NO_FILES


def test_verdicts_follow_an_entry_by_entry_reading(spark):
    draw = random.Random(5)
    names = ["a.pdf", "a.pdf/", "a.pdf/b.pdf", "x/", "x/a.pdf", "x/a.pdf/c/d.pdf", "x/y/", "x/y/z.docx", "b.pdf", "t.txt"]
    archives = {
        f"u{i}": [(draw.choice(names), draw.choice([0, 1, 5, 9, 10, 11])) for _ in range(draw.randint(1, 6))]
        for i in range(400)
    }
    uploads = spark.createDataFrame([(k,) for k in archives], "upload_id string")
    out = A.zip_verdict(uploads, manifest(spark, archives), LIMITS).collect()
    expected = {k: sequential_verdict(entries) for k, entries in archives.items()}
    assert {r.upload_id: r.reason for r in out} == expected
    assert len(set(expected.values())) >= 7

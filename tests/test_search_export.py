import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentgrid.functions.csvcells import csv_quote, protect_formula
from talentgrid.operators import export as X
from talentgrid.operators import search as S
from talentgrid.settings import InvalidQuery, UploadNotFound

SCHEMA = (
    "id string, upload_id string, full_name string, years_of_experience int, preferred_location string,"
    " preferred_job_type string, source_filename string, skills array<string>"
)
ROWS = [
    ("1", "u1", "Bea", 5, "Porto", "REMOTE", "b.pdf", ["Java", "Redis"]),
    ("2", "u1", "Al", None, "porto", "HYBRID", "a.pdf", ["java", "JAVA", "Kafka"]),
    ("3", "u2", None, 7, None, "ONSITE", "c.pdf", []),
    ("4", "u2", "Cy", 5, "Oslo", None, "d.pdf", ["Go | Lang", "ada"]),
    ("5", "u3", 'Di "x"', 0, " =2+2", "UNKNOWN", "e,f.pdf", None),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(people):
    def found(**given):
        return sorted(ids(S.filter_criteria(people, S.Criteria(**given))))

    assert found() == ["1", "2", "3", "4", "5"]
    assert found(skill=" jAVA ") == ["1", "2"]
    assert found(location="PORTO ") == ["1", "2"]
    assert found(upload_id="u2") == ["3", "4"]
    assert found(job_type="ONSITE") == ["3"]
    assert found(min_experience=5) == ["1", "3", "4"]
    assert found(max_experience=5) == ["1", "4", "5"]
    assert found(skill="java", min_experience=1, location="porto") == ["1"]
    assert found(skill="\u2003\t") == ["1", "2", "3", "4", "5"]
    assert found(skill="jav") == []


@pytest.mark.parametrize(
    "given", [{"min_experience": -1}, {"max_experience": -1}, {"min_experience": 3, "max_experience": 2}, {"job_type": "X"}]
)
def test_bad_criteria(given):
    with pytest.raises(InvalidQuery):
        S.Criteria(**given)


def test_sort_orders(people):
    assert ids(S.sort_candidates(people)) == ["2", "1", "4", "5", "3"]
    assert ids(S.sort_candidates(people, " yearsOfExperience ", "DESC")) == ["2", "3", "1", "4", "5"]
    assert ids(S.sort_candidates(people, "yearsOfExperience", " ")) == ["5", "1", "4", "3", "2"]
    for bad in [("id", "asc"), ("fullName", "up")]:
        with pytest.raises(InvalidQuery):
            S.sort_order(*bad)
    for bad in [(" fullName", "asc"), ("fullName", None), (None, "asc"), ("fullName", " asc")]:
        with pytest.raises(InvalidQuery):
            S.sort_order(*bad, strict=True)


def test_pages(people, monkeypatch):
    assert ids(S.page_candidates(people, 1, 2)) == ["4", "5"]
    assert ids(S.page_candidates(people, 9, 2)) == []
    monkeypatch.setattr(S, "TOP_ROWS", 2)
    assert ids(S.page_candidates(people, 1, 2)) == ["4", "5"]
    for page, size in ((-1, 2), (0, 0), (0, 101)):
        with pytest.raises(InvalidQuery):
            S.page_candidates(people, page, size)


def test_response(people):
    row = S.search_response(people, S.Criteria(), 1, 2, "fullName", "asc").first()
    assert [c.id for c in row.content] == ["4", "5"]
    assert (row.total_elements, row.total_pages, row.first, row.last) == (5, 3, False, False)
    last = S.search_response(people, S.Criteria(), 2, 2).first()
    assert ([c.id for c in last.content], last.first, last.last) == (["3"], False, True)
    none = S.search_response(people, S.Criteria(skill="cobol")).first()
    assert (none.content, none.total_elements, none.total_pages, none.first, none.last) == ([], 0, 0, True, True)


def test_hydration(spark, people):
    bridge = people.select(F.col("id").alias("candidate_id"), F.explode("skills").alias("skill"))
    uploads = spark.createDataFrame([("u1", "one.zip"), ("u2", "two.zip")], "id string, original_filename string")
    page = people.filter("id in ('1', '3', '5')").select("id")
    full = S.hydrate_candidates(page, people, uploads, bridge)
    got = {r.id: (r.original_filename, sorted(r.skills)) for r in full.collect()}
    assert got == {"1": ("one.zip", ["Java", "Redis"]), "3": ("two.zip", [])}
    assert ids(S.lost_ids(page, full)) == ["5"]
    assert sorted(ids(S.filter_skill_bridge(people, bridge, "java"))) == ["1", "2"]


def test_projection_keeps_one_spelling(people):
    skills = {r.id: r.skills for r in S.project_candidate(people).collect()}
    assert skills["2"] == ["JAVA", "Kafka"] and skills["4"] == ["ada", "Go | Lang"]


def test_uploads_and_failures(spark):
    when = dt.datetime(2024, 1, 1)
    uploads = spark.createDataFrame(
        [("u1", "a.zip", "COMPLETED", 3, 3, 0, when, when)],
        "id string, original_filename string, status string, total_files int, processed_files int,"
        " failed_files int, created_at timestamp, completed_at timestamp",
    )
    assert S.upload_status(uploads, "u1").first().total_files == 3
    with pytest.raises(UploadNotFound):
        S.upload_status(uploads, "u9")
    rows = [(str(i), "u1", f"{i % 3}.pdf", "X", "m", when + dt.timedelta(days=i // 3)) for i in range(6)]
    failures = spark.createDataFrame(
        rows, "id string, upload_id string, filename string, error_code string, error_message string, created_at timestamp"
    )
    page = S.page_failures(failures, uploads, "u1", 0, 4).collect()
    assert [(r.created_at.day, r.filename) for r in page] == [(2, "0.pdf"), (2, "1.pdf"), (2, "2.pdf"), (1, "0.pdf")]
    with pytest.raises(UploadNotFound):
        S.page_failures(failures, uploads, "u9")


def test_existence(spark, people):
    assert S.candidate_exists(people, "u1", "a.pdf") and not S.candidate_exists(people, "u2", "a.pdf")
    wanted = spark.createDataFrame([("u1", "a.pdf"), ("u2", "a.pdf")], "upload_id string, source_filename string")
    got = {r.upload_id: r.found for r in S.existing_candidates(wanted, people).collect()}
    assert got == {"u1": True, "u2": False}


def test_csv_cells(spark):
    texts = ["=1", " +1", "\t-1", "@x", "a=1", "", "   ", None, "\u00a0=1", 'a"b']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    safe = [r[0] for r in df.select(protect_formula(F.col("v"))).collect()]
    assert safe == ["'=1", "' +1", "'\t-1", "'@x", "a=1", "", "   ", None, "\u00a0=1", 'a"b']
    quoted = [r[0] for r in df.select(csv_quote(F.col("v"))).collect()]
    assert quoted[-1] == '"a""b"' and quoted[7] == '""'


def test_export_lines(people):
    lines = [r.line for r in X.csv_rows(X.export_candidates(people)).collect()]
    assert lines[0] == '"2","u1","Al","","porto","HYBRID","java | JAVA | Kafka","a.pdf"' or lines[
        0
    ] == '"2","u1","Al","","porto","HYBRID","JAVA | java | Kafka","a.pdf"'
    assert lines[3] == '"5","u3","Di ""x""","0","\' =2+2","UNKNOWN","","e,f.pdf"'
    assert lines[4] == '"3","u2","","7","","ONSITE","","c.pdf"'
    assert X.csv_rows(X.export_candidates(people, S.Criteria(skill="cobol"))).collect() == []
    header = X.csv_header(people.limit(0)).collect()
    assert header[0].line.startswith('"candidateId","uploadId"')


def test_typed_export(people):
    rows = {r.id: r for r in X.typed_rows(X.export_candidates(people, S.Criteria(), "sourceFilename", "desc")).collect()}
    assert rows["2"].years_of_experience is None and rows["3"].full_name == ""
    assert rows["5"].preferred_location == " =2+2" and rows["5"].skills == ""

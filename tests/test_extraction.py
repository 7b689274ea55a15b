import pytest
from pyspark.sql import functions as F

from talentgrid.functions import extract as X
from talentgrid.functions.text import basename, clean_message, is_blank, normalize_text, trimmed
from talentgrid.operators.candidates import extract_candidates
from talentgrid.operators.documents import classify_document
from talentgrid.settings import PDF_TYPE, ParsingLimits

SCHEMA = "id int, text string"


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r.v for r in df.select("id", column(F.col("text")).alias("v")).orderBy("id").collect()]


NAMES = [
    ("Full name: Maria Sousa\nPython", None, "Maria Sousa Python"),
    ("Full Name :  Maria   Sousa\n\n- Engineer", None, "Maria Sousa"),
    ("Résumé\nNAME - Élodie d’Arc\n1", None, "Élodie d’Arc"),
    ("Curriculum   Vitae\nMaria Sousa", "Maria Sousa", None),
    ("Senior Data Engineer\nMaria Sousa", "Maria Sousa", None),
    ("Lead Singer\r\nMaria Sousa", "Maria Sousa", None),
    ("Leads Singer\rMaria Sousa", "Leads Singer", None),
    ("maria@example.org\nhttps://example.org\nwww.maria sousa\nMaria Sousa", "Maria Sousa", None),
    ("Maria\nMaria 2 Sousa\n  Maria\tde  Sousa \nx", "Maria\tde  Sousa", None),
    ("One Two Three Four Five Six\nA B", "A B", None),
    ("a" * 60 + " " + "b" * 60 + "\nMaria Sousa", "Maria Sousa", None),
    ("a" * 49 + "   " + "b" * 50 + "\nMaria Sousa", "a" * 49 + "   " + "b" * 50, None),
    ("a" * 50 + "   " + "b" * 50 + "\nMaria Sousa", "Maria Sousa", None),
    ("WWW.example com\nO'Neil St. Clair", "O'Neil St. Clair", None),
    ("'Neil Sousa\nMaria, Sousa", None, None),
    ("technical skills\nWork  Experience", None, None),
    ("Gülnarə Əliyeva\nx", "Gülnarə Əliyeva", None),
    ("", None, None),
    (None, None, None),
]


def test_name_rules(spark):
    texts = [t for t, _, _ in NAMES]
    assert values(spark, texts, X.name_by_line) == [e for _, e, _ in NAMES]
    assert values(spark, texts, X.name_by_label) == [e for _, _, e in NAMES]


def test_name_label_eats_following_word_lines(spark):
    assert values(spark, ["Name: Jane Doe\nEngineer\nJava"], X.full_name) == ["Jane Doe Engineer Java"]


@pytest.mark.parametrize(
    "text, plain, qualified, best",
    [
        ("5 years of experience", 5, None, 5),
        ("over 12+ years experience", 12, None, 12),
        ("More than 9 years of professional experience", 9, 9, 9),
        ("3 yrs experience, at least 7 years  experience", 7, 7, 7),
        ("105 years experience", None, None, None),
        ("5-7 yrs of experience", 7, None, 7),
        ("7yr experience", 7, None, 7),
        ("0 years of professional experience", 0, None, 0),
        ("5 years experienced", None, None, None),
        ("five years experience", None, None, None),
        ("é5 years experience", 5, None, 5),
        ("x5 years experience", None, None, None),
        ("5 years experienceé", 5, None, 5),
        (None, None, None, None),
    ],
)
def test_experience(spark, text, plain, qualified, best):
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(
        X.experience(F.col("text")), X.qualified_experience(F.col("text")), X.years_of_experience(F.col("text"))
    ).first()
    assert tuple(row) == (plain, qualified, best)


def test_locations(spark):
    texts = [
        "Location: Porto",
        "preferred   location -  Rio  de Janeiro ",
        "Current location:X",
        "Location:\n\nSkills",
        "Based in Berlin\nLocation: Porto",
        "LOCATED IN: Oslo",
        "I am based in Berlin",
        "nothing",
    ]
    expected = ["Porto", "Rio de Janeiro", None, "Skills", "Porto", "Oslo", None, None]
    assert values(spark, texts, X.preferred_location) == expected


def test_job_types(spark):
    texts = [
        "Preferred work type: Remote",
        "work arrangement - HYBRID",
        "Job type: on-site",
        "Work type: on\nsite",
        "teams\n  On Site \nremote",
        "worked with remote teams",
        "Remote\nPreferred type: hybrid",
        None,
    ]
    expected = ["REMOTE", "HYBRID", "ONSITE", "UNKNOWN", "ONSITE", "UNKNOWN", "HYBRID", "UNKNOWN"]
    assert values(spark, texts, X.preferred_job_type) == expected


def test_skills_are_whole_terms(spark):
    texts = [
        "JavaScript and TypeScript",
        "java/SPRING boot, éjava javaé java2",
        "Spring, Springs",
        "spring  boot",
        "my.git|AWS_rest",
        "Gıt Kafka poſtgreſql",
        "restful",
        None,
    ]
    found = values(spark, texts, lambda c: X.suppress_shadowed(X.detect_skills(c)))
    assert found[0] == ["JavaScript", "TypeScript"]
    assert found[1] == ["Spring Boot", "Java"]
    assert found[2] == ["Spring"]
    assert found[3] == ["Spring"]
    assert found[4] == ["REST", "Git", "AWS"]
    assert found[5] == ["PostgreSQL", "Kafka", "Git"]
    assert found[6] == []


def test_custom_skill_terms(spark):
    found = values(spark, ["c++ and C#", "Über-Go"], lambda c: X.detect_skills(c, None, ["C++", "C#", "über"]))
    assert found == [["C++", "C#"], ["über"]]


def test_text_normalisation(spark):
    texts = [" \t\x00a\t\x0b b\r\n\n\n\nc \x01", "x\n\ny", " ", " ", None]
    clean = values(spark, texts, normalize_text)
    assert clean == ["a b \n\nc", "x\n\ny", " ", " ", None]
    assert values(spark, texts, is_blank) == [False, False, False, True, None]
    assert values(spark, ["\t a \x1f"], trimmed) == ["a"]
    assert values(spark, ["a/b/c.pdf", "c.pdf", "a/b/", "/"], basename) == ["c.pdf", "c.pdf", "b", None]


def test_messages(spark):
    texts = ["a\r\n\nb ", " \n", None, "x" * 1200]
    expected = ["a b", "RuntimeException", "Unknown processing failure", "x" * 1000]
    assert values(spark, texts, clean_message) == expected


def test_whole_draft(spark):
    text = (
        "Rosa Lima\nBackend Developer\nLocation: Porto\nPreferred work type: Remote\n"
        "5 years of experience\nJava\nSpring Boot\nKafka"
    )
    rows = [("cvs/a.pdf", text), ("b.pdf", "  "), ("c.pdf", "12345\nskills\na@b.c"), ("d.pdf", None)]
    out = extract_candidates(spark.createDataFrame(rows, "rel_path string, text string")).collect()
    by_path = {r.rel_path: r for r in out}
    a = by_path["cvs/a.pdf"]
    assert (a.full_name, a.years_of_experience, a.preferred_location) == ("Rosa Lima", 5, "Porto")
    assert (a.preferred_job_type, a.source_filename, a.error) == ("REMOTE", "a.pdf", None)
    assert sorted(a.skills) == ["Java", "Kafka", "Spring Boot"]
    assert {p: r.error for p, r in by_path.items() if r.error} == {
        "b.pdf": "Cannot extract candidate from empty document: b.pdf",
        "c.pdf": "Candidate full name could not be extracted",
        "d.pdf": "Cannot extract candidate from empty document: d.pdf",
    }
    assert {(r.skills, r.preferred_job_type, r.source_filename) for r in out if r.error} == {(None, None, None)}


def test_classification_order(spark):
    rows = [
        ("x/a.pdf", PDF_TYPE, False, "text"),
        ("x/b.pdf", "text/plain", True, "text"),
        ("x/c.pdf", PDF_TYPE, True, "t" * 11),
        ("x/d.pdf", PDF_TYPE, True, None),
        ("x/e.pdf", PDF_TYPE, True, " \n "),
        ("x/f.pdf", PDF_TYPE, True, "fine"),
        ("x/g.pdf", None, True, "fine"),
    ]
    docs = spark.createDataFrame(rows, "rel_path string, media_type string, file_exists boolean, text string")
    out = classify_document(docs, ParsingLimits(max_text_length=10)).orderBy("rel_path").collect()
    assert [r.error_code for r in out] == [
        "FILE_NOT_FOUND",
        "UNSUPPORTED_MEDIA_TYPE",
        "TEXT_LIMIT_EXCEEDED",
        "PARSE_FAILED",
        "EMPTY_DOCUMENT",
        None,
        "UNSUPPORTED_MEDIA_TYPE",
    ]
    assert out[1].error_message == "Unsupported actual document type 'text/plain' for file: b.pdf"
    assert out[5].text == "fine"

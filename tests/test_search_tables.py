"""Searches over stored tables: pages that are fetched by id, and many criteria at once."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import search as S
from talentgrid.operators.ordered import numbered
from talentgrid.schemas import CANDIDATE, TABLES
from talentgrid.settings import InvalidQuery
from talentgrid.sources.tables import load_tables, store_tables
from tests.conftest import plan_of

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture()
def tables(spark, folder):
    people = [
        (f"id{i:03d}", f"u{i % 7}", f"Name {i % 10}", i % 30 if i % 5 else None, ("Porto", "LYON", None)[i % 3], ("REMOTE", "HYBRID")[i % 2], f"{i}.pdf", NOW, None)
        for i in range(90)
    ]
    rows = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    rows["candidate"] = spark.createDataFrame(people, CANDIDATE)
    rows["candidate_skill"] = spark.createDataFrame([(p[0], s) for p in people for s in ("java", "Java", "AWS")[: int(p[0][2:]) % 4]], TABLES["candidate_skill"])
    rows["cv_upload"] = spark.createDataFrame([(f"u{k}", f"u{k}.zip", "COMPLETED", 1, 1, 0, NOW, NOW) for k in range(7)], TABLES["cv_upload"])
    store_tables(rows, folder)
    return load_tables(spark, folder)


def test_page_is_fetched_by_id(spark, tables):
    criteria = S.Criteria(job_type="REMOTE", min_experience=4)
    plain = [r.id for r in S.search_candidates(tables["candidate"], criteria, 1, 10, "yearsOfExperience", "desc").collect()]
    page = S.search_hydrated(tables, criteria, 1, 10, "yearsOfExperience", "desc")
    rows = page.collect()
    assert [r.id for r in rows] == plain and [r.position for r in rows] == list(range(1, 11))
    for r in rows:
        i = int(r.id[2:])
        assert r.original_filename == f"u{i % 7}.zip" and [s.lower() for s in r.skills] == ([], ["java"], ["java"], ["aws", "java"])[i % 4]
    plan = plan_of(page)
    assert "In(upload_id" in plan and "In(id" in plan and "In(candidate_id" in plan and "file_path" in plan
    assert S.search_hydrated(tables, S.Criteria(upload_id="none")).count() == 0
    with pytest.raises(InvalidQuery):
        S.search_hydrated(tables, sort_by="id")


def test_lost_id_is_an_error(spark, tables):
    gone = {**tables, "cv_upload": tables["cv_upload"].filter("id <> 'u3'")}
    with pytest.raises(Exception, match="CandidateLost: id0"):
        S.search_hydrated(gone, size=100).collect()
    # tables that no file holds work as well
    held = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in tables.items()}
    assert S.search_hydrated(held, size=100).count() == 90


def test_criteria_tables_agree_with_one_search_each(spark, tables):
    skills = tables["candidate_skill"].groupBy("candidate_id").agg(F.collect_list("skill").alias("skills"))
    people = tables["candidate"].drop("skills").join(skills, F.col("id") == F.col("candidate_id"), "left").cache()
    choices = itertools.product((None, " ", "JAVA "), (None, "lyon"), (None, "REMOTE", "OFFICE"), (None, -1, 0, 7, 26), (None, -2, 3, 7, 29, 400))
    asked = [(i, *c) for i, c in enumerate(choices)]
    schema = "criteria_id int, skill string, location string, job_type string, min_experience int, max_experience int"
    got = {r.criteria_id: (r.error, r.matches) for r in S.count_matches(people, spark.createDataFrame(asked, schema)).collect()}
    assert len(got) == len(asked)
    local = [(r, {s.lower() for s in r.skills or []}) for r in people.collect()]
    for i, *c in asked:
        try:
            k = S.Criteria(None, *c)
        except InvalidQuery as error:
            assert got[i] == (str(error), None)
            continue
        n = sum(
            (k.skill is None or k.skill.lower() in own)
            and (k.location is None or (r.preferred_location or "").lower() == k.location)
            and k.job_type in (None, r.preferred_job_type)
            and (k.min_experience is None or (r.years_of_experience is not None and r.years_of_experience >= k.min_experience))
            and (k.max_experience is None or (r.years_of_experience is not None and r.years_of_experience <= k.max_experience))
            for r, own in local
        )
        assert got[i] == (None, n)


def test_places_of_sorted_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5).orderBy(F.desc("k"))
    assert all(r.place == 1000 - r.k for r in numbered(rows, "place").collect())
    assert numbered(rows.limit(0), "place").count() == 0

"""Queries that filter, sort, page and export candidates, and page failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions.csvcells import csv_quote, join_skills, protect_formula
from talentgrid.operators import export as X
from talentgrid.operators import search as S
from talentgrid.operators.ordered import numbered
from talentgrid.plans.catalog import oracle_step, query
from talentgrid.plans.fixtures import stored_tables
from talentgrid.sources.tables import csv_document

_ID = "SELECT id FROM candidate WHERE "


def _filter(name, criteria, where):
    @query(name, _ID + where)
    def _(t):
        return S.filter_criteria(t["candidate"], criteria).select("id")


_HAS_JAVA = "list_contains(list_transform(skills, lambda s: lower(s)), 'java')"
_filter("filter_upload", S.Criteria(upload_id="u00000007"), "upload_id = 'u00000007'")
_filter("filter_skill", S.Criteria(skill=" JAVA "), _HAS_JAVA)
_filter("filter_location", S.Criteria(location="nation_3"), "lower(preferred_location) = 'nation_3'")
_filter("filter_job_type", S.Criteria(job_type="REMOTE"), "preferred_job_type = 'REMOTE'")
_filter("filter_min_experience", S.Criteria(min_experience=10), "years_of_experience >= 10")
_filter("filter_max_experience", S.Criteria(max_experience=5), "years_of_experience <= 5")
_filter(
    "filter_criteria",
    S.Criteria(skill="java", job_type="HYBRID", min_experience=2, max_experience=20),
    f"{_HAS_JAVA} AND preferred_job_type = 'HYBRID' AND years_of_experience BETWEEN 2 AND 20",
)


@query(
    "filter_skill_bridge",
    "SELECT DISTINCT candidate_id AS id FROM candidate_skill WHERE lower(skill) = 'java'",
)
def _(t):
    return S.filter_skill_bridge(t["candidate"], t["candidate_skill"], "Java").select("id")


@query(
    "sort_candidates",
    """
    SELECT id, cast(row_number() OVER (ORDER BY years_of_experience DESC NULLS FIRST, id) AS bigint) AS position
    FROM candidate""",
)
def _(t):
    rows = t["candidate"].select("id", "years_of_experience")
    return numbered(S.sort_candidates(rows, "yearsOfExperience", "desc"), "position").select("id", "position")


_PAGE = """
    SELECT id, full_name FROM candidate ORDER BY full_name ASC NULLS LAST, id LIMIT 20 OFFSET 40"""


@query("page_candidates", _PAGE)
def _(t):
    return S.page_candidates(t["candidate"], page=2, size=20).select("id", "full_name")


@query(
    "page_envelope",
    """
    SELECT array_to_string(list(id ORDER BY years_of_experience DESC NULLS FIRST, id), ',') AS ids, 1 AS page,
        10 AS size, any_value(total) AS total_elements, cast(ceil(any_value(total) / 10) AS int) AS total_pages,
        false AS first, ceil(any_value(total) / 10) <= 2 AS last
    FROM (
        SELECT *, count(*) OVER () AS total FROM candidate WHERE preferred_job_type = 'REMOTE'
        ORDER BY years_of_experience DESC NULLS FIRST, id LIMIT 10 OFFSET 10
    ) AS p""",
)
def _(t):
    criteria = S.Criteria(job_type="REMOTE")
    page = S.search_response(t["candidate"], criteria, 1, 10, "yearsOfExperience", "desc")
    ids = F.array_join(F.transform("content", lambda c: c["id"]), ",").alias("ids")
    return page.select(ids, "page", "size", "total_elements", "total_pages", "first", "last")


oracle_step(
    "response",
    """
    SELECT id, upload_id, full_name, years_of_experience, preferred_location, preferred_job_type,
        source_filename, (SELECT string_agg(s, '|' ORDER BY lower(s)) FROM (
            SELECT min(skill) AS s FROM (SELECT unnest(skills) AS skill) AS u GROUP BY lower(skill)) AS d) AS skills
    FROM candidate""",
)
_CELLS = "id, upload_id, full_name, years_of_experience, preferred_location, preferred_job_type, skills, source_filename"


@query(
    "hydrate_candidates",
    f"""
    SELECT c.id, c.upload_id, u.original_filename, c.full_name, list_aggregate(list_sort(c.skills), 'string_agg', '|') AS skills
    FROM candidate AS c JOIN cv_upload AS u ON u.id = c.upload_id
    WHERE c.id IN (SELECT id FROM ({_PAGE}) AS p)""",
)
def _(t):
    page = S.page_candidates(t["candidate"], page=2, size=20)
    full = S.hydrate_candidates(page, t["candidate"], t["cv_upload"], t["candidate_skill"])
    skills = F.array_join(F.array_sort("skills"), "|").alias("skills")
    return full.select("id", "upload_id", "original_filename", "full_name", skills)


def _flat(df):
    return df.withColumn("skills", F.array_join("skills", "|"))


@query("project_candidate", f"SELECT {_CELLS} FROM response")
def _(t):
    return _flat(S.project_candidate(t["candidate"]))


@query(
    "search_candidates",
    f"""
    SELECT {_CELLS} FROM response
    WHERE list_contains(string_split(lower(skills), '|'), 'java') AND years_of_experience >= 3
    ORDER BY years_of_experience DESC NULLS FIRST, id LIMIT 20""",
)
def _(t):
    criteria = S.Criteria(skill="java", min_experience=3)
    found = S.search_candidates(t["candidate"], criteria, 0, 20, "yearsOfExperience", "DESC")
    return _flat(found)


@query(
    "search_hydrated",
    f"""
    SELECT cast(row_number() OVER (ORDER BY p.years_of_experience DESC NULLS FIRST, p.id) AS int) AS position, u.original_filename,
        r.* EXCLUDE (original_filename)
    FROM (SELECT {_CELLS}, 1 AS original_filename FROM response) AS r
    JOIN (SELECT id, upload_id, years_of_experience FROM candidate
        WHERE preferred_job_type = 'REMOTE' AND years_of_experience >= 3
        ORDER BY years_of_experience DESC NULLS FIRST, id LIMIT 50 OFFSET 50) AS p ON p.id = r.id
    JOIN cv_upload AS u ON u.id = p.upload_id""",
)
def _(t):
    criteria = S.Criteria(job_type="REMOTE", min_experience=3)
    return _flat(S.search_hydrated(stored_tables(t), criteria, 1, 50, "yearsOfExperience", "DESC"))


oracle_step(
    "criteria_read",
    """
    SELECT criteria_id, lower(nullif(trim(skill), '')) AS skill, lower(nullif(trim(location), '')) AS location, job_type,
        min_experience AS low, max_experience AS high,
        CASE WHEN job_type = 'OFFICE' THEN 'unknown job type: OFFICE'
            WHEN min_experience < 0 THEN 'minExperience must not be negative'
            WHEN max_experience < 0 THEN 'maxExperience must not be negative'
            WHEN min_experience > max_experience
                THEN 'minExperience must be less than or equal to maxExperience' END AS error
    FROM criteria""",
)
oracle_step(
    "criteria_found",
    """
    SELECT a.*, (SELECT count(*) FROM candidate AS c
        WHERE (a.skill IS NULL OR list_contains(list_transform(c.skills, lambda s: lower(s)), a.skill))
            AND (a.location IS NULL OR lower(c.preferred_location) = a.location)
            AND (a.job_type IS NULL OR c.preferred_job_type = a.job_type)
            AND (a.low IS NULL OR c.years_of_experience >= a.low)
            AND (a.high IS NULL OR c.years_of_experience <= a.high)) AS matches
    FROM (SELECT DISTINCT skill, location, job_type, low, high FROM criteria_read WHERE error IS NULL) AS a""",
)


@query(
    "normalize_criteria",
    """
    SELECT n.criteria_id, n.error, f.matches FROM criteria_read AS n LEFT JOIN criteria_found AS f ON n.error IS NULL
        AND f.skill IS NOT DISTINCT FROM n.skill AND f.location IS NOT DISTINCT FROM n.location
        AND f.job_type IS NOT DISTINCT FROM n.job_type AND f.low IS NOT DISTINCT FROM n.low
        AND f.high IS NOT DISTINCT FROM n.high""",
)
def _(t):
    return S.count_matches(t["candidate"], t["criteria"])


@query("candidates_of_upload", _ID + "upload_id = 'u00000042'")
def _(t):
    return S.candidates_of_upload(t["candidate"], "u00000042").select("id")


@query(
    "candidate_exists",
    """
    SELECT f.upload_id, f.filename AS source_filename, EXISTS (SELECT 1 FROM candidate AS c
        WHERE c.upload_id = f.upload_id AND c.source_filename = f.filename) AS found
    FROM processing_failure AS f""",
)
def _(t):
    wanted = t["processing_failure"].select("upload_id", F.col("filename").alias("source_filename"))
    return S.existing_candidates(wanted, t["candidate"])


@query(
    "upload_status",
    """
    SELECT id, original_filename, status, total_files, processed_files, failed_files, created_at, completed_at
    FROM cv_upload WHERE id = 'u00000101'""",
)
def _(t):
    return S.upload_status(t["cv_upload"], "u00000101")


_FAILURES = """
    SELECT filename, error_code, error_message, created_at FROM processing_failure
    WHERE upload_id = 'u00000005' ORDER BY created_at DESC, filename, id"""


@query("page_failures", _FAILURES + " LIMIT 3 OFFSET 0")
def _(t):
    rows = S.page_failures(t["processing_failure"], t["cv_upload"], "u00000005", 0, 3)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("project_failure", "SELECT filename, error_code, error_message, created_at FROM processing_failure")
def _(t):
    rows = S.project_failure(t["processing_failure"])
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


oracle_step(
    "export",
    f"""
    SELECT * EXCLUDE (skills), (SELECT string_agg(s, ' | ' ORDER BY lower(s), s) FROM (
        SELECT unnest(skills) AS s) AS u) AS skills FROM candidate""",
)
_RISKY = r"'^\s*[=+\-@]'"


def _cell(value: str) -> str:
    safe = rf"CASE WHEN regexp_matches({value}, {_RISKY}) THEN '''' || {value} ELSE {value} END"
    return f"""'"' || replace(coalesce({safe}, ''), '"', '""') || '"'"""


def _exported(t):
    return X.export_candidates(t["candidate"], S.Criteria(min_experience=1), "fullName", "desc")


@query(
    "export_candidates",
    f"SELECT {_CELLS} FROM export WHERE years_of_experience >= 1",
)
def _(t):
    return _exported(t).withColumn("skills", join_skills(F.col("skills")))


@query("export_rows", f"SELECT {_CELLS} FROM export")
def _(t):
    return X.export_rows(t["candidate"]).withColumn("skills", join_skills(F.col("skills")))


@query("join_skills", "SELECT id, skills AS value FROM export")
def _(t):
    return X.export_rows(t["candidate"]).select("id", join_skills(F.col("skills")).alias("value"))


@query(
    "protect_formula",
    rf"""
    SELECT upload_id, rel_path, CASE WHEN regexp_matches(line, {_RISKY}) THEN '''' || line ELSE line END AS value
    FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM resume_files) AS l""",
)
def _(t):
    lines = t["resume_files"].select("upload_id", "rel_path", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select("upload_id", "rel_path", protect_formula(F.col("line")).alias("value"))


@query(
    "csv_quote",
    """
    SELECT upload_id, rel_path, '"' || replace(coalesce(text, ''), '"', '""') || '"' AS value
    FROM resume_files""",
)
def _(t):
    return t["resume_files"].select("upload_id", "rel_path", csv_quote(F.col("text")).alias("value"))


_LINE = " || ',' || ".join(_cell(c if c != "years_of_experience" else f"cast({c} AS varchar)") for c in _CELLS.split(", "))


@query("csv_line", f"SELECT {_LINE} AS line FROM export WHERE years_of_experience >= 1")
def _(t):
    return X.csv_rows(_exported(t))


@query(
    "write_candidates_csv",
    f"""
    SELECT chr(65279) || '"candidateId","uploadId","fullName","yearsOfExperience","preferredLocation",'
        || '"preferredJobType","skills","sourceFilename"' AS line
    FROM (SELECT count(*) FROM candidate) AS c
    UNION ALL SELECT {_LINE} FROM export WHERE years_of_experience >= 1""",
)
def _(t):
    return csv_document(_exported(t))


@query(
    "write_candidates_typed",
    """
    SELECT id, upload_id, coalesce(full_name, '') AS full_name, years_of_experience,
        coalesce(preferred_location, '') AS preferred_location, preferred_job_type, skills, source_filename
    FROM export""",
)
def _(t):
    return X.typed_rows(X.export_candidates(t["candidate"], S.Criteria(), "yearsOfExperience", "asc"))

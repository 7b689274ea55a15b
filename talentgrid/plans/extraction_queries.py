"""Queries that read fields out of résumé and document texts, all of them and whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import extract as X
from talentgrid.functions import patterns as P
from talentgrid.functions.text import basename, collapse_whitespace, folded, is_blank, normalize_text
from talentgrid.operators import documents as D
from talentgrid.operators.candidates import extract_candidates
from talentgrid.plans.catalog import oracle_step, query
from talentgrid.settings import DOCX_TYPE, PDF_TYPE, ParsingLimits

PARSING = ParsingLimits(max_text_length=12_000)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


_WORDS = rf"{P.NAME_WORD}"
_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"


def _squeezed(value: str) -> str:
    return rf"regexp_replace(regexp_replace({value}, {_TRIM}), '\s+', ' ', 'g')"


def _has_term(term: str) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}]){term}($|[^\p{{L}}\p{{N}}])')"


def _fields(source: str) -> str:
    """Oracle for every extraction rule: fields of the rows of ``source`` (upload_id, rel_path, text)."""
    line_ok = rf"""len(l) BETWEEN 3 AND 100 AND NOT list_contains({_list(P.SECTION_HEADINGS)}, lower(l))
        AND NOT regexp_matches(l, '[@0-9]') AND NOT regexp_matches(lower(l), '^(https?://|www[.])')
        AND regexp_full_match(l, {_q(_WORDS + '(?: ' + _WORDS + '){1,4}')})
        AND len(list_intersect(string_split(lower(l), ' '), {_list(P.JOB_TITLE_WORDS)})) = 0"""
    jobs = _list(P.JOB_TYPE_LINES)
    found = ", ".join(f"CASE WHEN {_has_term(s)} THEN {_q(s)} END" for s in P.KNOWN_SKILLS)
    return rf"""
    SELECT *, coalesce(name_label, name_line) AS full_name, greatest(years_plain, years_qualified) AS years,
        coalesce(location_label, location_phrase) AS location,
        CASE replace(replace(lower(coalesce(job_label, job_line)), '-', ''), ' ', '') WHEN 'remote' THEN 'REMOTE'
            WHEN 'hybrid' THEN 'HYBRID' WHEN 'onsite' THEN 'ONSITE' ELSE 'UNKNOWN' END AS job_type,
        CASE WHEN list_contains(found, 'Spring Boot') THEN list_filter(found, lambda s: s <> 'Spring')
            ELSE found END AS skills
    FROM (
        SELECT *,
            nullif({_squeezed(f"regexp_extract(text, {_q(P.NAME_LABEL)}, 1)")}, '') AS name_label,
            list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'),
                lambda l: regexp_replace(l, {_TRIM})),
                lambda r: regexp_matches(r, '\S') AND list_bool_and(list_transform(
                    [regexp_replace(r, '\s+', ' ', 'g')], lambda l: {line_ok})))[1] AS name_line,
            list_max(list_transform(regexp_extract_all(text, {_q(P.EXPERIENCE)}, 1),
                lambda x: cast(x AS int))) AS years_plain,
            list_max(list_transform(regexp_extract_all(text, {_q(P.QUALIFIED_EXPERIENCE)}, 1),
                lambda x: cast(x AS int))) AS years_qualified,
            nullif({_squeezed(f"regexp_extract(text, {_q(P.LOCATION)}, 1)")}, '') AS location_label,
            nullif({_squeezed(f"regexp_extract(text, {_q(P.BASED_IN)}, 1)")}, '') AS location_phrase,
            nullif(regexp_extract(text, {_q(P.JOB_TYPE)}, 1), '') AS job_label,
            list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'),
                lambda l: regexp_replace(l, {_TRIM})),
                lambda l: list_contains({jobs}, lower(l)))[1] AS job_line,
            list_filter([{found}], lambda s: s IS NOT NULL) AS found
        FROM {source}
    ) AS parts"""


oracle_step("fields", _fields("resume_files"))
oracle_step(
    "normalized",
    r"""
    SELECT upload_id, rel_path, media_type, file_exists, text AS raw, regexp_replace(regexp_replace(
        regexp_replace(replace(text, chr(0), ''), '[\t\x0B\f\r ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
        '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text
    FROM resume_files""",
)
oracle_step(
    "classified",
    rf"""
    SELECT upload_id, rel_path, media_type, text, code AS error_code, CASE code
        WHEN 'FILE_NOT_FOUND' THEN 'Document does not exist: ' || name
        WHEN 'UNSUPPORTED_MEDIA_TYPE' THEN
            'Unsupported actual document type ''' || media_type || ''' for file: ' || name
        WHEN 'TEXT_LIMIT_EXCEEDED' THEN 'Extracted text exceeds maximum allowed length: ' || name
        WHEN 'PARSE_FAILED' THEN 'Failed to parse document: ' || name
        WHEN 'EMPTY_DOCUMENT' THEN 'Document does not contain extractable text: ' || name END AS error_message
    FROM (
        SELECT *, string_split(rel_path, '/')[-1] AS name, CASE
            WHEN NOT file_exists THEN 'FILE_NOT_FOUND'
            WHEN media_type NOT IN ('{PDF_TYPE}', '{DOCX_TYPE}') THEN 'UNSUPPORTED_MEDIA_TYPE'
            WHEN length(raw) > 12000 THEN 'TEXT_LIMIT_EXCEEDED'
            WHEN raw IS NULL THEN 'PARSE_FAILED'
            WHEN NOT regexp_matches(text, '\S') THEN 'EMPTY_DOCUMENT' END AS code
        FROM normalized
    ) AS coded""",
)
oracle_step(
    "clean_files",
    "SELECT upload_id, rel_path, text FROM classified WHERE error_code IS NULL",
)
oracle_step("clean_fields", _fields("clean_files"))

_KEY = ["upload_id", "rel_path"]
_TERMS = ["Java", "REST", "Spring", "experience", "de"]


def _field(name, column, sql_value, alias="value"):
    """Register one rule over every text."""

    @query(name, f"SELECT upload_id, rel_path, {sql_value} AS {alias} FROM fields")
    def _(t):
        texts = t["resume_files"].select(*_KEY, "text").withColumn("low", folded(F.col("text")))
        return texts.select(*_KEY, column(F.col("text"), F.col("low")).alias(alias))


def _joined(skills):
    return F.array_join(skills, "|")


_field("extract_name_label", X.name_by_label, "name_label")
_field("extract_name_fallback", lambda text, low: X.name_by_line(text), "name_line")
_field("extract_full_name", X.full_name, "coalesce(name_label, name_line)")
_field("extract_experience", X.experience, "years_plain")
_field("extract_qualified_experience", X.qualified_experience, "years_qualified")
_field("extract_years_of_experience", X.years_of_experience, "greatest(years_plain, years_qualified)")
_field("extract_location_label", X.location_by_label, "location_label")
_field("extract_based_in", X.location_by_phrase, "location_phrase")
_field("extract_preferred_location", X.preferred_location, "coalesce(location_label, location_phrase)")
_field("extract_job_type_label", X.job_type_by_label, "job_label")
_field("extract_job_type_line", X.job_type_by_line, "job_line")
_field("extract_preferred_job_type", X.preferred_job_type, "job_type")
_field("detect_skills", lambda text, low: _joined(X.detect_skills(text, low)), "array_to_string(found, '|')")
_field(
    "suppress_shadowed_skill",
    lambda text, low: _joined(X.suppress_shadowed(X.detect_skills(text, low))),
    "array_to_string(skills, '|')",
)


@query(
    "map_job_type",
    """
    SELECT upload_id, rel_path, line, CASE replace(replace(lower(label), '-', ''), ' ', '') WHEN 'remote' THEN 'REMOTE'
        WHEN 'hybrid' THEN 'HYBRID' WHEN 'onsite' THEN 'ONSITE' ELSE 'UNKNOWN' END AS value
    FROM (SELECT upload_id, rel_path, cast(unnest(range(len(lines))) AS int) AS line, unnest(lines) AS label
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM resume_files) AS s) AS l""",
)
def _(t):
    lines = t["resume_files"].select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "label"))
    return lines.select(*_KEY, "line", X.map_job_type(F.col("label")).alias("value"))


@query(
    "contains_skill",
    " UNION ALL ".join(
        f"SELECT '{s}' AS skill, count(*) AS documents FROM resume_files WHERE {_has_term(s)}" for s in _TERMS
    ),
)
def _(t):
    texts = t["resume_files"].withColumn("low", folded(F.col("text")))
    found = texts.select(X.detect_skills(F.col("text"), F.col("low"), _TERMS).alias("skills"))
    return found.select(F.explode("skills").alias("skill")).groupBy("skill").agg(
        F.count(F.lit(1)).alias("documents")
    )


@query(
    "source_basename",
    "SELECT upload_id, rel_path, regexp_replace(rel_path, '^.*/', '') AS value FROM resume_files",
)
def _(t):
    return t["resume_files"].select(*_KEY, basename(F.col("rel_path")).alias("value"))


@query(
    "normalize_whitespace",
    f"SELECT upload_id, rel_path, {_squeezed('text')} AS value FROM resume_files",
)
def _(t):
    return t["resume_files"].select(*_KEY, collapse_whitespace(F.col("text")).alias("value"))


@query("normalize_text", "SELECT upload_id, rel_path, text AS value FROM normalized")
def _(t):
    return t["resume_files"].select(*_KEY, normalize_text(F.col("text")).alias("value"))


@query(
    "filter_media_type",
    f"""
    SELECT upload_id, rel_path, media_type FROM resume_files
    WHERE media_type IN ('{PDF_TYPE}', '{DOCX_TYPE}')""",
)
def _(t):
    return D.filter_media_type(t["resume_files"]).select(*_KEY, "media_type")


@query(
    "check_text_limit",
    "SELECT upload_id, rel_path, length(text) AS n_chars FROM resume_files WHERE length(text) > 12000",
)
def _(t):
    files = t["resume_files"].filter(D.exceeds_limit(F.col("text"), PARSING))
    return files.select(*_KEY, F.length("text").cast("long").alias("n_chars"))


@query(
    "check_empty_document",
    r"""
    SELECT upload_id, rel_path FROM normalized WHERE NOT regexp_matches(text, '\S')""",
)
def _(t):
    return t["resume_files"].filter(is_blank(normalize_text(F.col("text")))).select(*_KEY)


@query("classify_document", "SELECT upload_id, rel_path, error_code, error_message FROM classified")
def _(t):
    read = D.classify_document(t["resume_files"], PARSING)
    return read.select(*_KEY, "error_code", "error_message")


@query(
    "extract_candidates",
    r"""
    SELECT upload_id, rel_path, error, CASE WHEN error IS NULL THEN full_name END AS full_name,
        CASE WHEN error IS NULL THEN years END AS years_of_experience,
        CASE WHEN error IS NULL THEN location END AS preferred_location,
        CASE WHEN error IS NULL THEN job_type END AS preferred_job_type,
        CASE WHEN error IS NULL THEN array_to_string(skills, '|') END AS skills,
        CASE WHEN error IS NULL THEN regexp_replace(rel_path, '^.*/', '') END AS source_filename
    FROM (
        SELECT *, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S')
                THEN 'Cannot extract candidate from empty document: ' || rel_path
            WHEN full_name IS NULL THEN 'Candidate full name could not be extracted' END AS error
        FROM fields
    ) AS f""",
)
def _(t):
    drafts = extract_candidates(t["resume_files"].select(*_KEY, "text"))
    return drafts.withColumn("skills", _joined("skills")).drop("text")

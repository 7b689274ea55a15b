"""From text to candidate drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import extract as X
from talentgrid.functions.patterns import KNOWN_SKILLS
from talentgrid.functions.text import folded, is_blank

# The messages of a text no candidate can be read from.
EMPTY_TEXT = "Cannot extract candidate from empty document: "
NO_NAME = "Candidate full name could not be extracted"

DRAFT = (
    "full_name",
    "years_of_experience",
    "preferred_location",
    "preferred_job_type",
    "skills",
    "source_filename",
)


def extract_candidates(
    documents: DataFrame,
    skills: Sequence[str] = KNOWN_SKILLS,
    text: str = "text",
    path: str = "rel_path",
) -> DataFrame:
    """Add the draft columns and ``error``. Rows with an error have no draft.

    Costly values get a column of their own before anything refers to them twice, as an expression
    inside a condition is evaluated at each mention. Texts that have no name are not searched further.
    """
    raw, rest, low = F.col(text), F.col("_text"), F.col("_low")
    named = documents.withColumn("_low", folded(raw)).withColumn("full_name", X.full_name(raw, low))
    empty = raw.isNull() | is_blank(raw)
    error = F.when(empty, F.concat(F.lit(EMPTY_TEXT), F.col(path))).when(
        F.col("full_name").isNull(), NO_NAME
    )
    good = F.col("error").isNull()
    read = named.withColumn("error", error).withColumns(
        {"_text": F.when(good, raw), "_low": F.when(good, low), "full_name": F.when(good, F.col("full_name"))}
    )
    found = read.withColumns(
        {
            "_years": X.experience(rest, low),
            "_qualified_years": X.qualified_experience(rest, low),
            "_location": X.location_by_label(rest, low),
            "_place": X.location_by_phrase(rest, low),
            "_job": X.job_type_by_label(rest, low),
            "_job_line": X.job_type_by_line(rest, low),
            "_skills": X.detect_skills(rest, low, skills),
        }
    )
    drafts = found.withColumns(
        {
            "years_of_experience": F.greatest("_years", "_qualified_years"),
            "preferred_location": F.coalesce("_location", "_place"),
            "preferred_job_type": F.when(good, X.map_job_type(F.coalesce("_job", "_job_line"))),
            "skills": F.when(good, X.suppress_shadowed(F.col("_skills"))),
            "source_filename": F.when(good, X.source_filename(F.col(path))),
        }
    )
    return drafts.drop(
        "_text", "_low", "_years", "_qualified_years", "_location", "_place", "_job", "_job_line", "_skills"
    )

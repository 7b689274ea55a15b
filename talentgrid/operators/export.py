"""Exports of all matching candidates in a fixed order, as CSV lines or typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.csvcells import csv_line, header_line, join_skills
from talentgrid.operators.search import (
    RESPONSE,
    Criteria,
    filter_criteria,
    sort_ignoring_case,
    sort_order,
)


def export_rows(candidates: DataFrame) -> DataFrame:
    skills = sort_ignoring_case(F.coalesce("skills", F.array().cast("array<string>"))).alias("skills")
    return candidates.select(*[skills if c == "skills" else F.col(c) for c in RESPONSE])


def export_candidates(
    candidates: DataFrame,
    criteria: Criteria = Criteria(),
    sort_by: str = "fullName",
    direction: str = "asc",
) -> DataFrame:
    """All matches, globally sorted: a range shuffle split by (sort value, id), so ties spread too."""
    order = sort_order(sort_by, direction, strict=True)
    return export_rows(filter_criteria(candidates, criteria)).orderBy(*order)


def csv_rows(exported: DataFrame) -> DataFrame:
    cells = [join_skills(F.col(c)) if c == "skills" else F.col(c) for c in RESPONSE]
    return exported.select(csv_line(cells).alias("line"))


def csv_header(df: DataFrame) -> DataFrame:
    """The header as one row, made from an empty aggregate so it is there when nothing matches."""
    return df.limit(0).agg(F.count(F.lit(1)).alias("n")).select(F.lit(header_line()).alias("line"))


def typed_rows(exported: DataFrame) -> DataFrame:
    """Experience stays a number and may be null; other nulls become empty text."""

    def cell(name):
        if name == "skills":
            return join_skills(F.col(name)).alias(name)
        if name == "years_of_experience":
            return F.col(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return exported.select(*[cell(c) for c in RESPONSE])

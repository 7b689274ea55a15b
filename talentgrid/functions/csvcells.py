"""CSV cells that spreadsheets open safely."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The header, its order, the separator of skills and the byte order mark.
HEADER = (
    "candidateId",
    "uploadId",
    "fullName",
    "yearsOfExperience",
    "preferredLocation",
    "preferredJobType",
    "skills",
    "sourceFilename",
)
SKILL_SEPARATOR = " | "
BYTE_ORDER_MARK = "\ufeff"

_LEADING = r"^(?:[\s\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]])*+[=+\-@]"


def join_skills(skills: Column) -> Column:
    return F.array_join(skills, SKILL_SEPARATOR)


def protect_formula(value: Column) -> Column:
    return F.when(value.rlike(_LEADING), F.concat(F.lit("'"), value)).otherwise(value)


def csv_quote(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(cells: Iterable[Column]) -> Column:
    return F.concat_ws(",", *[csv_quote(protect_formula(c.cast("string"))) for c in cells])


def header_line() -> str:
    return ",".join(f'"{name}"' for name in HEADER)

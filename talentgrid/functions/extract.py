"""Rule-based résumé fields as native columns.

A regular expression over a long text is costly, so each one runs only where a plain substring that
every match must contain is there. ``low`` is the folded text, computed once by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions import patterns as P
from talentgrid.functions.text import basename, collapse_whitespace, folded

_LINE_START = r"(?<![^\r\n])[\x00-\x20&&[^\r\n]]*+"
_LINE_END = r"[\x00-\x20&&[^\r\n]]*+(?![^\r\n])"
_GAP = r"[ \t\x0B\f]"


def _mentions(text: Column, low: Column | None, words: Sequence[str]) -> Column:
    low = folded(text) if low is None else low
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _first(text: Column, pattern: str, low: Column | None, *words: str) -> Column:
    found = F.when(_mentions(text, low, words), F.regexp_extract(text, pattern, 1))
    return F.nullif(found, F.lit(""))


def name_by_label(text: Column, low: Column | None = None) -> Column:
    return collapse_whitespace(_first(text, P.NAME_LABEL, low, "name"))


def _name_line_pattern() -> str:
    """One pattern for "a whole line that can be a person's name"; stops at the first such line."""
    in_word = r"[\p{L}'’.-]"
    titles = "|".join(P.JOB_TITLE_WORDS)
    word = rf"(?!(?i:{titles})(?!{in_word}))\p{{L}}{in_word}*+"
    headings = "|".join(h.replace(" ", _GAP + "++") for h in P.SECTION_HEADINGS)
    not_heading = rf"(?!(?i:{headings}){_LINE_END})"
    length = rf"(?=(?:[^\x00-\x20]|{_GAP}++(?=[^\x00-\x20])){{3,100}}+{_LINE_END})"
    words = rf"({word}(?:{_GAP}++{word}){{1,4}})"
    return rf"{_LINE_START}(?=\p{{L}})(?!(?i:www\.)){length}{not_heading}{words}{_LINE_END}"


NAME_LINE = _name_line_pattern()


def name_by_line(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, NAME_LINE, 1), F.lit(""))


def full_name(text: Column, low: Column | None = None) -> Column:
    return F.coalesce(name_by_label(text, low), name_by_line(text))


def _ascii_bounds(pattern: str) -> str:
    """Spell out the two word bounds of a pattern for ASCII words, as Java reads them from release 19."""
    head, body, tail = pattern.split(r"\b")
    return f"{head}(?<![0-9A-Za-z_]){body}(?![0-9A-Za-z_]){tail}"


def _highest(text: Column, pattern: str, low: Column | None) -> Column:
    pattern = _ascii_bounds(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).cast("array<int>")
    return F.when(_mentions(text, low, ["experience"]), F.array_max(found))


def experience(text: Column, low: Column | None = None) -> Column:
    return _highest(text, P.EXPERIENCE, low)


def qualified_experience(text: Column, low: Column | None = None) -> Column:
    return _highest(text, P.QUALIFIED_EXPERIENCE, low)


def years_of_experience(text: Column, low: Column | None = None) -> Column:
    return F.greatest(experience(text, low), qualified_experience(text, low))


def location_by_label(text: Column, low: Column | None = None) -> Column:
    return F.nullif(collapse_whitespace(_first(text, P.LOCATION, low, "location")), F.lit(""))


def location_by_phrase(text: Column, low: Column | None = None) -> Column:
    found = _first(text, P.BASED_IN, low, "based", "located")
    return F.nullif(collapse_whitespace(found), F.lit(""))


def preferred_location(text: Column, low: Column | None = None) -> Column:
    return F.coalesce(location_by_label(text, low), location_by_phrase(text, low))


def job_type_by_label(text: Column, low: Column | None = None) -> Column:
    return _first(text, P.JOB_TYPE, low, "type", "arrangement", "preference")


_JOB_TYPE_LINE = _LINE_START + "((?i:" + "|".join(P.JOB_TYPE_LINES) + "))" + _LINE_END


def job_type_by_line(text: Column, low: Column | None = None) -> Column:
    return _first(text, _JOB_TYPE_LINE, low, "remote", "hybrid", "site")


def map_job_type(value: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for k in ("REMOTE", "HYBRID", "ONSITE") for x in (k.lower(), k)])
    return F.coalesce(kinds[F.translate(F.lower(value), "- ", "")], F.lit("UNKNOWN"))


def preferred_job_type(text: Column, low: Column | None = None) -> Column:
    return map_job_type(F.coalesce(job_type_by_label(text, low), job_type_by_line(text, low)))


def contains_skill(text: Column, skill: str, low: Column | None = None) -> Column:
    """``skill`` stands in the text as a whole term: no letter or digit touches it.

    Plain terms are searched in the folded text. The pattern starts with the term itself and looks
    back past it, which lets the regex engine skip ahead to the term's next occurrence.
    """
    if skill.isascii():
        low = folded(text) if low is None else low
        term = _quoted(skill.lower())
        pattern = term + r"(?![\p{L}\p{N}])(?<![\p{L}\p{N}]" + term + ")"
        return F.contains(low, F.lit(skill.lower())) & low.rlike(pattern)
    return text.rlike(r"(?iu)(?<![\p{L}\p{N}])" + _quoted(skill) + r"(?![\p{L}\p{N}])")


def _quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def detect_skills(
    text: Column, low: Column | None = None, skills: Sequence[str] = P.KNOWN_SKILLS
) -> Column:
    found = [F.when(contains_skill(text, s, low), F.lit(s)) for s in skills]
    return F.array_compact(F.array(*found))


def suppress_shadowed(skills: Column, longer: str = "Spring Boot", shorter: str = "Spring") -> Column:
    return F.when(F.array_contains(skills, longer), F.array_remove(skills, shorter)).otherwise(skills)


def source_filename(path: Column) -> Column:
    return basename(path)



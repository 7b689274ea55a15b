"""Text columns: trimming, blanks, normalisation, names of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL_AND_SPACE = "".join(map(chr, range(0x21)))
NOT_BLANK = r"[^\s\x1C-\x1F\p{Z}]|[\u00A0\u2007\u202F]"


def trimmed(value: Column) -> Column:
    """Strip every character up to U+0020, not only the space that ``trim`` strips."""
    return F.btrim(value, F.lit(CONTROL_AND_SPACE))


def trim_argument(text: str | None) -> str | None:
    """The same trimming for a plain argument; None when nothing but whitespace is there."""
    text = text or ""
    visible = any(not c.isspace() or c in "\x85\u00a0\u2007\u202f" for c in text)
    return text.strip(CONTROL_AND_SPACE) if visible else None


def is_blank(value: Column) -> Column:
    """True when no character is left that counts as text; null stays null."""
    return ~value.rlike(NOT_BLANK)


def blank_to_null(value: Column) -> Column:
    return F.when(value.rlike(NOT_BLANK), value)


def collapse_whitespace(value: Column) -> Column:
    return F.regexp_replace(trimmed(value), r"\s+", " ")


def normalize_text(value: Column) -> Column:
    """Drop NUL, squeeze blanks to one space, keep at most one empty line, trim.

    The blank pattern skips single spaces, which stay as they are, so it rarely has to rebuild a text.
    """
    text = F.replace(value, F.lit("\0"), F.lit(""))
    text = F.regexp_replace(text, r"[\t\x0B\f\r][\t\x0B\f\r ]*| [\t\x0B\f\r ]+", " ")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def basename(path: Column) -> Column:
    """Last component of a path; null when there is none."""
    return F.nullif(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1), F.lit(""))


def folded(value: Column) -> Column:
    """Lower case, with the letters that equal an ASCII letter only when case is ignored."""
    pairs = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))
    return F.lower(reduce(lambda text, p: F.replace(text, F.lit(p[0]), F.lit(p[1])), pairs, value))


def clean_message(value: Column, error_class: Column | str = "RuntimeException", limit: int = 1000) -> Column:
    """One-line message of at most ``limit`` characters; a blank one becomes the error's class name."""
    name = F.lit(error_class) if isinstance(error_class, str) else error_class
    line = trimmed(F.regexp_replace(value, r"[\r\n]+", " "))
    return (
        F.when(value.isNull(), F.lit("Unknown processing failure"))
        .when(is_blank(value), name)
        .otherwise(F.substring(line, 1, limit))
    )

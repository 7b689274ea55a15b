"""Whole rows kept beside the columns that an operator works on, so that no name of an input column can clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boxed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): `row` holds all columns but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the boxed table again, with the text as it now is."""
    return rows.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])

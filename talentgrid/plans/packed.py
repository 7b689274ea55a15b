"""Files made of the supplied documents: the first bytes of their type, then the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headed_files(documents: DataFrame) -> DataFrame:
    """(upload_id, rel_path, content): French as a ZIP with a Word part, Spanish as plain text, others as PDF."""
    text = F.encode("text", "UTF-8")
    word = F.concat(F.lit(bytearray(b"PK\x03\x04" + bytes(26) + b"word/document.xml")), text)
    pdf = F.concat(F.lit(bytearray(b"%PDF-1.4\n")), text)
    return documents.select(
        F.concat(F.lit("d"), "doc_id").alias("upload_id"),
        F.concat("lang", F.lit("/doc"), "doc_id", F.lit(".pdf")).alias("rel_path"),
        F.when(F.col("lang") == "fr", word).when(F.col("lang") == "es", text).otherwise(pdf).alias("content"),
    )

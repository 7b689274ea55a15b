"""From document rows to clean text or a failure code.

A document has upload_id, rel_path, media_type, file_exists, text (raw; null when decoding failed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.text import basename, is_blank, normalize_text
from talentgrid.settings import DOCX_TYPE, PDF_TYPE, ParsingLimits

# The failure codes and the start of each message.
FILE_NOT_FOUND = "FILE_NOT_FOUND"
UNSUPPORTED_MEDIA_TYPE = "UNSUPPORTED_MEDIA_TYPE"
TEXT_LIMIT_EXCEEDED = "TEXT_LIMIT_EXCEEDED"
PARSE_FAILED = "PARSE_FAILED"
EMPTY_DOCUMENT = "EMPTY_DOCUMENT"
MESSAGES = {
    FILE_NOT_FOUND: "Document does not exist: ",
    TEXT_LIMIT_EXCEEDED: "Extracted text exceeds maximum allowed length: ",
    PARSE_FAILED: "Failed to parse document: ",
    EMPTY_DOCUMENT: "Document does not contain extractable text: ",
}


ALLOWED_TYPES = (PDF_TYPE, DOCX_TYPE)


def is_allowed_type(media_type: Column) -> Column:
    return F.coalesce(media_type.isin(*ALLOWED_TYPES), F.lit(False))


def filter_media_type(documents: DataFrame) -> DataFrame:
    return documents.filter(is_allowed_type(F.col("media_type")))


def exceeds_limit(text: Column, limits: ParsingLimits) -> Column:
    return F.length(text) > limits.max_text_length


def document_error(clean: Column, limits: ParsingLimits) -> Column:
    """Failure code of a document, or null; ``clean`` is its normalised text."""
    return (
        F.when(~F.col("file_exists"), FILE_NOT_FOUND)
        .when(~is_allowed_type(F.col("media_type")), UNSUPPORTED_MEDIA_TYPE)
        .when(exceeds_limit(F.col("text"), limits), TEXT_LIMIT_EXCEEDED)
        .when(F.col("text").isNull(), PARSE_FAILED)
        .when(is_blank(clean), EMPTY_DOCUMENT)
    )


def error_message(code: Column, path: Column, media_type: Column) -> Column:
    name = basename(path)
    message = F.when(
        code == UNSUPPORTED_MEDIA_TYPE,
        F.concat(
            F.lit("Unsupported actual document type '"), media_type, F.lit("' for file: "), name
        ),
    )
    for key, start in MESSAGES.items():
        message = message.when(code == key, F.concat(F.lit(start), name))
    return message


def classify_document(documents: DataFrame, limits: ParsingLimits = ParsingLimits()) -> DataFrame:
    """Replace ``text`` by the normalised text and add error_code and error_message."""
    clean = documents.withColumn("_clean", normalize_text(F.col("text")))
    given = F.col("error_code") if "error_code" in documents.columns else F.lit(None)
    code = F.coalesce(given, document_error(F.col("_clean"), limits))
    coded = clean.withColumn("error_code", code)
    message = error_message(F.col("error_code"), F.col("rel_path"), F.col("media_type"))
    return (
        coded.withColumn("error_message", message)
        .withColumn("text", F.when(F.col("error_code").isNull(), F.col("_clean")))
        .drop("_clean")
    )


def split_documents(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    failed = F.col("error_code").isNotNull()
    return classified.filter(~failed), classified.filter(failed)

"""Document bytes to text. Decoders per media type are plugged in; DOCX is built in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.paths import is_cv_name, normalize_path
from talentgrid.operators.documents import ALLOWED_TYPES, PARSE_FAILED, TEXT_LIMIT_EXCEEDED, UNSUPPORTED_MEDIA_TYPE
from talentgrid.operators.joins import join_per_key
from talentgrid.schemas import DOCUMENT
from talentgrid.settings import DOCX_TYPE, PDF_TYPE

Decoder = Callable[[bytes], str]

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {_WORD + "t": None, _WORD + "tab": "\t", _WORD + "br": "\n", _WORD + "cr": "\n"}


def media_type(content: Column) -> Column:
    """Type by content, not by name: a PDF mark, or a ZIP that holds a Word document."""
    zipped = F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04"))
    word = F.contains(content, F.lit(bytearray(b"word/document.xml")))
    return (
        F.when(F.substring(content, 1, 5) == F.lit(bytearray(b"%PDF-")), PDF_TYPE)
        .when(zipped & word, DOCX_TYPE)
        .when(zipped, "application/zip")
        .when(F.length(content) == 0, "application/octet-stream")
        .otherwise("text/plain")
    )


def detect_media_type(files: DataFrame) -> DataFrame:
    return files.withColumn("media_type", media_type(F.col("content")))


class TextTooLong(ValueError):
    """A document's text is far beyond any text limit, so it is not read whole."""


#: Bytes of a document's body that are read at most; mark-up takes several bytes for each character of text.
MAX_BODY_BYTES = 64 << 20


def decode_docx(content: bytes) -> str:
    """Paragraphs of the document body, one per line; table cells end with a tab."""
    with zipfile.ZipFile(io.BytesIO(content)) as package, package.open("word/document.xml") as part:
        body = part.read(MAX_BODY_BYTES + 1)
    if len(body) > MAX_BODY_BYTES:
        raise TextTooLong
    root = ElementTree.fromstring(body)
    lines = []
    for paragraph in root.iter(_WORD + "p"):
        parts = (
            node.text or "" if _MARKS[node.tag] is None else _MARKS[node.tag]
            for node in paragraph.iter()
            if node.tag in _MARKS
        )
        lines.append("".join(parts))
    return "\n".join(lines)


#: Decoders at hand; a PDF decoder is the caller's.
DECODERS: Mapping[str, Decoder] = {DOCX_TYPE: decode_docx}


def extract_document_text(files: DataFrame, decoders: Mapping[str, Decoder], detect: bool = True) -> DataFrame:
    """(upload_id, rel_path, content) to (upload_id, rel_path, media_type, text, error_code).

    ``decoders`` has one for each allowed type, as DECODERS with one for PDF; without it the plan is refused. A
    decoder's exception becomes that row's error_code, so one bad file fails nothing else; a type that is not
    allowed is UNSUPPORTED_MEDIA_TYPE. The bytes do not leave this step.
    """
    missing = sorted(set(ALLOWED_TYPES) - set(decoders))
    if missing:
        raise ValueError(f"no decoder for allowed types: {', '.join(missing)}")
    typed = detect_media_type(files) if detect else files

    def decode(kind: str, content: bytes) -> tuple[str | None, str | None]:
        if kind not in ALLOWED_TYPES:
            return None, UNSUPPORTED_MEDIA_TYPE
        try:
            return decoders[kind](bytes(content)), None
        except TextTooLong:
            return None, TEXT_LIMIT_EXCEEDED
        except Exception:
            return None, PARSE_FAILED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [decode(k, c) for k, c in zip(batch["media_type"], batch["content"])]
            yield pd.DataFrame(
                {
                    "upload_id": batch["upload_id"],
                    "rel_path": batch["rel_path"],
                    "media_type": batch["media_type"],
                    "text": [text for text, _ in results],
                    "error_code": [code for _, code in results],
                }
            )

    return typed.select("upload_id", "rel_path", "media_type", "content").mapInPandas(run, DOCUMENT)


def files_of_manifest(manifest: DataFrame, accepted: DataFrame) -> DataFrame:
    """CV files of accepted archives, with their bytes."""
    files = manifest.filter(~F.col("is_directory") & F.col("content").isNotNull())
    good = accepted.filter("accepted").select("upload_id")
    kept = join_per_key(files, good, ["upload_id"], "left_semi", ["entry_no"])
    return kept.select("upload_id", normalize_path(F.col("entry_name")).alias("rel_path"), "content")


def documents_of_archives(manifest: DataFrame, verdicts: DataFrame, decoders: Mapping[str, Decoder]) -> DataFrame:
    """Documents of accepted archives, as the ingest operators take them.

    The verdict and this both read the manifest with its bytes; write it to a table first, so that the
    archives are unpacked once.
    """
    texts = extract_document_text(files_of_manifest(manifest, verdicts), decoders)
    return texts.withColumn("file_exists", F.lit(True))


def list_cv_files(spark: SparkSession, folder: str) -> DataFrame:
    """CV files under ``folder/<upload_id>/…`` with their bytes.

    Many small files are packed into read tasks by ``spark.sql.files.maxPartitionBytes``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    inner = F.substring_index(F.col("path"), root + "/", -1)
    listed = files.select(
        F.substring_index(inner, "/", 1).alias("upload_id"),
        F.regexp_replace(inner, "^[^/]*/", "").alias("rel_path"),
        F.col("length").alias("size_bytes"),
        "content",
    )
    return listed.filter(is_cv_name(F.col("rel_path")))

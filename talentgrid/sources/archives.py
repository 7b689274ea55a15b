"""ZIP archives to a manifest: one row per entry, many archives per job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.operators.archive import CANNOT_EXTRACT, CORRUPT
from talentgrid.schemas import MANIFEST
from talentgrid.settings import ArchiveLimits

BATCH_BYTES = 32 << 20
BATCH_ROWS = 1000
_HEADERS = (b"PK\x03\x04", b"PK\x05\x06")
_END, _END_REACH = b"PK\x05\x06", (1 << 16) + 22


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=MANIFEST.names)
    return frame.astype({"entry_no": "Int32", "size_bytes": "Int64"})


def _entries(upload_id: str, blob: bytes, limits: ArchiveLimits) -> Iterator[tuple]:
    """Entries in archive order. Bytes are read only up to where the archive is rejected anyway, so an archive
    that unpacks to far more than its limits is never unpacked whole. Bytes without a ZIP header hold no entry."""
    number, total, full = 0, 0, False
    if not blob.startswith(_HEADERS):
        return
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as archive:
            for info in sorted(archive.infolist(), key=lambda i: i.header_offset):
                number += 1
                name = info.orig_filename
                if name.endswith("/"):
                    yield upload_id, number, name, True, 0, None, None
                elif full or number > limits.max_entries:
                    # Rejected already; the listing goes on with names and declared sizes.
                    yield upload_id, number, name, False, info.file_size, None, None
                else:
                    room = max(0, limits.max_total_bytes - total)
                    most = min(limits.max_single_bytes, room)
                    with archive.open(info) as entry:
                        data = entry.read(most + 1)
                    if len(data) > most:
                        size = max(info.file_size, len(data))
                        yield upload_id, number, name, False, size, None, None
                        full = True
                        continue
                    total += len(data)
                    yield upload_id, number, name, False, len(data), data, None
    except EOFError:
        yield upload_id, None, None, None, None, None, CANNOT_EXTRACT
    except zipfile.BadZipFile:
        # Without its end record the archive was cut; with it, an entry is broken.
        cut = _END not in blob[-_END_REACH:]
        yield upload_id, None, None, None, None, None, CANNOT_EXTRACT if cut else CORRUPT
    except (ValueError, NotImplementedError, RuntimeError, OSError, zipfile.zlib.error):
        yield upload_id, None, None, None, None, None, CORRUPT


def expand_archives(archives: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(upload_id, content) to manifest rows; an unreadable archive becomes a row with archive_error.

    Entries leave in batches of bounded bytes, so a task holds one input batch and one output batch.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for upload_id, blob in zip(batch["upload_id"], batch["content"]):
                for row in _entries(upload_id, blob, limits):
                    rows.append(row)
                    size += len(row[5] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _frame(rows)
                        rows, size = [], 0
        if rows:
            yield _frame(rows)

    return archives.select("upload_id", "content").mapInPandas(expand, MANIFEST)


def default_upload_id(path: Column, folder: str) -> Column:
    """Path below ``folder`` without the extension, so archives of one name stay apart."""
    root = folder.rstrip("/").removeprefix("file:")
    return F.regexp_replace(F.substring_index(path, root + "/", -1), r"\.[zZ][iI][pP]$", "")


def archive_manifest(
    spark: SparkSession, folder: str, limits: ArchiveLimits = ArchiveLimits()
) -> DataFrame:
    """Manifest of every ``*.zip`` under ``folder``. It holds the files' bytes; write it to a table when
    more than one step reads it."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[zZ][iI][pP]")
        .load(folder)
    )
    named = files.select(default_upload_id(F.col("path"), folder).alias("upload_id"), "content")
    return expand_archives(named, limits)

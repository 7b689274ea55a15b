"""Queries over document files made of the supplied documents."""

from __future__ import annotations

from talentgrid.plans.catalog import query
from talentgrid.plans.packed import headed_files
from talentgrid.settings import DOCX_TYPE, PDF_TYPE
from talentgrid.sources.documents import detect_media_type

_DOC = "'d' || cast(doc_id AS varchar)"


@query(
    "detect_media_type",
    f"""
    SELECT {_DOC} AS upload_id, CASE lang WHEN 'fr' THEN '{DOCX_TYPE}' WHEN 'es' THEN 'text/plain'
        ELSE '{PDF_TYPE}' END AS media_type
    FROM documents""",
)
def _(t):
    return detect_media_type(headed_files(t["documents"])).select("upload_id", "media_type")



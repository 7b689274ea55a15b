"""All registered queries. Importing the query modules fills the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators.candidates import extract_candidates
from talentgrid.operators.ingest import candidate_id
from talentgrid.operators.search import Criteria, search_candidates
from talentgrid.plans import (  # noqa: F401
    archive_queries,
    extraction_queries,
    ingest_queries,
    operations_queries,
    search_queries,
    source_queries,
    stream_queries,
)
from talentgrid.plans.catalog import QUERIES, oracles
from talentgrid.plans.fixtures import Inputs

__all__ = ["flagship", "oracles", "queries"]


def queries():
    return dict(QUERIES)


def flagship(spark, folder):
    drafts = extract_candidates(Inputs(spark, folder)["resume_files"]).filter("error is null")
    named = drafts.withColumn("id", candidate_id(F.col("upload_id"), F.col("rel_path")))
    return search_candidates(named, Criteria(skill="java"), sort_by="yearsOfExperience", direction="desc")

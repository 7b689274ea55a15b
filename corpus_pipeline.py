"""From raw documents to token ids, stage by stage.

Every stage works on all rows that the one before kept. Null and empty texts go in the first stage, as they have no
language, unless no row at all tells its `lang`; an empty table passes through. Columns other than doc_id and text are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm.bpe import encode
from talentgrid.llm.decontaminate import without_leaks
from talentgrid.llm.langid import identified
from talentgrid.llm.queries import vocabulary
from talentgrid.llm.setjoin import one_of_each
from talentgrid.llm.staging import staged
from talentgrid.llm.substrings import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told by their letters."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that shares 80 % of its five-word shingles."""
    return one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of 50 words or more that an earlier document holds."""
    return remove_repeats(docs, width=50)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers, names or units."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of what is left."""
    return encode(docs, vocabulary()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("bpe", token_ids),
]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

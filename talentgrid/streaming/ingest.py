"""Streams: documents to stored candidates and failures, and progress, each file once.

A stream remembers the (upload, file) pairs it has seen for a while in keyed state, so a file that is delivered again is
dropped before its text is read, without a look at what is stored. The state's clock is the time of the batch, so no file
is ever too late for it; a pair is forgotten `remember` after it came.

What the state cannot know (a batch that ran half before a crash, or a new checkpoint that reads every file again) is
found in the stored tables: they are partitioned by the day on which a file arrived, and a batch is compared with the days
that its own files came on, give or take `remember`. Older rows are not read, however large the tables are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentgrid.operators.ingest import (
    build_failures,
    cv_files,
    insert_new_candidates,
    process_documents,
)
from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE, with_day
from talentgrid.settings import ParsingLimits
from talentgrid.sources.tables import DAY, append_days, new_failures, stored_days

REMEMBER = dt.timedelta(days=2)
#: Time of arrival of a document, and the time of the batch that state goes by.
ARRIVED, _SEEN = "arrived_at", "_seen_at"


def each_once(documents: DataFrame, remember: dt.timedelta = REMEMBER) -> DataFrame:
    """Streaming documents without those whose (upload, file) came within `remember`."""
    seen = documents.withColumn(_SEEN, F.current_timestamp())
    kept = seen.withWatermark(_SEEN, f"{int(remember.total_seconds())} seconds")
    return kept.dropDuplicatesWithinWatermark(["upload_id", "rel_path"]).drop(_SEEN)


def days_of(rows: DataFrame, remember: dt.timedelta) -> tuple[dt.date, dt.date] | None:
    """The days that stored copies of `rows` may lie in; none without rows."""
    first, last = rows.agg(F.min(DAY), F.max(DAY)).first()
    around = dt.timedelta(days=-(-remember // dt.timedelta(days=1)))
    return None if first is None else (first - around, last + around)


def new_rows(
    results: DataFrame, candidates: DataFrame, failures: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Candidate and failure rows of `results` that are not in the stored `candidates` and `failures` yet."""
    drafts = results.filter(F.col("error_code").isNull()).withColumn("file_no", F.col("rel_path"))
    fresh = insert_new_candidates(drafts, candidates).withColumn("created_at", now)
    lost = new_failures(failures, build_failures(results, now, DAY))
    return fresh.select(*CANDIDATE.names, DAY), lost.select(*PROCESSING_FAILURE.names, DAY)


def merge_batch(
    documents: DataFrame,
    candidate_folder: str,
    failure_folder: str,
    parsing: ParsingLimits = ParsingLimits(),
    now: Column | None = None,
    remember: dt.timedelta = REMEMBER,
) -> None:
    """Write a batch's new candidates and failures under the days of their arrival. Rows that are stored on the
    days around are skipped, so a batch that runs again changes nothing."""
    spark = documents.sparkSession
    now = F.current_timestamp() if now is None else now
    dated = cv_files(documents).withColumn(DAY, F.to_date(ARRIVED))
    results = process_documents(dated, parsing).persist()
    try:
        days = days_of(results, remember)
        if days is None:
            return
        candidates = stored_days(spark, candidate_folder, with_day(CANDIDATE), *days)
        failures = stored_days(spark, failure_folder, with_day(PROCESSING_FAILURE), *days)
        people, lost = new_rows(results, candidates, failures, now)
        append_days(people, candidate_folder, ["upload_id", "source_filename"])
        append_days(lost, failure_folder, ["upload_id", "filename"])
    finally:
        results.unpersist()


def _started(documents: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest(
    documents: DataFrame,
    candidate_folder: str,
    failure_folder: str,
    checkpoint: str,
    parsing: ParsingLimits = ParsingLimits(),
    available_now: bool = True,
    remember: dt.timedelta = REMEMBER,
) -> StreamingQuery:
    """Streaming documents (with `arrived_at`) into the candidate and failure tables, each file once.

    Files of one name in an upload make one candidate: the first batch that has one, and there the least path.
    """

    def write(batch: DataFrame, _: int) -> None:
        merge_batch(batch, candidate_folder, failure_folder, parsing, remember=remember)

    return _started(each_once(documents, remember), write, checkpoint, available_now)


def stream_progress(documents: DataFrame, parsing: ParsingLimits = ParsingLimits()) -> DataFrame:
    """Processed and failed files per upload so far; write it in update mode."""
    failed = F.col("error_code").isNotNull()
    return process_documents(cv_files(documents), parsing).groupBy("upload_id").agg(
        F.count_if(~failed).alias("processed_files"), F.count_if(failed).alias("failed_files")
    )


def store_progress(
    documents: DataFrame,
    folder: str,
    checkpoint: str,
    parsing: ParsingLimits = ParsingLimits(),
    available_now: bool = True,
    remember: dt.timedelta = REMEMBER,
) -> StreamingQuery:
    """Counts of each batch under folder/run=…/batch=…, to be summed by `stored_progress`.

    A batch that runs again overwrites its own folder with the same rows. A run is a checkpoint: one that starts anew
    reads all files again, and counts for itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        counts = stream_progress(batch, parsing).withColumn("counted_at", F.current_timestamp())
        counts.write.mode("overwrite").parquet(f"{folder}/run={run}/batch={number}")

    return _started(each_once(documents, remember), write, checkpoint, available_now)


def stored_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(upload_id, processed_files, failed_files) of the run that counted last."""
    counts = spark.read.parquet(folder)
    last = counts.groupBy("run").agg(F.max("counted_at").alias("at"))
    last = last.orderBy(F.desc("at"), "run").limit(1).select("run")
    summed = counts.join(last, "run", "left_semi").groupBy("upload_id")
    return summed.agg(*[F.sum(c).alias(c) for c in ("processed_files", "failed_files")])

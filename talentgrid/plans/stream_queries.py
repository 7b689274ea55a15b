"""Queries that run the streams over drops of the supplied documents.

Files come in three drops. The last one repeats the second under a later time of arrival. A stream is stopped and started
after each drop, and at last started with a new checkpoint, which reads every file again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentgrid.plans.catalog import oracle_step, query
from talentgrid.plans.extraction_queries import PARSING
from talentgrid.plans.fixtures import Inputs
from talentgrid.session import staging_folder
from talentgrid.streaming import ingest as S

DROPS = 3

oracle_step("delivered", f"SELECT *, ascii(substr(rel_path, 2, 1)) % {DROPS} AS drop_no FROM results")


def _drops(t: Inputs) -> list[DataFrame]:
    number = F.ascii(F.substring("rel_path", 2, 1)) % DROPS
    arrived = F.lit("2024-03-01 08:00:00").cast("timestamp") + F.make_dt_interval(days=F.col("drop_no"))
    files = t["resume_files"].withColumn("drop_no", number).withColumn(S.ARRIVED, arrived)
    drops = [files.filter(F.col("drop_no") == k).drop("drop_no") for k in range(DROPS)]
    again = drops[1].withColumn(S.ARRIVED, F.col(S.ARRIVED) + F.make_dt_interval(hours=F.lit(30)))
    return [*drops[:-1], drops[-1].unionByName(again)]


def _streamed(t: Inputs, start: Callable[[DataFrame, str, str], StreamingQuery]) -> str:
    """The folder of the stream's results, after every drop, restart and replay."""
    folder = f"{staging_folder(t.spark)}/stream-{uuid.uuid4().hex}"

    def run(checkpoint: str, schema) -> None:
        stream = t.spark.readStream.schema(schema).parquet(f"{folder}/in")
        running = start(stream, f"{folder}/out", f"{folder}/{checkpoint}")
        running.awaitTermination()
        if running.exception():
            raise running.exception()

    for drop in _drops(t):
        drop.write.mode("append").parquet(f"{folder}/in")
        run("checkpoint", drop.schema)
    run("replay", drop.schema)
    return f"{folder}/out"


@query(
    "stream_ingest",
    """
    SELECT 'candidate' AS kind, upload_id, filename AS name, full_name AS detail FROM (
        SELECT *, row_number() OVER (PARTITION BY upload_id, filename ORDER BY drop_no, rel_path) AS nth
        FROM delivered WHERE error_code IS NULL) AS d WHERE nth = 1
    UNION ALL SELECT 'failure', upload_id, sha256(upload_id || '/' || rel_path), error_code
        FROM delivered WHERE error_code IS NOT NULL""",
)
def _(t):
    def start(stream, out, checkpoint):
        return S.stream_ingest(stream, f"{out}/candidate", f"{out}/failure", checkpoint, PARSING)

    out = _streamed(t, start)
    people = t.spark.read.parquet(f"{out}/candidate").select(
        F.lit("candidate").alias("kind"), "upload_id", F.col("source_filename").alias("name"), F.col("full_name").alias("detail")
    )
    failures = t.spark.read.parquet(f"{out}/failure")
    return people.unionAll(failures.select(F.lit("failure"), "upload_id", "id", "error_code"))


@query(
    "stream_progress",
    """
    SELECT upload_id, count(*) FILTER (WHERE error_code IS NULL) AS processed_files,
        count(*) FILTER (WHERE error_code IS NOT NULL) AS failed_files
    FROM results GROUP BY upload_id""",
)
def _(t):
    return S.stored_progress(t.spark, _streamed(t, lambda s, out, checkpoint: S.store_progress(s, out, checkpoint, PARSING)))

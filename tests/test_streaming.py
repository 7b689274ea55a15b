import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE, with_day
from talentgrid.settings import PDF_TYPE
from talentgrid.sources.tables import DAY, stored_days
from talentgrid.streaming import ingest
from tests.conftest import plan_of

DOC = "upload_id string, rel_path string, media_type string, file_exists boolean, text string, arrived_at timestamp"
START = dt.datetime(2024, 3, 1, 9, tzinfo=dt.timezone.utc)


def row(upload, path, text="Ann Lee\nJava", day=0):
    return upload, path, PDF_TYPE, True, text, START + dt.timedelta(days=day)


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{folder}/in/{name}")


def read(spark, folder):
    return spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def run(spark, folder, checkpoint, **options):
    finish(ingest.stream_ingest(read(spark, folder), folder + "/candidate", folder + "/failure", f"{folder}/{checkpoint}", **options))


def stored(spark, folder):
    people = spark.read.parquet(folder + "/candidate")
    failures = spark.read.parquet(folder + "/failure")
    return (
        sorted((r.upload_id, r.source_filename, r.full_name) for r in people.collect()),
        sorted((r.upload_id, r.filename, r.error_code) for r in failures.collect()),
    )


def test_ingest_survives_restart_and_replay(spark, folder):
    drop(spark, folder, "d1", [row("u1", "a.pdf"), row("u1", "b/a.pdf", "Bob Ray"), row("u1", "c.pdf", "1")])
    run(spark, folder, "cp")
    people = [("u1", "a.pdf", "Ann Lee")]
    failures = [("u1", "c.pdf", "CANDIDATE_EXTRACTION_FAILED")]
    assert stored(spark, folder) == (people, failures)

    # Restart: only the new drop is read. It repeats a stored file, and a stored name on a new path.
    drop(spark, folder, "d2", [row("u1", "a.pdf", "Changed Name", 1), row("u1", "x/a.pdf", "Other Name", 1), row("u2", "a.pdf", "Cy Fox", 1)])
    run(spark, folder, "cp")
    people.append(("u2", "a.pdf", "Cy Fox"))
    assert stored(spark, folder) == (people, failures)

    # A lost checkpoint replays every drop: nothing is stored twice.
    run(spark, folder, "cp2")
    assert stored(spark, folder) == (people, failures)


def test_state_forgets_after_its_time(spark, folder):
    """State alone, without stored rows: a file that comes again soon is dropped, and counts again when it is forgotten."""

    def seen(remember):
        name = f"seen{remember.total_seconds():.0f}"
        query = ingest.each_once(read(spark, folder), remember).writeStream.format("memory").queryName(name).start()
        try:
            query.processAllAvailable()
            return spark.table(name).count()
        finally:
            query.stop()

    for i in range(3):
        drop(spark, folder, f"d{i}", [row("u1", "a.pdf", day=i), row("u1", f"{i}.pdf", day=i)])
    assert seen(dt.timedelta(days=2)) == 4  # a.pdf once, however late its time of arrival
    assert seen(dt.timedelta(0)) > 4


def test_half_written_batch_runs_again(spark, folder):
    people, failures = folder + "/candidate", folder + "/failure"
    batch = spark.createDataFrame([row("u1", "a.pdf"), row("u1", "c.pdf", "1"), row("u2", "c.pdf", "", 1)], DOC)
    ingest.merge_batch(batch, people, folder + "/lost")  # candidates reached their table, failures did not
    for _ in range(2):
        ingest.merge_batch(batch, people, failures)
    assert stored(spark, folder) == (
        [("u1", "a.pdf", "Ann Lee")],
        [("u1", "c.pdf", "CANDIDATE_EXTRACTION_FAILED"), ("u2", "c.pdf", "EMPTY_DOCUMENT")],
    )
    days = spark.read.parquet(failures).select("filename", DAY).distinct().orderBy(DAY).collect()
    assert [r[DAY] for r in days] == [dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    ingest.merge_batch(batch.limit(0), people, failures)


def test_a_batch_reads_stored_rows_of_its_days_once(spark, folder):
    old = [row("u1", f"{i}.pdf", f"Ann Lee {'x' * i}", day) for i, day in enumerate((0, 1, 40, 41, 200))]
    ingest.merge_batch(spark.createDataFrame(old, DOC), folder + "/candidate", folder + "/failure")
    batch = spark.createDataFrame([row("u1", "2.pdf", day=41), row("u1", "9.pdf", day=41)], DOC)
    dated = ingest.cv_files(batch).withColumn(DAY, F.to_date("arrived_at"))
    results = ingest.process_documents(dated)
    days = ingest.days_of(results, ingest.REMEMBER)
    assert days == (dt.date(2024, 4, 9), dt.date(2024, 4, 13))
    people = stored_days(spark, folder + "/candidate", with_day(CANDIDATE), *days)
    assert len(people.inputFiles()) >= 2 and people.count() == 2
    fresh, _ = ingest.new_rows(results, people, stored_days(spark, folder + "/failure", with_day(PROCESSING_FAILURE), *days), F.current_timestamp())
    plan = plan_of(fresh)
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(arrived_day" in plan
    assert [r.source_filename for r in fresh.collect()] == ["9.pdf"]


def test_progress_grows(spark, folder):
    drop(spark, folder, "d1", [row("u1", "a.pdf"), row("u1", "c.pdf", "1")])
    drop(spark, folder, "d2", [row("u1", "d.pdf"), row("u2", "a.pdf")])
    counts = ingest.stream_progress(read(spark, folder))
    query = counts.writeStream.outputMode("update").format("memory").queryName("progress").start()
    try:
        query.processAllAvailable()
        rows = spark.table("progress").collect()
    finally:
        query.stop()
    latest = {}
    for r in rows:
        latest[r.upload_id] = max(latest.get(r.upload_id, (0, 0)), (r.processed_files, r.failed_files))
    assert latest == {"u1": (2, 1), "u2": (1, 0)} and len(rows) >= 3


def test_stored_progress_counts_a_batch_once(spark, folder):
    def progress():
        return {r.upload_id: (r.processed_files, r.failed_files) for r in ingest.stored_progress(spark, folder + "/out").collect()}

    def go(checkpoint):
        finish(ingest.store_progress(read(spark, folder), folder + "/out", f"{folder}/{checkpoint}"))

    drop(spark, folder, "d1", [row("u1", "a.pdf"), row("u1", "c.pdf", "1")])
    go("cp")
    drop(spark, folder, "d2", [row("u1", "a.pdf"), row("u1", "d.pdf"), row("u2", "a.pdf")])
    go("cp")
    want = {"u1": (2, 1), "u2": (1, 0)}
    assert progress() == want

    # The last batch runs again, as after a crash before its commit.
    batches = sorted(int(n) for n in os.listdir(f"{folder}/cp/commits") if n.isdigit())
    os.remove(f"{folder}/cp/commits/{batches[-1]}")
    os.remove(f"{folder}/cp/commits/.{batches[-1]}.crc")
    go("cp")
    assert progress() == want
    go("fresh")
    assert progress() == want


@pytest.mark.parametrize("name", ["candidate", "failure"])
def test_nothing_stored_yet(spark, folder, name):
    schema = with_day({"candidate": CANDIDATE, "failure": PROCESSING_FAILURE}[name])
    assert stored_days(spark, f"{folder}/{name}", schema, dt.date(2024, 1, 1), dt.date(2024, 1, 2)).count() == 0

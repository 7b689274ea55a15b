"""The stored tables: reading, and writing in ways a rerun cannot double."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentgrid.functions.csvcells import BYTE_ORDER_MARK
from talentgrid.operators.export import csv_header, csv_rows, typed_rows
from talentgrid.operators.ordered import first_per_key
from talentgrid.operators.retention import new_cleanup_records
from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE, TABLES, with_day


#: Partition column of tables that streams write.
DAY = "arrived_day"


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables as Parquet folders, with their declared schemas."""
    return {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in TABLES.items()}


def store_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write tables as `load_tables` reads them, with their declared columns; candidates in order of their uploads, so
    that a search by upload skips row groups."""
    order = {"candidate": ["upload_id", "source_filename"], "candidate_skill": ["candidate_id"], "cv_upload": ["id"]}
    for name, df in tables.items():
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        if name in order:
            typed = typed.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
        typed.write.parquet(f"{folder}/{name}")


def load_tables_jdbc(
    spark: SparkSession,
    url: str,
    key: str = "upload_id",
    bounds: dict[str, list[str]] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """The five tables over JDBC. ``bounds`` gives a table's WHERE clauses, one per read task."""
    bounds = bounds or {}
    return {
        name: spark.read.jdbc(url, name, predicates=bounds[name], properties=options)
        if name in bounds
        else spark.read.jdbc(url, name, properties=options)
        for name in TABLES
    }


def csv_document(exported: DataFrame) -> DataFrame:
    """The lines of a CSV export: byte order mark and header first, also when nothing matches."""
    mark = F.lit(BYTE_ORDER_MARK)
    head = csv_header(exported).select(F.concat(mark, "line").alias("line"))
    return head.union(csv_rows(exported))


def write_candidates_csv(exported: DataFrame, folder: str) -> None:
    """Write the CSV lines as text, whole or not at all.

    ``exported`` is sorted, so the part files in name order are the export in order; the header is the first part. All
    parts are written beside ``folder`` and take its place by a rename once the job is done: until then the former
    document stands, and a failed export leaves it as it was.
    """
    spark = exported.sparkSession
    beside = f"{folder.rstrip('/')}.writing-{uuid.uuid4().hex}"
    try:
        csv_document(exported).write.text(beside)
        _replace(spark, beside, folder)
    finally:
        _delete(spark, beside)


def write_candidates_typed(exported: DataFrame, folder: str) -> None:
    typed_rows(exported).write.mode("overwrite").parquet(folder)


def new_failures(stored: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures to append: each id once, and only those not stored yet."""
    order = ["created_at", "filename", "error_code", "error_message", DAY]
    once = first_per_key(failures, ["id"], [c for c in order if c in failures.columns])
    return once.join(stored.select("id"), "id", "left_anti")


def stored_table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table so far; a table nobody wrote yet is empty."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_days(spark: SparkSession, folder: str, schema: StructType, first: dt.date, last: dt.date) -> DataFrame:
    """Rows of the table so far that arrived from `first` to `last`; files of other days are not listed or read."""
    return stored_table(spark, folder, schema).filter(F.col(DAY).between(F.lit(first), F.lit(last)))


def append_days(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Append rows under the day they arrived, sorted inside each file."""
    rows.sortWithinPartitions(DAY, *order).write.mode("append").partitionBy(DAY).parquet(folder)


def of_uploads(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows of the uploads of `rows`; files are sorted by upload, so a pruned join skips row groups."""
    return stored.join(rows.select("upload_id").distinct(), "upload_id", "left_semi")


def append_failures(failures: DataFrame, folder: str) -> None:
    """Append failure rows not stored yet, sorted by upload inside each file so that lookups skip row groups."""
    stored = of_uploads(stored_table(failures.sparkSession, folder, PROCESSING_FAILURE), failures)
    ordered = new_failures(stored, failures).select(*failures.columns).sortWithinPartitions("upload_id", "filename")
    ordered.write.mode("append").parquet(folder)


def append_candidates(candidates: DataFrame, folder: str) -> None:
    """Append candidates whose upload and file are not stored yet, the first of each by id."""
    keys = ["upload_id", "source_filename"]
    stored = of_uploads(stored_table(candidates.sparkSession, folder, CANDIDATE), candidates).select(*keys)
    fresh = first_per_key(candidates, keys, ["id"]).join(stored, keys, "left_anti").select(*candidates.columns)
    fresh.sortWithinPartitions(*keys).write.mode("append").parquet(folder)


def delete_days(spark: SparkSession, folder: str, schema: StructType, doomed: DataFrame) -> int:
    """Delete the rows of the uploads in ``doomed`` (upload_id) from a table stored by day; how many days were touched.

    Only days that hold such a row are written again, and a day that holds nothing else goes; files of other days stay
    as they are. A day is replaced when its rows are written, so a run that broke off can run again.
    """
    gone = doomed.select("upload_id").distinct()
    stored = stored_table(spark, folder, schema)
    marked = stored.select(DAY, "upload_id").join(gone.withColumn("_gone", F.lit(True)), "upload_id", "left")
    days = marked.groupBy(DAY).agg(F.count("_gone").alias("lost"), F.count(F.lit(1)).alias("held"))
    touched = days.filter("lost > 0").select(DAY, (F.col("lost") == F.col("held")).alias("empty")).collect()
    partly = [row[DAY] for row in touched if not row["empty"]]
    if partly:
        kept = stored.filter(_on(partly)).join(gone, "upload_id", "left_anti")
        rows = kept.select(*schema.names).hint("rebalance", DAY).sortWithinPartitions(DAY, "upload_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(folder)
    for row in touched:
        if row["empty"]:
            day = "__HIVE_DEFAULT_PARTITION__" if row[DAY] is None else row[DAY].isoformat()
            _delete(spark, f"{folder}/{DAY}={day}")
    return len(touched)


def cascade_delete_days(spark: SparkSession, candidate_folder: str, failure_folder: str, doomed: DataFrame) -> DataFrame:
    """Delete the stored failures of uploads; those that still have stored candidates are refused and returned."""
    owners = stored_table(spark, candidate_folder, with_day(CANDIDATE)).select("upload_id").distinct()
    wanted = doomed.select("upload_id").distinct()
    gone = wanted.join(owners, "upload_id", "left_anti")
    delete_days(spark, failure_folder, with_day(PROCESSING_FAILURE), gone)
    return wanted.join(owners, "upload_id", "left_semi")


def _on(days: list[dt.date | None]) -> Column:
    """Rows of these days, as a filter of partitions."""
    given = F.col(DAY).isin([day for day in days if day is not None])
    return given | F.col(DAY).isNull() if None in days else given


def _replace(spark: SparkSession, written: str, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(place, True)
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(written), place):
        raise OSError(f"cannot move {written} to {folder}")


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def append_cleanup_records(records: DataFrame, additions: DataFrame, folder: str) -> None:
    new_cleanup_records(records, additions).write.mode("append").parquet(folder)


def explode_skills(candidates: DataFrame) -> DataFrame:
    """The bridge table of a candidate table."""
    distinct = F.array_distinct("skills")
    return candidates.select(F.col("id").alias("candidate_id"), F.explode(distinct).alias("skill"))

"""Stored tables in buckets by their key, so that new rows meet stored ones without moving the stored ones.

A bucketed table is cut by the hash of its key into a fixed number of buckets, and each file is one bucket, sorted by key.
An anti-join of new rows on that key then shuffles the new rows alone, into the same buckets, and reads of the stored table
its key columns only. The session's catalog knows a table by name; its files are in a folder of their own, which another
session can register again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from talentgrid.operators.ordered import first_per_key
from talentgrid.schemas import CANDIDATE, PROCESSING_FAILURE


@dataclass(frozen=True)
class Layout:
    """A table's columns, its unique key, and which of several new rows of a key counts."""

    schema: StructType
    key: tuple[str, ...]
    order: tuple[str, ...]


CANDIDATES = Layout(CANDIDATE, ("upload_id", "source_filename"), ("id", "created_at"))
FAILURES = Layout(PROCESSING_FAILURE, ("id",), ("created_at", "filename", "error_code", "error_message"))


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table under `folder`, known to the session as `name`."""

    spark: SparkSession
    name: str
    folder: str
    layout: Layout
    buckets: int

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def new(self, rows: DataFrame) -> DataFrame:
        """Of `rows`, the first of each key that the table does not hold."""
        key = list(self.layout.key)
        once = first_per_key(rows, key, list(self.layout.order))
        return once.join(self.rows().select(*key), key, "left_anti").select(*self.layout.schema.names)

    def append(self, rows: DataFrame) -> None:
        """Append what is new, one file a bucket; rows that are stored already change nothing."""
        key = list(self.layout.key)
        self.new(rows).repartition(self.buckets, *key).sortWithinPartitions(*key).write.insertInto(self.name)


def bucketed(spark: SparkSession, name: str, folder: str, layout: Layout, buckets: int = 200) -> Bucketed:
    """The table in `folder`, registered as `name`; one that nobody wrote yet is empty.

    `buckets` stays with the table: about one for each 128 MB of keys that it will hold.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.schema)
    key = _names(layout.key)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{folder}'"
    )
    return Bucketed(spark, name, folder, layout, buckets)


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)

"""Tables written once in the folder that all executors share, to cut lineage or to be read more than once."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests on a local master, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="talentgrid-llm-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return f"file://{_own['folder']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table that one task handles well.
ROWS_A_TASK = 250_000


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those that go `up`; nothing that lives longer may read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str, rows: int | None = None, up: int = 0) -> DataFrame:
    """`df`, written as Parquet and read again. Where `df` is narrow and has at most about `rows` rows, no more tasks
    than they fill make it. It goes with the block of `temporary` that is `up` blocks further out, or stays."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // ROWS_A_TASK)))
    df.write.parquet(path)
    if len(_scopes) > up:
        _scopes[-1 - up].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, as after a table was staged.

    Its cleaner acts when the driver's JVM collects garbage, which on an idle driver can be long after the job.
    """
    gc.collect()  # Python's references to those plans first
    spark._jvm.System.gc()

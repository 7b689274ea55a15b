"""Row numbers and running sums inside groups of any size.

A window sorts each group in one task, so a group that holds a third of the table would not fit.
``running`` measures the largest group first. Small groups use the plain window. Otherwise, and always for a
table that is one group, the rows
are range-partitioned into slices by group and order, each slice is numbered on its own, and the
slices' totals (one small row per group and slice) give every slice its starting values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import fixed

MAX_GROUP_ROWS = 1_000_000
_SLICE = "_slice"


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all), from one map-side combined count."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return row.largest or 0, row.total or 0


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add ``number`` (1, 2, …) and running ``sums`` per group; ``order`` must be a total order."""
    by, sums = list(by), dict(sums or {})
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    max_group_rows = max_group_rows or MAX_GROUP_ROWS
    largest, total = group_sizes(df, by)
    if by and largest <= max_group_rows:
        return _local(df, by, order, number, sums)

    # Without groups the whole table is one group, so it is always cut. More slices than tasks gain nothing.
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(max(2 * (total // max_group_rows + 1), 2), max(most, 2))
    sliced = fixed(
        df.repartitionByRange(slices, *[F.col(b) for b in by], *order).withColumn(
            _SLICE, F.spark_partition_id()
        )
    )
    keys = [*by, _SLICE]
    names = ([number] if number else []) + list(sums)
    totals = sliced.groupBy(*keys).agg(
        *([F.count(F.lit(1)).alias(number)] if number else []),
        *[F.sum(value).alias(name) for name, value in sums.items()],
    )
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_before_" + n) for n in names],
    )
    local = _local(sliced, keys, order, number, sums)
    joined = local.join(starts, keys)
    kept = [c for c in local.columns if c not in names and c != _SLICE]
    shifted = [(F.col(n) + F.col("_before_" + n)).alias(n) for n in names]
    return joined.select(*kept, *shifted)


def _local(df, by, order, number, sums) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {name: F.sum(value).over(upto) for name, value in sums.items()}
    if number:
        columns[number] = F.row_number().over(window).cast("long")
    return df.withColumns(columns) if columns else df


def numbered(ordered: DataFrame, number: str) -> DataFrame:
    """Add the place (1, 2, …) of each row of a sorted DataFrame: its part's rows before it, and those of earlier parts."""
    placed = fixed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = placed.withColumn("_part", part)
    # one small row for each part
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(starts, "_part").withColumn(number, F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group. The rank filter prunes every map task to one row per key."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")

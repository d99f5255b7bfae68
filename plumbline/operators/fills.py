"""Forward and backward fill in row order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.layout import range_buckets


def fill_along(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    backward: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Fill nulls from the nearest earlier (or later) non-null value.

    The table is split into ordered ranges.  Each range is filled in its own
    task; a value that comes from an earlier range is carried in through a table
    with at most one row per range.  A partition with very many rows is split
    into ranges as well.  ``order_by`` must identify rows within a partition.
    """
    parts = [col(n) for n in (partition_by or [])]
    order = [(col(n).desc_nulls_last() if backward else col(n).asc_nulls_first()) for n in order_by]
    ranged = range_buckets(df, [*parts, *order], buckets)
    group = ["_bucket", *(partition_by or [])]
    group_cols = [col(n) for n in group]

    position = F.struct(*[col(n) for n in order_by])
    nearest = F.min_by if backward else F.max_by
    lasts = ranged.groupBy(*group_cols).agg(*[
        nearest(col(c), F.when(col(c).isNotNull(), position)).alias(f"_last{i}")
        for i, c in enumerate(columns)])
    # Rows of one partition appear in several ranges only at range borders.
    chain = Window.partitionBy(*(parts or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = lasts.select(*group_cols, *[
        F.last(f"_last{i}", ignorenulls=True).over(chain).alias(f"_carry{i}") for i in range(len(columns))])
    some = F.coalesce(*[F.col(f"_carry{i}").cast("string") for i in range(len(columns))])
    carried = carried.filter(some.isNotNull())

    left = ranged.alias("l")
    right = F.broadcast(carried).alias("r")
    on = [F.col(f"l.`{n}`").eqNullSafe(F.col(f"r.`{n}`")) for n in group]
    joined = left.join(right, on, "left").select("l.*", *[F.col(f"r._carry{i}") for i in range(len(columns))])
    within = Window.partitionBy(*group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(col(c), ignorenulls=True).over(within), F.col(f"_carry{i}"))
        for i, c in enumerate(columns)}
    return joined.withColumns(filled).select(*[col(n) for n in df.columns])


def forward_fill(df, columns, order_by, partition_by=None, buckets=None) -> DataFrame:
    return fill_along(df, columns, order_by, partition_by, False, buckets)


def backward_fill(df, columns, order_by, partition_by=None, buckets=None) -> DataFrame:
    return fill_along(df, columns, order_by, partition_by, True, buckets)

"""First-rows samples in key order, for parity with sample-based checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.layout import melt


def first_non_null(df: DataFrame, columns: list[str], n: int, order_by: list[str]) -> DataFrame:
    """(column, position, value): the first n non-null values of each column."""
    long = melt(df, columns, order_by).filter(F.col("value").isNotNull())
    keys = [F.col(f"key_{i}") for i in range(len(order_by))]
    order = Window.partitionBy("column").orderBy(*keys)
    return (
        long.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
        .select("column", "position", "value")
    )

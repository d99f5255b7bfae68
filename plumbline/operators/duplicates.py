"""Duplicate rows, duplicate groups and duplicate keys.

Rows are compared by a digest of fixed size, so wide rows and long texts do not
travel; counting combines on the map side, so a group of any size is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats
from plumbline.operators.frequencies import bounded_keys
from plumbline.operators.layout import key_columns, key_text, lookup, melt, row_digest


def digest_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(row_digest(df, columns).alias("row_key")).groupBy("row_key").agg(
        F.count("*").alias("duplicate_count")
    )


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows, duplicate rows after the first, and their share."""
    groups = digest_counts(df, columns)
    return groups.agg(
        F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("row_count"),
        F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("duplicate_count") > 1).alias("duplicate_groups"),
    ).withColumn("duplicate_pct", stats.percent(F.col("duplicate_rows"), F.col("row_count")))


def duplicate_groups(
    df: DataFrame, key: str | list[str], columns: list[str] | None = None
) -> DataFrame:
    """One row per group of equal rows: size and the smallest row key."""
    keyed = df.select(
        row_digest(df, columns).alias("row_key"),
        F.struct(*key_columns(key)).alias("first_key"),
        key_text(key).alias("row_id"),
    )
    return (
        keyed.groupBy("row_key")
        .agg(F.count("*").alias("duplicate_count"), F.min_by("row_id", "first_key").alias("first_row_id"),
             F.min("first_key").alias("first_key"))
        .filter(F.col("duplicate_count") > 1)
    )


def rows_of_duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row that has an equal row, with its group's key and size."""
    names = columns or df.columns
    groups = digest_counts(df, names).filter(F.col("duplicate_count") > 1)
    tagged = df.withColumn("row_key", row_digest(df, names))
    return lookup(tagged, groups, "row_key", hot_by="duplicate_count")


def group_members(rows: DataFrame, key: str | list[str], listed: int = 5) -> DataFrame:
    """The first row keys of each duplicate group, as a short list."""
    order = Window.partitionBy("row_key").orderBy(*key_columns(key))
    first = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= listed)
    return first.groupBy("row_key", "duplicate_count").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", key_text(key).alias("id")))),
            lambda s: s["id"],
        ).alias("first_row_ids")
    )


def key_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: values beyond the first of their kind; null is a value."""
    groups = (
        bounded_keys(melt(df, columns))
        .groupBy("column", "value", "digest")
        .agg(F.count("*").alias("n"))
    )
    return groups.groupBy("column").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("violations")
    )

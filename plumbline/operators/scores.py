"""Score tables: (dataset, operator, component, score, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_rows(row: DataFrame, operator: str, components: dict[str, Column], status: Column,
               dataset: str = "table", overall: str = "overall") -> DataFrame:
    """A one-row table of score expressions as one row per component."""
    cells = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(operator).alias("operator"),
            F.lit(name).alias("component"),
            value.cast("double").alias("score"),
            (status if name == overall else F.lit(None).cast("string")).alias("status"),
        )
        for name, value in components.items()
    ]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def mean_scores(scores: DataFrame, digits: int = 0) -> DataFrame:
    """Mean score per operator and component over datasets, rounded half-even."""
    return scores.groupBy("operator", "component").agg(
        F.bround(F.avg("score"), digits).alias("score"),
        F.countDistinct("dataset").alias("datasets"),
    )


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """One-row tables with different columns as one row."""
    return union_all(rows).agg(*[
        F.first(F.col(f"`{name}`"), ignorenulls=True).alias(name) for row in rows for name in row.columns])


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

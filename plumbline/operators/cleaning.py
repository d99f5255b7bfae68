"""The score all cleaning operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators.scores import score_rows
from plumbline.sources.state import small_table


def cleaning_score(
    spark: SparkSession, operator: str, found: int, remaining: int, rows_before: int, rows_after: int,
    columns_before: int, columns_after: int, weights: tuple, thresholds: tuple, statuses: tuple,
    dataset: str = "table",
) -> DataFrame:
    """Weighted reduction, row retention and column retention."""
    schema = "found bigint, remaining bigint, rb bigint, ra bigint, cb bigint, ca bigint"
    counts = small_table(spark, 
        [(found, remaining, rows_before, rows_after, columns_before, columns_after)], schema)
    return score_counts(counts, operator, weights, thresholds, statuses, dataset)


def cleaning_findings(scores: DataFrame, operator: str, dataset: str = "table") -> DataFrame:
    """What a cleaning left over, and a score below the expected band."""
    score = {c: F.max(F.when(F.col("component") == c, F.col("score"))) for c in ("remaining", "overall")}
    row = scores.agg(score["remaining"].alias("remaining"), score["overall"].alias("overall"), F.max("status").alias("status"))
    low = F.col("status").startswith("Needs More")
    made = F.array_compact(F.array(
        F.when(F.col("remaining") > 0, F.struct(
            F.lit("warning").alias("severity"), F.lit("remaining_after_cleaning").alias("type"),
            F.concat(F.col("remaining").cast("bigint").cast("string"), F.lit(f" {operator} remain")).alias("message"))),
        F.when(low, F.struct(
            F.lit("critical").alias("severity"), F.lit("low_cleaning_score").alias("type"),
            F.concat(F.lit("cleaning score "), F.col("overall").cast("string")).alias("message")))))
    return row.select(F.explode(made).alias("f")).select(
        F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("column"), "f.severity",
        F.lit("cleaning").alias("category"), "f.type", "f.message")


def score_counts(
    counts: DataFrame, operator: str, weights: tuple, thresholds: tuple, statuses: tuple, dataset: str = "table"
) -> DataFrame:
    """The same score from a one-row table (found, remaining, rb, ra, cb, ca)."""
    reduction = F.when(F.col("found") > 0, (F.col("found") - F.col("remaining")) * 100.0 / F.col("found")).otherwise(100.0)
    rows = F.when(F.col("rb") > 0, F.col("ra") * 100.0 / F.col("rb")).otherwise(0.0)
    columns = F.when(F.col("cb") > 0, F.col("ca") * 100.0 / F.col("cb")).otherwise(0.0)
    overall = weights[0] * reduction + weights[1] * rows + weights[2] * columns
    quality = rules.banded(overall, [(thresholds[0], "excellent"), (thresholds[1], "good")], "needs_improvement")
    status = (
        F.when((quality == "excellent") & (F.col("remaining") == 0), statuses[0])
        .when(quality != "needs_improvement", statuses[1])
        .otherwise(statuses[2]))
    return score_rows(counts, operator, {
        "overall": F.bround(overall, 1),
        "reduction": F.bround(reduction, 1),
        "row_retention": F.bround(rows, 1),
        "column_retention": F.bround(columns, 1),
        "found": F.col("found"),
        "remaining": F.col("remaining"),
    }, status, dataset)

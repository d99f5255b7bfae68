"""Rate a table's readiness: completeness, consistency and schema health."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, stats
from plumbline.functions.columns import columns_of
from plumbline.operators import duplicates, issues, profile, scores
from plumbline.operators.facts import column_facts
from plumbline.operators.sampling import first_non_null
from plumbline.params import ReadinessParams
from plumbline.functions.text import converts_to_number
from plumbline.sources.state import as_local, small_table


class Readiness(NamedTuple):
    scores: DataFrame
    deductions: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def numeric_looking_columns(df: DataFrame, sample_rows: int | None = None, order_by=None) -> DataFrame:
    """Text columns with at least one numeric-looking value.

    The whole column counts unless a sample of its first rows is asked for.
    """
    names = columns_of(df, "text")
    if not names:
        return small_table(df.sparkSession, [], "column string, numeric_values bigint")
    if sample_rows is None:
        facts = column_facts(df, ("numbers",), names)
        return facts.select("column", F.col("numbers").alias("numeric_values"))
    sample = first_non_null(df, names, sample_rows, order_by)
    return sample.groupBy("column").agg(
        F.count_if(converts_to_number(F.col("value"))).alias("numeric_values")
    )


def health_facts(df: DataFrame) -> DataFrame:
    """Nulls, constant columns and numeric-looking text per column; one scan."""
    return column_facts(df, ("constant", "numbers"))


def readiness_facts(
    df: DataFrame, p: ReadinessParams = ReadinessParams(), order_by=None, columns: DataFrame | None = None
) -> DataFrame:
    """One row: cells, nulls, duplicates, constant and mixed columns."""
    facts = health_facts(df) if columns is None else columns
    table = facts.agg(
        F.max("row_count").alias("row_count"),
        F.sum("row_count").alias("cells"),
        F.sum("null_count").alias("null_cells"),
        F.count_if("constant").alias("constant_columns"),
        F.count_if(F.col("numbers") > 0).alias("mixed_columns"),
    )
    parts = [table, duplicates.duplicate_summary(df).select("duplicate_rows")]
    if p.sample_rows:
        sampled = numeric_looking_columns(df, p.sample_rows, order_by)
        mixed = sampled.agg(F.count_if(F.col("numeric_values") > 0).alias("mixed_columns"))
        parts = [table.drop("mixed_columns"), parts[1], mixed]
    return scores.side_by_side(parts)


def readiness_scores(facts: DataFrame, p: ReadinessParams = ReadinessParams(), dataset: str = "table") -> DataFrame:
    """Component and overall scores from the one-row facts."""
    empty = F.col("row_count") == 0
    row = facts.select(
        "row_count",
        (100.0 - stats.percent(F.col("null_cells"), F.col("cells"))).alias("completeness"),
        (100.0 - stats.percent(F.col("duplicate_rows"), F.col("row_count"))).alias("consistency"),
        F.greatest(
            F.lit(0), 100 - 10 * F.col("constant_columns") - 5 * F.col("mixed_columns")
        ).alias("schema_health"),
    )
    overall = F.bround(
        p.completeness_weight * F.col("completeness")
        + p.consistency_weight * F.col("consistency")
        + p.schema_health_weight * F.col("schema_health")
    )
    def zero_if_empty(c):
        return F.when(empty, F.lit(0.0)).otherwise(c)

    overall = zero_if_empty(overall)
    status = rules.banded(
        overall, [(p.ready_threshold, "Ready"), (p.needs_review_threshold, "Needs Review")], "Not Ready"
    )
    components = {
        "overall": overall,
        "completeness": zero_if_empty(F.bround("completeness")),
        "consistency": zero_if_empty(F.bround("consistency")),
        "schema_health": zero_if_empty(F.bround(F.col("schema_health").cast("double"))),
    }
    return scores.score_rows(row, "readiness", components, status, dataset)


def deductions(df: DataFrame, facts: DataFrame, column_rows: DataFrame, dataset: str = "table") -> DataFrame:
    """One line per reason that lowered a score."""
    null_pct = stats.percent(F.col("null_cells"), F.col("cells"))
    dup_pct = stats.percent(F.col("duplicate_rows"), F.col("row_count"))
    table_level = facts.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("row_count") == 0, F.struct(
                        F.lit("general").alias("category"), F.lit(None).cast("string").alias("column"),
                        F.lit(0.0).alias("points"))),
                    F.when(F.col("null_cells") > 0, F.struct(
                        F.lit("data_completeness").alias("category"),
                        F.lit(None).cast("string").alias("column"), null_pct.alias("points"))),
                    F.when(F.col("duplicate_rows") > 0, F.struct(
                        F.lit("data_consistency").alias("category"),
                        F.lit(None).cast("string").alias("column"), dup_pct.alias("points"))),
                )
            )
        ).alias("d")
    ).select("d.*")
    column_level = column_rows.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("constant"), F.struct(
                        F.lit("schema_health").alias("category"), F.col("column"),
                        F.lit(10.0).alias("points"))),
                    F.when(F.col("numbers") > 0, F.struct(
                        F.lit("schema_health").alias("category"), F.col("column"),
                        F.lit(5.0).alias("points"))),
                )
            )
        ).alias("d")
    ).select("d.*")
    return table_level.unionByName(column_level).select(
        F.lit(dataset).alias("dataset"), "category", "column", F.bround("points", 1).alias("points")
    )


def readiness_findings(score_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The status alert and one info finding per deduction."""
    alert = score_rows.filter((F.col("component") == "overall") & (F.col("status") != "Ready"))
    from_score = alert.select(
        "dataset",
        F.lit(None).cast("string").alias("column"),
        F.when(F.col("status") == "Needs Review", "warning").otherwise("critical").alias("severity"),
        F.lit("readiness_assessment").alias("category"),
        F.lit("readiness_score").alias("type"),
        F.concat(F.lit("Overall readiness score is "), F.col("score").cast("int").cast("string"),
                 F.lit(".")).alias("message"),
    )
    from_lines = lines.select(
        "dataset",
        "column",
        F.lit("info").alias("severity"),
        "category",
        F.lit("deduction").alias("type"),
        F.concat(F.lit("Score reduced by "), F.format_string("%.1f", F.col("points")),
                 F.lit(" points.")).alias("message"),
    )
    return from_score.unionByName(from_lines)


def readiness(
    df: DataFrame, key: str | list[str], p: ReadinessParams = ReadinessParams(), dataset: str = "table"
) -> Readiness:
    columns = as_local(health_facts(df))
    facts = as_local(readiness_facts(df, p, key if isinstance(key, list) else [key], columns))
    result = readiness_scores(facts, p, dataset)
    lines = deductions(df, facts, columns, dataset)
    nulls = issues.null_issues(df, key, severity="warning", dataset=dataset)
    groups = profile.duplicate_issues(df, key, dataset)
    constant = columns.filter("constant").select(
        F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("row_id"), "column",
        F.lit("constant_column").alias("issue_type"), F.lit(None).cast("string").alias("pii_type"),
        F.lit("info").alias("severity"), F.col("sample_value").alias("value"),
        F.concat(F.lit("Column '"), F.col("column"), F.lit("' has only one unique value")).alias("message"))
    listed = scores.union_all(
        [issues.first_per_kind(nulls, 20), groups.orderBy("row_key").limit(10), constant])
    full = (
        nulls.select(*issues.FIELDS).unionByName(groups.select(*issues.FIELDS)).unionByName(constant)
    )
    return Readiness(result, lines, readiness_findings(result, lines), issues.reported(listed, p.issues_listed),
                     issues.issue_summary(full))

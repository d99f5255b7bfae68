"""Row-level issues: found in one scan, listed up to a limit, counted in full."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.facts import present
from plumbline.operators.layout import key_columns, key_text
from plumbline.sources.state import small_table

FIELDS = [
    "dataset", "row_id", "column", "issue_type", "pii_type", "severity", "value", "message",
]


@dataclass(frozen=True)
class CellRule:
    """A predicate on a row that makes one issue."""

    column: str
    issue_type: str
    severity: str | Column
    broken: Column
    value: Column | None = None
    message: str | Column = ""
    pii_type: str | None = None


def cell_issues(
    df: DataFrame, key: str | list[str], rules: list[CellRule], dataset: str = "table"
) -> DataFrame:
    """All issues of all rules from one scan; rows without issues give nothing."""
    if not rules:
        return empty_issues(df)
    made = []
    for rule in rules:
        severity = F.lit(rule.severity) if isinstance(rule.severity, str) else rule.severity
        message = F.lit(rule.message) if isinstance(rule.message, str) else rule.message
        value = F.lit(None) if rule.value is None else rule.value
        issue = F.struct(
            F.lit(rule.column).alias("column"),
            F.lit(rule.issue_type).alias("issue_type"),
            F.lit(rule.pii_type).cast("string").alias("pii_type"),
            severity.alias("severity"),
            value.cast("string").alias("value"),
            message.alias("message"),
        )
        made.append(F.when(F.coalesce(rule.broken, F.lit(False)), issue))
    found = df.select(
        F.lit(dataset).alias("dataset"),
        key_text(key).alias("row_id"),
        F.struct(*key_columns(key)).alias("row_key"),
        F.explode(F.array_compact(F.array(*made))).alias("issue"),
    )
    return found.select("dataset", "row_id", "row_key", "issue.*")


def empty_issues(df: DataFrame) -> DataFrame:
    schema = ", ".join(f"{name} string" for name in FIELDS)
    return small_table(df.sparkSession, [], schema)


def null_issues(
    df: DataFrame,
    key: str | list[str],
    columns: list[str] | None = None,
    severity: str | dict[str, str] = "warning",
    issue_type: str = "null_value",
    dataset: str = "table",
) -> DataFrame:
    rules = [
        CellRule(
            name,
            issue_type,
            severity if isinstance(severity, str) else severity[name],
            present(df, name).isNull(),
            message=f"Null value in column '{name}'",
        )
        for name in (columns or df.columns)
    ]
    return cell_issues(df, key, rules, dataset)


def first_per_kind(issues: DataFrame, n: int, by: tuple[str, ...] = ("column", "issue_type", "pii_type")) -> DataFrame:
    """The first n issues of each kind in key order.

    Spark limits each input partition before the shuffle, so a kind that most
    rows share does not reach one task in full.
    """
    order = Window.partitionBy(*by).orderBy("row_key")
    return (
        issues.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def reported(issues: DataFrame, limit: int = 100) -> DataFrame:
    """At most ``limit`` issues over all kinds, in key order; those without a row last."""
    by_row = [F.col("row_key").asc_nulls_last()] if "row_key" in issues.columns else []
    return (
        issues.orderBy(*by_row, F.col("row_id").asc_nulls_last(), "column", "issue_type", "pii_type")
        .limit(limit)
        .select(*FIELDS))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Full counts by type, severity, column and personal-data type, and in total."""
    dims = ["issue_type", "severity", "column", "pii_type"]
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = issues.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.count("*").alias("count"),
        *[F.grouping(F.col(d)).alias(f"g_{d}") for d in dims],
    )
    dimension = F
    key = F
    for d in dims:
        dimension = dimension.when(F.col(f"g_{d}") == 0, F.lit(d))
        key = key.when(F.col(f"g_{d}") == 0, F.col(d))
    labelled = grouped.select(
        dimension.otherwise("total").alias("dimension"),
        key.otherwise("all").alias("key"),
        "count",
    )
    return labelled.filter(F.col("key").isNotNull())


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row with the number of findings per severity."""
    levels = ["critical", "high", "warning", "medium", "low", "info"]
    return findings.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in levels]
    )


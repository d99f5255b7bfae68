"""Profile a table: column statistics, semantic types, alerts and row issues."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, stats
from plumbline.functions.columns import columns_of
from plumbline.operators import duplicates, frequencies, issues
from plumbline.operators.facts import local_facts, number
from plumbline.operators.layout import aggregate_rows
from plumbline.operators.scores import union_all
from plumbline.params import ProfileParams
from plumbline.sources.state import as_local, small_table

PROFILE_FIELDS = [
    "dataset", "column", "data_type", "semantic_type", "row_count", "null_count", "null_pct",
    "distinct_count", "min", "max", "mean", "median", "std_dev", "variance", "p25", "p75",
    "outlier_count", "earliest", "latest", "span_days", "entropy",
]


class Profile(NamedTuple):
    column_profile: DataFrame
    top_values: DataFrame
    issues: DataFrame
    issue_summary: DataFrame
    findings: DataFrame
    status: DataFrame


def outlier_counts(df: DataFrame, facts: DataFrame, multiplier: float) -> DataFrame:
    """Values outside the IQR fences per numeric column: one scan for all."""
    rows = []
    for r in facts.collect():
        if r["kind"] == "numeric" and r["p25"] is not None:
            low, high = fences(r["p25"], r["p75"], multiplier)
            v = number(df, r["column"])
            rows.append({"column": r["column"], "outlier_count": F.count_if((v < low) | (v > high))})
    return aggregate_rows(df, rows, {"column": "string", "outlier_count": "bigint"})


def fences(p25: float, p75: float, multiplier: float) -> tuple[float, float]:
    iqr = p75 - p25
    return p25 - multiplier * iqr, p75 + multiplier * iqr


def column_profile(
    df: DataFrame, p: ProfileParams = ProfileParams(), dataset: str = "table", facts=None, spread=None
) -> DataFrame:
    """One row per column.  Three scans: facts, outliers, text frequencies."""
    if facts is None:
        facts = local_facts(df, ("range", "moments", "quartiles", "dates"))
    listed = columns_of(df, "text", "boolean", "other")
    if spread is None and listed:
        spread = frequencies.distribution(frequencies.digest_counts(df, listed))
    if spread is None:
        spread = small_table(df.sparkSession, [], "column string, distinct_count bigint, entropy double")
    spread = spread.select("column", "distinct_count", "entropy")
    outliers = outlier_counts(df, facts, p.outlier_iqr_multiplier)
    joined = facts.join(F.broadcast(spread), "column", "left").join(
        F.broadcast(outliers), "column", "left"
    )
    semantic = rules.semantic_type(
        F.col("kind"), F.col("non_null_count"), F.col("row_count"),
        F.col("distinct_count"), F.col("parsed_dates"), p,
    )
    temporal = F.col("semantic_type") == "Temporal"
    described = F.col("semantic_type").isin("Categorical", "Free Text")
    typed = joined.withColumn("semantic_type", semantic)
    return typed.select(
        F.lit(dataset).alias("dataset"),
        "column",
        "data_type",
        "semantic_type",
        "row_count",
        "null_count",
        F.bround(stats.percent(F.col("null_count"), F.col("row_count")), 1).alias("null_pct"),
        F.when(described, F.col("distinct_count")).alias("distinct_count"),
        *_numeric_only("min", "max"),
        F.when(F.col("semantic_type") == "Numeric", F.bround("mean", 2)).alias("mean"),
        "median",
        F.bround("std_dev", 2).alias("std_dev"),
        F.bround("variance", 2).alias("variance"),
        "p25",
        "p75",
        "outlier_count",
        F.when(temporal, F.col("earliest")).alias("earliest"),
        F.when(temporal, F.col("latest")).alias("latest"),
        F.when(temporal, F.expr("timestampdiff(DAY, earliest, latest)")).alias("span_days"),
        F.when(described, F.bround("entropy", 3)).alias("entropy"),
        F.col("non_null_count").alias("non_null_count"),
        F.col("position").alias("position"),
    )


def _numeric_only(*names: str):
    return [F.when(F.col("semantic_type") == "Numeric", F.col(n)).alias(n) for n in names]


def profile_alerts(profile: DataFrame, top: DataFrame, p: ProfileParams = ProfileParams()) -> DataFrame:
    """Findings from the column profile, with category and profile facts."""
    first = top.filter(F.col("rank") == 1).select("column", F.col("value").alias("top_value"))
    base = profile.join(F.broadcast(first), "column", "left")
    ratio = F.col("outlier_count") / F.col("non_null_count")
    percent_text = F.format_string("%.1f", F.col("null_pct"))
    ratio_text = F.format_string("%.1f", F.bround(ratio * 100, 1))

    def alert(condition, kind, severity, message):
        return F.when(condition, F.struct(
            F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message")))

    raised = F.array_compact(
        F.array(
            alert(F.col("null_pct") > p.null_alert_threshold, "missing_values", "warning",
                  F.concat(percent_text, F.lit(" % of the rows have no value here"))),
            alert(F.col("semantic_type") == "Unknown", "only_nulls", "warning",
                  F.lit("no row has a value here")),
            alert((F.col("variance") > 0) & (F.col("variance") < 0.01), "low_variance", "info",
                  F.concat(F.lit("nearly constant, variance "), F.col("variance").cast("string"))),
            alert(ratio > p.outlier_alert_threshold, "outliers", "warning",
                  F.concat(F.col("outlier_count").cast("string"), F.lit(" values beyond the fences, "), ratio_text,
                           F.lit(" % of all values"))),
            alert((F.col("distinct_count") == 1) & (F.col("semantic_type") == "Categorical"), "constant", "info",
                  F.concat(F.lit("always '"), F.col("top_value"), F.lit("'"))),
            alert((F.col("distinct_count") == 1) & (F.col("semantic_type") == "Free Text"), "constant", "info",
                  F.lit("always the same text")),
        )
    )
    found = base.withColumn("alert", F.explode(raised))
    return found.select(
        "dataset",
        "column",
        F.col("alert.severity").alias("severity"),
        rules.alert_category(F.col("alert.kind")).alias("category"),
        F.lit("profile_alert").alias("type"),
        F.col("alert.message").alias("message"),
        "data_type",
        "semantic_type",
        "null_pct",
        "outlier_count",
    )


def profile_issues(
    df: DataFrame, key: str | list[str], facts: DataFrame, p: ProfileParams = ProfileParams(),
    dataset: str = "table",
) -> DataFrame:
    """All null and outlier cells of a table, from one scan."""
    made = []
    for r in facts.collect():
        name = r["column"]
        if r["null_count"]:
            share = r["null_count"] / r["row_count"]
            made.append(issues.CellRule(
                name, "null_value", "warning" if share > 0.2 else "info",
                issues.present(df, name).isNull(), message=f"Null value in column '{name}'"))
        if r["kind"] == "numeric" and r["p25"] is not None:
            low, high = fences(r["p25"], r["p75"], p.outlier_iqr_multiplier)
            v = number(df, name)
            made.append(issues.CellRule(
                name, "outlier", "warning", (v < low) | (v > high), value=v,
                message=f"Outlier detected in column '{name}' (bounds {low} to {high})"))
    return issues.cell_issues(df, key, made, dataset)


def constant_issues(profile: DataFrame, top: DataFrame) -> DataFrame:
    first = top.filter(F.col("rank") == 1).select("column", "value")
    constant = profile.filter((F.col("distinct_count") == 1) & (F.col("row_count") > 1))
    return constant.join(F.broadcast(first), "column").select(
        "dataset",
        F.lit(None).cast("string").alias("row_id"),
        "column",
        F.lit("constant_column").alias("issue_type"),
        F.lit(None).cast("string").alias("pii_type"),
        F.lit("info").alias("severity"),
        "value",
        F.concat(F.lit("constant column "), F.col("column")).alias("message"),
    )


def duplicate_issues(df: DataFrame, key: str | list[str], dataset: str = "table") -> DataFrame:
    """One issue per group of equal rows, on its first row."""
    groups = duplicates.duplicate_groups(df, key)
    return groups.select(
        F.lit(dataset).alias("dataset"),
        F.col("first_row_id").alias("row_id"),
        F.col("first_key").alias("row_key"),
        F.lit(None).cast("string").alias("column"),
        F.lit("duplicate_row").alias("issue_type"),
        F.lit(None).cast("string").alias("pii_type"),
        F.lit("warning").alias("severity"),
        F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("Duplicate row found "), F.col("duplicate_count").cast("string"),
                 F.lit(" times")).alias("message"),
    )


def routing(findings: DataFrame, row_count: int, dataset: str = "table") -> DataFrame:
    """Needs Review when a warning or critical finding exists or the table is empty."""
    serious = findings.agg(F.count_if(F.col("severity").isin("warning", "critical")).alias("serious"))
    empty = F.lit(row_count == 0)
    return serious.select(
        F.lit(dataset).alias("dataset"),
        F.when((F.col("serious") > 0) | empty, "Needs Review").otherwise("Ready").alias("status"),
        F.when(empty, "the table has no rows")
        .when(F.col("serious") > 0, F.concat(F.col("serious").cast("string"), F.lit(" findings of severity warning or critical")))
        .otherwise("no finding of severity warning or critical")
        .alias("reason"),
    )


def profile(
    df: DataFrame, key: str | list[str], p: ProfileParams = ProfileParams(), dataset: str = "table"
) -> Profile:
    """The full profile; issue tables list the first rows, summaries count all."""
    facts = local_facts(df, ("range", "moments", "quartiles", "dates"))
    listed = columns_of(df, "text", "boolean", "other")
    spread, top = None, small_table(
        df.sparkSession, [], "column string, rank int, value string, count bigint, digest string")
    if listed:
        spread, top = frequencies.spread_and_top(frequencies.digest_counts(df, listed), p.top_n_values)
    columns = as_local(column_profile(df, p, dataset, facts, spread))
    # Values are shown whole, but for the most frequent texts of a free-text column.
    whole = (F.col("semantic_type") == "Categorical") | (F.col("distinct_count") == 1)
    kept = columns.filter(F.col("semantic_type").isin("Categorical", "Free Text")).select("column", whole.alias("_whole"))
    top = top.join(F.broadcast(kept), "column")
    shown = frequencies.whole_values(df, top.filter("_whole").drop("_whole"))
    top = as_local(shown.unionByName(top.filter("not _whole").drop("_whole", "digest")))
    findings = profile_alerts(columns, top, p)
    cells = profile_issues(df, key, facts, p, dataset)
    groups = duplicate_issues(df, key, dataset)
    constant = constant_issues(columns, top)
    listed_cells = issues.first_per_kind(cells, p.null_rows_listed) if "row_key" in cells.columns else cells
    first_groups = groups.orderBy("row_key").limit(p.duplicate_groups_listed)
    every = union_all([listed_cells, first_groups, constant])
    full = (
        cells.select(*issues.FIELDS).unionByName(constant).unionByName(groups.select(*issues.FIELDS))
    )
    row_count = facts.first()["row_count"]
    return Profile(
        columns.select(*PROFILE_FIELDS),
        top.select(F.lit(dataset).alias("dataset"), "column", "rank", "value", "count"),
        issues.reported(every, p.issues_listed),
        issues.issue_summary(full),
        findings,
        routing(findings, row_count, dataset),
    )

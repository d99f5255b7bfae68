"""Detect outliers by IQR, z-score or percentile fences; remove or replace them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, stats
from plumbline.functions.columns import col, columns_of
from plumbline.operators import issues, quantiles
from plumbline.operators.cleaning import cleaning_findings, cleaning_score
from plumbline.operators.facts import number
from plumbline.operators.layout import aggregate_rows
from plumbline.params import OutlierParams
from plumbline.sources.state import as_local, small_table

_LEAST_VALUES = {"iqr": 4, "z_score": 3, "percentile": 10}


class Outliers(NamedTuple):
    table: DataFrame
    summary: DataFrame
    actions: DataFrame
    scores: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def bounds(df: DataFrame, p: OutlierParams = OutlierParams(), columns: list[str] | None = None) -> DataFrame:
    """Fences per numeric column: one row each, evaluated once."""
    names = columns or columns_of(df, "numeric")
    spark = df.sparkSession
    out_schema = ("column string, n bigint, rows bigint, low double, high double, "
                  "extreme_low double, extreme_high double, mean double, median double, std_pop double")
    if not names:
        return small_table(spark, [], out_schema)
    if p.method == "percentile":
        probabilities = [p.lower_percentile / 100, p.upper_percentile / 100, 0.001, 0.999, 0.5]
    elif p.method == "z_score":
        # Quantiles are only needed here to replace values by the median.
        probabilities = [0.5] if p.strategy == "impute_median" else []
    else:
        probabilities = [0.25, 0.75, 0.5]
    aggregates = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        v = number(df, n)
        aggregates += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    exact = quantiles.narrowed(df, {n: number(df, n) for n in names}, probabilities) if probabilities else {}
    rows = []
    for i, n in enumerate(names):
        q = exact.get(n) or [None] * len(probabilities)
        count, mean, std = row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]
        low = high = extreme_low = extreme_high = None
        if count >= _LEAST_VALUES[p.method]:
            if p.method == "iqr":
                spread = q[1] - q[0]
                low, high = q[0] - p.iqr_multiplier * spread, q[1] + p.iqr_multiplier * spread
            elif p.method == "percentile":
                low, high, extreme_low, extreme_high = q[0], q[1], q[2], q[3]
            elif std:
                low, high = mean - p.z_threshold * std, mean + p.z_threshold * std
        rows.append((n, count, row["rows"], low, high, extreme_low, extreme_high, mean,
                     q[-1] if q else None, std))
    return small_table(spark, rows, out_schema)


def is_outlier(df: DataFrame, bound, p: OutlierParams) -> Column:
    v = number(df, bound["column"])
    if bound["low"] is None:
        return F.lit(False)
    if p.method == "z_score":
        return F.coalesce(F.abs((v - bound["mean"]) / bound["std_pop"]) > p.z_threshold, F.lit(False))
    return F.coalesce((v < bound["low"]) | (v > bound["high"]), F.lit(False))


def severity(df: DataFrame, bound, p: OutlierParams) -> Column:
    v = number(df, bound["column"])
    if p.method == "z_score":
        return F.when(F.abs((v - bound["mean"]) / bound["std_pop"]) > 4.0, "critical").otherwise("warning")
    if p.method == "percentile":
        return F.when((v < bound["extreme_low"]) | (v > bound["extreme_high"]), "critical").otherwise("warning")
    iqr = (bound["high"] - bound["low"]) / (1 + 2 * p.iqr_multiplier)
    return rules.iqr_severity(v, F.lit(bound["low"]), F.lit(bound["high"]), F.lit(iqr), p.nearest_fence)


def any_outlier(df: DataFrame, bound_rows: list, p: OutlierParams) -> Column:
    return reduce(Column.__or__, [is_outlier(df, b, p) for b in bound_rows], F.lit(False))


def outlier_counts(df: DataFrame, bound_rows: list, p: OutlierParams = OutlierParams()) -> DataFrame:
    """Outliers per column, and rows with any outlier (no column); one scan."""
    rows = bound_rows[0]["rows"] if bound_rows else 0
    counted = [
        {"column": b["column"], "outlier_count": F.count_if(is_outlier(df, b, p)), "rows": rows}
        for b in bound_rows
    ]
    counted.append({"outlier_count": F.count_if(any_outlier(df, bound_rows, p)), "rows": rows})
    return aggregate_rows(df, counted, {"column": "string", "outlier_count": "bigint", "rows": "bigint"})


def summarized(counts: DataFrame) -> DataFrame:
    """Outlier count, share of all rows and advice for the columns that have outliers."""
    pct = stats.percent(F.col("outlier_count"), F.col("rows"))
    return counts.filter("column is not null and outlier_count > 0").select(
        "column", "outlier_count", F.bround(pct, 2).alias("outlier_pct"),
        rules.outlier_advice(pct).alias("advice"), rules.outlier_advice_priority(pct).alias("priority"))


def outlier_summary(df: DataFrame, bound_rows: list, p: OutlierParams = OutlierParams()) -> DataFrame:
    return summarized(outlier_counts(df, bound_rows, p))


def outlier_issues(df: DataFrame, key: str | list[str], bound_rows: list, p: OutlierParams, dataset: str = "table") -> DataFrame:
    kind = "outlier_removed" if p.strategy == "remove" else "outlier_imputed"
    return issues.cell_issues(df, key, [
        issues.CellRule(b["column"], kind, severity(df, b, p), is_outlier(df, b, p),
                        value=number(df, b["column"]),
                        message=f"Outlier in column '{b['column']}' by {p.method}")
        for b in bound_rows if b["low"] is not None], dataset)


def clean(df: DataFrame, bound_rows: list, p: OutlierParams = OutlierParams()) -> DataFrame:
    """Remove rows with any outlier, or replace outliers by the column's mean or median."""
    active = [b for b in bound_rows if b["low"] is not None]
    if not active:
        return df
    if p.strategy == "remove":
        return df.filter(~any_outlier(df, active, p))
    stat = {"impute_mean": "mean", "impute_median": "median"}[p.strategy]
    return df.withColumns({
        b["column"]: F.when(is_outlier(df, b, p), F.lit(b[stat])).otherwise(col(b["column"])) for b in active})


def handle_outliers(df: DataFrame, key: str | list[str], p: OutlierParams = OutlierParams(), dataset: str = "table") -> Outliers:
    rows = bounds(df, p).collect()
    counts = as_local(outlier_counts(df, rows, p))
    summary = summarized(counts)
    table = clean(df, rows, p)
    found = outlier_issues(df, key, rows, p, dataset)
    counted = {r["column"]: r["outlier_count"] for r in counts.collect()}
    rows_hit = counted.pop(None)
    total = sum(counted.values())
    before = rows[0]["rows"] if rows else df.count()
    after = before - rows_hit if p.strategy == "remove" else before
    # Every detected outlier is handled, so none of them remains.
    scores = cleaning_score(
        df.sparkSession, "outliers", total, 0, before, after, len(df.columns), len(table.columns),
        (p.outlier_reduction_weight, p.data_retention_weight, p.column_retention_weight),
        (p.excellent_threshold, p.good_threshold),
        ("Fully Cleaned", "Well Cleaned", "Needs More Cleaning"), dataset)
    stat = {"impute_mean": "mean", "impute_median": "median"}.get(p.strategy)
    fill = {b["column"]: b[stat] for b in rows} if stat else {}
    fill_value = F.coalesce(*[F.when(F.col("column") == n, F.lit(str(v))) for n, v in fill.items()],
                            F.lit(None).cast("string"))
    actions = summary.select(
        F.lit(dataset).alias("dataset"), "column", F.lit(p.strategy).alias("strategy"),
        F.col("outlier_count").alias("cells_changed"), fill_value.alias("fill_value"))
    listed = (issues.first_per_kind(found, p.rows_listed, ("column",)) if "row_key" in found.columns else found)
    return Outliers(table, summary, actions, scores, cleaning_findings(scores, "outliers", dataset),
                    issues.reported(listed, p.issues_listed), issues.issue_summary(found))

"""Analyse and repair nulls."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, stats
from plumbline.functions.columns import kind_of
from plumbline.operators import fills, issues, quantiles
from plumbline.operators.cleaning import cleaning_findings, cleaning_score
from plumbline.operators.facts import column_facts, number, present
from plumbline.operators.neighbors import knn_fill
from plumbline.params import NullParams
from plumbline.sources.state import as_local, small_table


class HandledNulls(NamedTuple):
    table: DataFrame
    analysis: DataFrame
    actions: DataFrame
    scores: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def null_analysis(facts: DataFrame) -> DataFrame:
    """Null share, advice and suggested fill for the columns that have nulls."""
    pct = stats.percent(F.col("null_count"), F.col("row_count"))
    skew = stats.sample_skewness(F.col("non_null_count"), F.col("skew"))
    return facts.filter(F.col("null_count") > 0).select(
        "column", "data_type", "null_count", "non_null_count", F.bround(pct, 2).alias("null_pct"),
        rules.fill_strategy(pct, F.col("kind"), skew).alias("suggested_strategy"),
        rules.null_advice(pct).alias("advice"), rules.null_advice_priority(pct).alias("priority"))


def medians(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    if not names:
        return {}
    found = quantiles.narrowed(df, {n: number(df, n) for n in names}, [0.5])
    return {n: found[n][0] for n in names}


def mode_of(df: DataFrame, name: str):
    """The most frequent non-null value; the smallest on ties."""
    value = present(df, name).alias("value")
    counted = df.select(value).filter(F.col("value").isNotNull()).groupBy("value").count()
    row = counted.orderBy(F.desc("count"), "value").first()
    return row["value"] if row else None


def scalar_fills(df: DataFrame, strategies: dict[str, str], fill_values: dict) -> dict[str, object]:
    """Fill values of the mean, median, mode and constant strategies."""
    numeric = {n for n in strategies if kind_of(df.schema[n].dataType) in ("numeric", "boolean")}
    means = [n for n, s in strategies.items() if s == "mean" and n in numeric]
    out: dict[str, object] = {}
    if means:
        row = df.agg(*[F.avg(number(df, n)).alias(f"m{i}") for i, n in enumerate(means)]).first()
        out |= {n: row[f"m{i}"] for i, n in enumerate(means)}
    out |= medians(df, [n for n, s in strategies.items() if s == "median" and n in numeric])
    out |= {n: mode_of(df, n) for n, s in strategies.items() if s == "mode"}
    out |= {n: fill_values.get(n, 0) for n, s in strategies.items() if s == "constant"}
    return {n: v for n, v in out.items() if v is not None}


def fill_scalars(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls replaced by one value per column; means and medians make it a double."""
    if not values:
        return df
    made = {}
    for name, value in values.items():
        data_type = df.schema[name].dataType
        widen = isinstance(value, float) and kind_of(data_type) in ("numeric", "boolean")
        base = number(df, name) if widen else present(df, name)
        made[name] = F.coalesce(base, F.lit(value).cast("double" if widen else data_type))
    return df.withColumns(made)


def apply_strategies(
    df: DataFrame, strategies: dict[str, str], key: str | list[str], p: NullParams = NullParams()
) -> tuple[DataFrame, dict[str, object]]:
    """The repaired table and the scalar fill values that were used."""
    known = {n: s for n, s in strategies.items() if n in df.columns}
    values = scalar_fills(df, known, p.fill_values)
    table = fill_scalars(df, values)
    keys = [key] if isinstance(key, str) else list(key)
    order_by = list(p.order_by) or keys
    table = table.drop(*[n for n, s in known.items() if s == "drop_column"])
    forward = [n for n, s in known.items() if s == "forward_fill"]
    backward = [n for n, s in known.items() if s == "backward_fill"]
    if forward:
        table = fills.forward_fill(table, forward, order_by)
    if backward:
        table = fills.backward_fill(table, backward, order_by)
    for name, strategy in known.items():
        if strategy == "knn_imputation" and kind_of(df.schema[name].dataType) == "numeric":
            table = knn_fill(table, name, keys[0], p.knn_neighbors)
    return table, values


def remaining_nulls(
    table: DataFrame, has_nulls: dict[str, int], strategies: dict[str, str], values: dict[str, object]
) -> dict[str, int]:
    """Nulls per column of the repaired table.

    A column filled with one value has none, an untouched one keeps its own;
    only order-dependent and nearest-donor fills have to be counted.
    """
    left = {n: c for n, c in has_nulls.items() if n in table.columns and n not in values}
    open_ended = [n for n in left if strategies.get(n) in ("forward_fill", "backward_fill", "knn_imputation")]
    if open_ended:
        left |= {r["column"]: r["null_count"] for r in column_facts(table, columns=open_ended).collect()}
    return left


def handle_nulls(df: DataFrame, key: str | list[str], p: NullParams = NullParams(), dataset: str = "table") -> HandledNulls:
    facts = as_local(column_facts(df, ("skew",)))
    analysis = as_local(null_analysis(facts))
    rows = facts.collect()
    n_before = rows[0]["row_count"] if rows else 0
    found = sum(r["null_count"] for r in rows)
    has_nulls = {r["column"]: r["null_count"] for r in rows if r["null_count"]}
    strategies = dict(p.strategies)
    if p.auto:
        strategies = {r["column"]: r["suggested_strategy"] for r in analysis.collect()} | strategies
    strategies = {n: s for n, s in strategies.items() if n in has_nulls}
    if p.drop_rows:
        table, values, strategies = df.na.drop("any"), {}, {}
        n_after, left = table.count(), {}
    else:
        table, values = apply_strategies(df, strategies, key, p)
        n_after = n_before
        left = remaining_nulls(table, has_nulls, strategies, values)
    log = [(dataset, n, s, has_nulls[n] - left.get(n, 0) if s != "drop_column" else has_nulls[n],
            None if n not in values else str(values[n])) for n, s in strategies.items()]
    if p.drop_rows:
        log.append((dataset, None, "drop_rows", n_before - n_after, None))
    actions = small_table(df.sparkSession, 
        log, "dataset string, column string, strategy string, cells_changed bigint, fill_value string")
    scores = cleaning_score(
        df.sparkSession, "nulls", found, sum(left.values()), n_before, n_after, len(df.columns),
        len(table.columns),
        (p.null_reduction_weight, p.data_retention_weight, p.column_retention_weight),
        (p.excellent_threshold, p.good_threshold),
        ("Fully Cleaned", "Well Cleaned", "Needs More Cleaning"), dataset)
    cells = issues.null_issues(df, key, list(has_nulls), "warning", dataset=dataset) if has_nulls else issues.empty_issues(df)
    return HandledNulls(table, analysis, actions, scores, cleaning_findings(scores, "nulls", dataset),
                        issues.reported(cells, p.issues_listed), issues.issue_summary(cells))

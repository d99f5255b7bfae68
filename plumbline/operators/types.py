"""Detect columns of the wrong type and convert them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats, text
from plumbline.functions.columns import col, columns_of, kind_of
from plumbline.operators import issues
from plumbline.operators.cleaning import cleaning_findings, cleaning_score
from plumbline.operators.facts import local_facts, number
from plumbline.params import TypeParams
from plumbline.sources.state import small_table


class FixedTypes(NamedTuple):
    table: DataFrame
    actions: DataFrame
    scores: DataFrame
    type_issues: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def type_shares(facts: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Share of numbers, dates and other text per column, and the type it should have."""
    n = F.col("non_null_count")
    numeric_pct = stats.percent(F.col("numeric_text"), n)
    date_pct = stats.percent(F.col("date_text"), n)
    is_text = F.col("kind") == "text"
    suggested = (
        F.when(n == 0, F.lit(None))
        .when(is_text & (numeric_pct > threshold), "numeric")
        .when(is_text & (date_pct > threshold), "datetime")
        .when(F.col("data_type").isin("double", "float") & F.col("whole_numbers"), "integer"))
    return facts.select(
        "column", "data_type", "kind", F.col("non_null_count"),
        F.when(is_text, numeric_pct).alias("numeric_pct"),
        F.when(is_text, date_pct).alias("date_pct"),
        F.when(is_text, 100.0 - numeric_pct - date_pct).alias("text_pct"),
        suggested.alias("suggested_type"))


def type_issues(shares: DataFrame) -> DataFrame:
    issue = (
        F.when(F.col("suggested_type") == "numeric", "text that holds numbers")
        .when(F.col("suggested_type") == "datetime", "text that holds dates")
        .otherwise("fractions that are all whole"))
    return shares.filter(F.col("suggested_type").isNotNull()).select(
        "column", F.col("data_type").alias("current_type"), "suggested_type", issue.alias("issue"),
        F.concat(F.lit("convert_to_"), "suggested_type").alias("action"), F.lit("medium").alias("priority"))


def converted(df: DataFrame, name: str, target: str):
    """The column as the target type; what does not convert becomes null."""
    c = col(name)
    kind = kind_of(df.schema[name].dataType)
    if target == "numeric":
        return text.to_number(c) if kind == "text" else c
    if target == "integer":
        return text.to_integer(c) if kind == "text" else text.whole(number(df, name))
    if target == "datetime":
        return text.to_timestamp(c) if kind == "text" else c.cast("timestamp")
    if target in ("string", "category"):
        return c.cast("string")
    raise ValueError(f"unknown target type {target!r}")


def apply_fixes(df: DataFrame, fixes: dict[str, str]) -> DataFrame:
    known = {n: t for n, t in fixes.items() if n in df.columns}
    return df.withColumns({n: converted(df, n, t) for n, t in known.items()}) if known else df


def numeric_text_issues(df: DataFrame, key: str | list[str], dataset: str = "table") -> DataFrame:
    """Cells of text columns that hold a number."""
    return issues.cell_issues(df, key, [
        issues.CellRule(n, "mixed_type", "warning", text.is_numeric_text(col(n)), value=col(n),
                        message=f"a number written as text in {n}")
        for n in columns_of(df, "text")], dataset)


def fix_types(df: DataFrame, key: str | list[str], p: TypeParams = TypeParams(), dataset: str = "table") -> FixedTypes:
    """The converted table (lazy) with its log, score and issues.

    An integer fix keeps a column as it is when some value is not whole.
    """
    facts_before = local_facts(df, ("shapes",))
    before = type_shares(facts_before, p.share_threshold)
    found = {r["column"]: r["suggested_type"] for r in before.collect() if r["suggested_type"]}
    fixes = {n: t for n, t in {**(found if p.auto else {}), **p.column_fixes}.items() if n in df.columns}
    known_whole = {r["column"] for r in facts_before.collect() if r["whole_numbers"]}
    fixes = _without_lossy_integers(df, fixes, known_whole)
    table = apply_fixes(df, fixes)
    facts_after = local_facts(table, ("shapes",)) if fixes else facts_before
    after = type_shares(facts_after, p.share_threshold)
    remaining = sum(1 for r in after.collect() if r["suggested_type"])
    nulls = {r["column"]: r["null_count"] for r in facts_before.collect()}
    log = [(dataset, r["column"], fixes[r["column"]], r["null_count"] - nulls[r["column"]], None)
           for r in facts_after.collect() if r["column"] in fixes]
    actions = small_table(
        df.sparkSession, log,
        "dataset string, column string, strategy string, cells_changed bigint, fill_value string")
    rows = facts_before.first()["row_count"]
    scores = cleaning_score(
        df.sparkSession, "types", len(found), remaining, rows, rows, len(df.columns), len(table.columns),
        (p.issue_reduction_weight, p.data_retention_weight, p.column_retention_weight),
        (p.excellent_threshold, p.good_threshold),
        ("Types Fixed", "Well Fixed", "Needs More Fixing"), dataset)
    cells = numeric_text_issues(df, key, dataset)
    return FixedTypes(table, actions, scores, type_issues(before), cleaning_findings(scores, "types", dataset),
                      issues.reported(cells, p.issues_listed), issues.issue_summary(cells))


def _without_lossy_integers(df: DataFrame, fixes: dict[str, str], known_whole: set[str]) -> dict[str, str]:
    integers = [n for n, t in fixes.items() if t == "integer" and n not in known_whole]
    if not integers:
        return fixes
    row = df.agg(*[
        F.count_if(col(n).isNotNull() & converted(df, n, "integer").isNull()).alias(f"n{i}")
        for i, n in enumerate(integers)]).first()
    lossy = {n for i, n in enumerate(integers) if row[f"n{i}"] > 0}
    return {n: t for n, t in fixes.items() if n not in lossy}

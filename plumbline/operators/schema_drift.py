"""Compare two tables' schemas and column constraints; compare two catalogs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, stats
from plumbline.operators import frequencies
from plumbline.operators.facts import column_facts
from plumbline.operators.scores import score_rows
from plumbline.params import SchemaDriftParams
from plumbline.sources.state import as_local, small_table


class SchemaDrift(NamedTuple):
    schema_changes: DataFrame
    scores: DataFrame
    recommendations: DataFrame
    findings: DataFrame


def schema_facts(df: DataFrame) -> DataFrame:
    """Type, nullability, distinct count and constraints per column, from the data."""
    facts = column_facts(df, ("range", "lengths"))
    distinct = frequencies.digest_counts(df).groupBy("column").agg(F.count("*").alias("distinct_count"))
    return facts.join(F.broadcast(distinct), "column", "left").select(
        "position", "column", "data_type",
        (F.col("null_count") > 0).alias("nullable"),
        "row_count", "null_count",
        stats.percent(F.col("null_count"), F.col("row_count")).alias("null_pct"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        stats.percent(F.coalesce("distinct_count", F.lit(0)), F.col("row_count")).alias("distinct_pct"),
        "min", "max", "mean", "min_length", "max_length")


def constraint_facts(df: DataFrame) -> DataFrame:
    """The part of ``schema_facts`` that the comparison needs: one scan, no shuffle of values."""
    return column_facts(df, ("range", "lengths")).withColumn("nullable", F.col("null_count") > 0)


def _differs(old, new, tolerance: float):
    if tolerance <= 0:
        return ~old.eqNullSafe(new)
    close = F.abs(old - new) <= tolerance * F.greatest(F.abs(old), F.abs(new))
    return F.coalesce(~close, ~old.eqNullSafe(new))


def schema_changes(baseline_facts: DataFrame, current_facts: DataFrame, p: SchemaDriftParams = SchemaDriftParams()) -> DataFrame:
    """One row per change, with the points it adds before weighting."""
    fields = ["data_type", "nullable", "min", "max", "mean", "min_length", "max_length"]
    b = baseline_facts.select("column", *[F.col(f).alias(f"b_{f}") for f in fields])
    c = current_facts.select("column", *[F.col(f).alias(f"c_{f}") for f in fields])
    both = b.join(c, "column", "full_outer")
    common = F.col("b_data_type").isNotNull() & F.col("c_data_type").isNotNull()
    compatibility = rules.type_compatibility(F.col("b_data_type"), F.col("c_data_type"))
    type_points = (
        F.when(compatibility == "incompatible", 50).when(compatibility == "downgrade", 30).otherwise(10))
    breaking = F.col("b_nullable") & ~F.col("c_nullable")
    constraint = F.lit(False)
    for f in fields[2:]:
        constraint = constraint | _differs(F.col(f"b_{f}"), F.col(f"c_{f}"), p.constraint_tolerance)

    def change(condition, kind, old, new, compat, impact, points):
        return F.when(condition, F.struct(
            F.lit(kind).alias("change"), old.cast("string").alias("baseline"),
            new.cast("string").alias("current"), compat.cast("string").alias("compatibility"),
            impact.cast("string").alias("impact"), points.cast("int").alias("points")))

    none = F.lit(None)
    made = F.array_compact(F.array(
        change(F.col("b_data_type").isNull(), "added", none, F.col("c_data_type"), none, F.lit("non-breaking"), F.lit(10)),
        change(F.col("c_data_type").isNull(), "removed", F.col("b_data_type"), none, none, F.lit("breaking"), F.lit(40)),
        change(common & (F.col("b_data_type") != F.col("c_data_type")), "type", F.col("b_data_type"),
               F.col("c_data_type"), compatibility,
               F.when(compatibility == "incompatible", "breaking").otherwise("non-breaking"), type_points),
        change(common & (F.col("b_nullable") != F.col("c_nullable")), "nullable", F.col("b_nullable"),
               F.col("c_nullable"), none, F.when(breaking, "breaking").otherwise("non-breaking"),
               F.when(breaking, 25).otherwise(5)),
        change(common & constraint, "constraint", none, none, none, F.lit("non-breaking"), F.lit(5))))
    return both.withColumn("x", F.explode(made)).select("column", "x.*")


def drift_score(changes: DataFrame, p: SchemaDriftParams = SchemaDriftParams(), dataset: str = "table") -> DataFrame:
    """Weighted impact, its parts and the drift level."""
    weights = {"added": p.added_columns_weight, "removed": p.removed_columns_weight,
               "type": p.type_changes_weight, "nullable": p.nullable_changes_weight,
               "constraint": p.constraint_changes_weight}
    row = changes.agg(*[
        F.coalesce(F.sum(F.when(F.col("change") == k, F.col("points"))), F.lit(0)).alias(k) for k in weights])
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    level = rules.banded(
        total, [(p.critical_drift_threshold, "critical"), (p.moderate_drift_threshold, "moderate")], "minimal")
    components = {"overall": F.bround(total, 1)} | {k: F.col(k) for k in weights}
    return score_rows(row, "schema_drift", components, level, dataset)


def recommendations(changes: DataFrame) -> DataFrame:
    """What to do, by priority."""
    kind, compat = F.col("change"), F.col("compatibility")
    priority = (
        F.when(kind == "removed", "critical")
        .when((kind == "type") & (compat == "incompatible"), "critical")
        .when((kind == "nullable") & (F.col("impact") == "breaking"), "high")
        .when(kind == "added", "medium")
        .when((kind == "type") & (compat == "compatible"), "low"))
    category = (
        F.when(priority.isin("critical", "high"), "breaking_change")
        .when(priority == "medium", "enhancement")
        .otherwise("optimization"))
    action = (
        F.when(kind == "removed", "Update dependent code or restore the column.")
        .when(priority == "critical", "Review conversions in consuming applications.")
        .when(priority == "high", "Ensure all sources provide values.")
        .when(priority == "medium", "Consider using the new column.")
        .otherwise("Update type annotations."))
    out = changes.select(priority.alias("priority"), category.alias("category"), "column", "change", action.alias("action"))
    return out.filter(F.col("priority").isNotNull())


def findings(changes: DataFrame, dataset: str = "table") -> DataFrame:
    kind = F.col("change")
    severity = (
        F.when(kind == "removed", "critical")
        .when((kind == "type") & (F.col("compatibility") == "incompatible"), "critical")
        .when(kind == "added", "warning"))
    out = changes.select(
        F.lit(dataset).alias("dataset"), "column", severity.alias("severity"),
        F.lit("schema_drift").alias("category"),
        F.concat(F.lit("column_"), kind).alias("type"),
        F.concat(F.lit("Schema change ("), kind, F.lit(") in column "), "column").alias("message"))
    return out.filter(F.col("severity").isNotNull())


def schema_drift(baseline: DataFrame, current: DataFrame, p: SchemaDriftParams = SchemaDriftParams(), dataset: str = "table") -> SchemaDrift:
    changes = as_local(schema_changes(constraint_facts(baseline), constraint_facts(current), p))
    return SchemaDrift(changes, drift_score(changes, p, dataset), recommendations(changes), findings(changes, dataset))


def catalog_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Added and dropped tables, and columns of common tables.

    Both sides are (table, column) rows, for example from an information schema.
    """
    b = baseline.select("table", "column").distinct().withColumn("b", F.lit(1))
    c = current.select("table", "column").distinct().withColumn("c", F.lit(1))
    both = b.join(c, ["table", "column"], "full_outer")
    per_table = both.groupBy("table").agg(F.max("b").alias("tb"), F.max("c").alias("tc"))
    tables = per_table.filter(F.col("tb").isNull() | F.col("tc").isNull()).select(
        "table", F.lit(None).cast("string").alias("column"),
        F.when(F.col("tb").isNull(), "table_added").otherwise("table_dropped").alias("change"))
    common = per_table.filter(F.col("tb").isNotNull() & F.col("tc").isNotNull()).select("table")
    cols = both.join(common, "table", "left_semi").filter(F.col("b").isNull() | F.col("c").isNull()).select(
        "table", "column",
        F.when(F.col("b").isNull(), "column_added").otherwise("column_dropped").alias("change"))
    return tables.unionByName(cols).withColumn("severity", F.lit("critical"))


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The (table, column, data_type) rows of a collection."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return small_table(spark, rows, "table string, column string, data_type string")

"""Threshold rules as ``when`` chains over facts that are already aggregated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import fixed


def banded(score: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first band whose lower limit the score reaches."""
    chain = F
    for limit, label in bands:
        chain = chain.when(score >= limit, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def null_advice(null_pct: Column) -> Column:
    return (
        F.when(null_pct > 70, "consider_dropping")
        .when(null_pct > 30, "advanced_imputation")
        .otherwise("simple_imputation")
    )


def null_advice_priority(null_pct: Column) -> Column:
    return F.when(null_pct > 70, "high").when(null_pct > 30, "medium").otherwise("low")


def fill_strategy(null_pct: Column, kind: Column, skew: Column) -> Column:
    """Suggested fill: by null share first, then by type and skewness."""
    return (
        F.when(null_pct > 70, "drop_column")
        .when(null_pct > 50, "knn_imputation")
        .when(kind.isin("numeric", "boolean"), F.when(F.abs(skew) > 1, "median").otherwise("mean"))
        .when(kind == "text", "mode")
        .when(kind == "temporal", "forward_fill")
        .otherwise("mode")
    )


def outlier_advice(outlier_pct: Column) -> Column:
    return (
        F.when(outlier_pct > 20, "review_data_quality")
        .when(outlier_pct > 5, "consider_removal")
        .otherwise("safe_to_remove")
    )


def outlier_advice_priority(outlier_pct: Column) -> Column:
    return F.when(outlier_pct > 20, "high").when(outlier_pct > 5, "medium").otherwise("low")


# The category of each type of alert.
ALERT_CATEGORIES = {
    "missing_values": "data_completeness",
    "only_nulls": "data_completeness",
    "outliers": "data_quality",
    "constant": "data_variance",
    "low_variance": "statistical_anomaly",
    "empty_table": "data_availability",
}


def alert_category(alert_type: Column) -> Column:
    """Category of an alert by its type."""
    known = F.create_map(*[F.lit(x) for pair in ALERT_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, alert_type), F.lit("general"))


def type_compatibility(old: Column, new: Column) -> Column:
    """identical, compatible, downgrade or incompatible."""
    upgrade = F.lit(False)
    downgrade = F.lit(False)
    for source, targets in fixed.COMPATIBLE_UPGRADES.items():
        upgrade = upgrade | ((old == source) & new.isin(targets))
        downgrade = downgrade | ((new == source) & old.isin(targets))
    return (
        F.when(old == new, "identical")
        .when(upgrade, "compatible")
        .when(downgrade, "downgrade")
        .otherwise("incompatible")
    )


def semantic_type(
    kind: Column, non_null: Column, total: Column, distinct: Column, parsed_dates: Column, p
) -> Column:
    """Semantic type of a column from its aggregated facts."""
    few = (distinct < p.categorical_threshold) | (
        distinct / total < p.categorical_ratio_threshold
    )
    return (
        F.when(non_null == 0, "Unknown")
        .when(kind == "boolean", "Categorical")
        .when(kind == "numeric", "Numeric")
        .when(kind == "temporal", "Temporal")
        .when((kind == "text") & (parsed_dates / non_null > p.temporal_share), "Temporal")
        .when((kind == "text") & ~few, "Free Text")
        .otherwise("Categorical")
    )


def iqr_severity(value: Column, low: Column, high: Column, iqr: Column, nearest: bool) -> Column:
    """critical when the distance to the fences exceeds three times the IQR.

    The distance is the larger of the two unless ``nearest`` is set.
    """
    to_low, to_high = F.abs(value - low), F.abs(value - high)
    distance = F.least(to_low, to_high) if nearest else F.greatest(to_low, to_high)
    return F.when(distance > 3.0 * iqr, "critical").otherwise("warning")

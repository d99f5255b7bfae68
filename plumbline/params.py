"""Operator parameters: one frozen dataclass per operator, with its defaults.

``issues_listed`` bounds the listed issues; summaries always count all of them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from plumbline.functions import fixed


@dataclass(frozen=True)
class ProfileParams:
    null_alert_threshold: float = 20.0
    categorical_threshold: int = 50
    categorical_ratio_threshold: float = 0.5
    temporal_share: float = 0.8
    top_n_values: int = 10
    outlier_iqr_multiplier: float = 1.5
    outlier_alert_threshold: float = 0.05
    null_rows_listed: int = 20
    outlier_rows_listed: int = 20
    duplicate_groups_listed: int = 10
    issues_listed: int = 100


@dataclass(frozen=True)
class ReadinessParams:
    ready_threshold: float = 85
    needs_review_threshold: float = 70
    completeness_weight: float = 0.4
    consistency_weight: float = 0.4
    schema_health_weight: float = 0.2
    sample_rows: int | None = None
    issues_listed: int = 100
    null_rows_listed: int = 20
    duplicate_rows_listed: int = 10


@dataclass(frozen=True)
class RiskParams:
    pii_sample_rows: int | None = None
    high_risk_threshold: float = 75
    medium_risk_threshold: float = 50
    low_risk_threshold: float = 25
    status_high: float = 75
    status_medium: float = 50
    pii_detection: bool = True
    sensitive_fields: bool = True
    governance_check: bool = True
    strict_ip: bool = False
    unicode_classes: bool = False
    rows_listed: int = 10
    issues_listed: int = 100


@dataclass(frozen=True)
class GovernanceParams:
    lineage_fields: tuple = tuple(fixed.LINEAGE_FIELDS)
    consent_fields: tuple = tuple(fixed.CONSENT_FIELDS)
    classification_fields: tuple = tuple(fixed.CLASSIFICATION_FIELDS)
    consent_statuses: tuple = tuple(fixed.CONSENT_STATUSES)
    data_classifications: tuple = tuple(fixed.DATA_CLASSIFICATIONS)
    sensitivity_levels: tuple = tuple(fixed.SENSITIVITY_LEVELS)
    lineage_weight: float = 0.3
    consent_weight: float = 0.4
    classification_weight: float = 0.3
    compliance_threshold: float = 80
    needs_review_threshold: float = 60
    lineage_null_threshold: float = 5
    rows_listed: int = 20
    pii_rows_listed: int = 10
    issues_listed: int = 100


@dataclass(frozen=True)
class CheckRules:
    unique: tuple = tuple(fixed.UNIQUE_COLUMNS)
    ranges: dict = field(default_factory=lambda: dict(fixed.RANGE_RULES))
    formats: dict = field(default_factory=lambda: dict(fixed.FORMAT_RULES))
    critical: tuple = ()
    check_duplicates: bool = True
    uniqueness_weight: float = 0.4
    range_weight: float = 0.3
    format_weight: float = 0.3
    excellent_threshold: float = 90
    good_threshold: float = 75
    issues_listed: int = 100


@dataclass(frozen=True)
class DriftParams:
    p_value_threshold: float = 0.05
    psi_alert: float = 0.1
    psi_critical: float = 0.25
    zero_share: float = 0.0001
    z_threshold: float = 2.0
    p_value_method: str = "asymptotic"
    categories_listed: int = 10
    rows_per_category: int = 5
    rows_listed: int = 20
    issues_listed: int = 100


@dataclass(frozen=True)
class SchemaDriftParams:
    added_columns_weight: float = 0.1
    removed_columns_weight: float = 0.4
    type_changes_weight: float = 0.3
    nullable_changes_weight: float = 0.15
    constraint_changes_weight: float = 0.05
    critical_drift_threshold: float = 50
    moderate_drift_threshold: float = 20
    constraint_tolerance: float = 0.0


@dataclass(frozen=True)
class NullParams:
    drop_rows: bool = False
    strategies: dict = field(default_factory=dict)
    fill_values: dict = field(default_factory=dict)
    auto: bool = False
    knn_neighbors: int = 5
    order_by: tuple = ()
    null_reduction_weight: float = 0.5
    data_retention_weight: float = 0.3
    column_retention_weight: float = 0.2
    excellent_threshold: float = 90
    good_threshold: float = 75
    issues_listed: int = 100


@dataclass(frozen=True)
class OutlierParams:
    method: str = "iqr"
    strategy: str = "remove"
    z_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    lower_percentile: float = 1.0
    upper_percentile: float = 99.0
    nearest_fence: bool = False
    rows_listed: int = 50
    outlier_reduction_weight: float = 0.5
    data_retention_weight: float = 0.3
    column_retention_weight: float = 0.2
    excellent_threshold: float = 90
    good_threshold: float = 75
    issues_listed: int = 100


@dataclass(frozen=True)
class TypeParams:
    column_fixes: dict = field(default_factory=dict)
    auto: bool = False
    share_threshold: float = 70.0
    issue_reduction_weight: float = 0.6
    data_retention_weight: float = 0.3
    column_retention_weight: float = 0.1
    excellent_threshold: float = 90
    good_threshold: float = 75
    issues_listed: int = 100


def effective(params) -> dict:
    """The parameters as plain text values, for the run record."""
    return {name: str(value) for name, value in asdict(params).items()}

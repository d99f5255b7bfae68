"""Governance checks: lineage, consent and classification columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, rules, text
from plumbline.functions.columns import col, columns_of, kind_of, missing_columns
from plumbline.operators import issues
from plumbline.operators.facts import present
from plumbline.operators.layout import aggregate_rows
from plumbline.operators.scores import score_rows
from plumbline.params import GovernanceParams
from plumbline.sources.state import as_local, small_table


class Governance(NamedTuple):
    scores: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def not_allowed(value: Column, allowed) -> Column:
    """A present value outside the vocabulary; null is missing, not invalid."""
    return value.isNotNull() & ~value.isin(*allowed)


def bad_source(value: Column) -> Column:
    return value.isNotNull() & ~value.rlike(fixed.SOURCE_SYSTEM_PATTERN)


def bad_date(df: DataFrame, name: str) -> Column:
    if kind_of(df.schema[name].dataType) == "temporal":
        return F.lit(False)
    value = col(name).cast("string")
    return value.isNotNull() & text.to_timestamp(value).isNull()


def _pii_hit(df: DataFrame, name: str) -> Column:
    hit = F.lit(False)
    for pii_type, pattern in fixed.GOVERNANCE_PII_PATTERNS.items():
        hit = hit | text.matches_pii(col(name), pii_type, pattern)
    return hit


def governance_facts(df: DataFrame, p: GovernanceParams = GovernanceParams()) -> DataFrame:
    """All counts the rules need, as (name, column, n) rows from one scan."""
    has = set(df.columns)
    counts: list[tuple[str, str | None, Column]] = [("rows", None, F.count("*"))]
    for name in p.lineage_fields:
        if name in has:
            counts.append(("lineage_null", name, F.count_if(present(df, name).isNull())))
    if "source_system" in has:
        counts.append(("bad_source", "source_system", F.count_if(bad_source(col("source_system")))))
    if "consent_status" in has:
        status = col("consent_status")
        counts.append(("bad_status", "consent_status",
                       F.count_if(not_allowed(status, p.consent_statuses))))
        counts.append(("withdrawn", "consent_status", F.count_if(status == "withdrawn")))
    if "consent_date" in has:
        counts.append(("bad_date", "consent_date", F.count_if(bad_date(df, "consent_date"))))
    if "data_classification" in has:
        value = col("data_classification")
        counts.append(("bad_classification", "data_classification",
                       F.count_if(not_allowed(value, p.data_classifications))))
        counts.append(("public", "data_classification", F.count_if(value == "public")))
    if "sensitivity_level" in has:
        counts.append(("bad_sensitivity", "sensitivity_level",
                       F.count_if(not_allowed(col("sensitivity_level"), p.sensitivity_levels))))
    for name in columns_of(df, "text"):
        counts.append(("pii", name, F.count_if(_pii_hit(df, name))))
    rows = [{"fact": fact, "column": name, "n": n} for fact, name, n in counts]
    return aggregate_rows(df, rows, {"fact": "string", "column": "string", "n": "bigint"})


def missing_fields(df: DataFrame, p: GovernanceParams = GovernanceParams()) -> DataFrame:
    """Required columns that the table does not have."""
    groups = {"lineage": p.lineage_fields, "consent": p.consent_fields,
              "classification": p.classification_fields}
    rows = [(g, c) for g, fields in groups.items() for c in missing_columns(df, fields)]
    return small_table(df.sparkSession, rows, "area string, column string")


def _row_count(facts: DataFrame) -> int:
    return facts.filter(F.col("fact") == "rows").first()["n"]


def governance_findings(
    facts: DataFrame, missing: DataFrame, p: GovernanceParams = GovernanceParams(),
    dataset: str = "table",
) -> DataFrame:
    """One row per violated rule with the points it costs."""
    absent = missing.groupBy("area").agg(
        F.count("*").alias("n"), F.concat_ws(", ", F.sort_array(F.collect_list("column"))).alias("columns"))
    per_field = F.when(F.col("area") == "consent", 25.0).otherwise(20.0)
    from_missing = absent.select(
        "area",
        F.concat(F.lit("missing_"), "area", F.lit("_fields")).alias("type"),
        F.lit("critical").alias("severity"),
        F.lit(None).cast("string").alias("column"),
        F.concat(F.lit("Missing required fields: "), "columns").alias("message"),
        (per_field * F.col("n")).alias("points"),
    )
    counted = facts.filter(F.col("fact") != "rows").withColumn("rows", F.lit(_row_count(facts)))
    null_pct = 100.0 * F.col("n") / F.col("rows")

    def rule(fact, area, kind, severity, points, condition=None):
        hit = (F.col("fact") == fact) & ((F.col("n") > 0) if condition is None else condition)
        return F.when(hit, F.struct(F.lit(area).alias("area"), F.lit(kind).alias("type"),
                                    F.lit(severity).alias("severity"),
                                    F.lit(points).cast("double").alias("points")
                                    if not isinstance(points, Column) else points.alias("points")))

    made = F.coalesce(
        rule("lineage_null", "lineage", "incomplete_lineage_data", "warning",
             F.least(F.lit(15.0), null_pct),
             (F.col("rows") > 0) & (null_pct > p.lineage_null_threshold)),
        rule("bad_source", "lineage", "invalid_source_format", "warning", 10.0),
        rule("bad_status", "consent", "invalid_consent_status", "critical", 15.0),
        rule("withdrawn", "consent", "withdrawn_consent_detected", "warning", 0.0),
        rule("bad_date", "consent", "invalid_consent_dates", "warning", 10.0),
        rule("bad_classification", "classification", "invalid_data_classification", "critical", 15.0),
        rule("bad_sensitivity", "classification", "invalid_sensitivity_level", "warning", 10.0),
    )
    from_values = counted.withColumn("r", made).filter(F.col("r").isNotNull()).select(
        F.col("r.area").alias("area"), F.col("r.type").alias("type"),
        F.col("r.severity").alias("severity"), "column",
        F.concat_ws(" ", F.col("column"), F.lit("rows:"), F.col("n").cast("string")).alias("message"),
        F.col("r.points").alias("points"),
    )
    # Any personal data in the table together with any public row costs points;
    # the row-exact form of this rule is in ``governance_issues``.
    mismatch = facts.agg(
        F.max(F.when((F.col("fact") == "pii") & (F.col("n") > 0), 1)).alias("pii"),
        F.max(F.when((F.col("fact") == "public") & (F.col("n") > 0), 1)).alias("public"),
        F.concat_ws(", ", F.sort_array(F.collect_list(
            F.when((F.col("fact") == "pii") & (F.col("n") > 0), F.col("column"))))).alias("columns"),
    ).filter((F.col("pii") == 1) & (F.col("public") == 1)).select(
        F.lit("classification").alias("area"), F.lit("pii_classification_mismatch").alias("type"),
        F.lit("critical").alias("severity"), F.lit(None).cast("string").alias("column"),
        F.concat(F.lit("PII beside public rows in: "), "columns").alias("message"),
        F.lit(20.0).alias("points"))
    return from_missing.unionByName(from_values).unionByName(mismatch).select(
        F.lit(dataset).alias("dataset"), "column", "severity",
        F.lit("governance_validation").alias("category"), "type", "message", "area", "points")


def governance_scores(
    findings: DataFrame, facts: DataFrame, p: GovernanceParams = GovernanceParams(),
    dataset: str = "table",
) -> DataFrame:
    def area(name):
        lost = F.coalesce(F.sum(F.when(F.col("area") == name, F.col("points"))), F.lit(0.0))
        return F.greatest(F.lit(0.0), 100.0 - lost).alias(name)

    row = findings.agg(area("lineage"), area("consent"), area("classification")).withColumn(
        "rows", F.lit(_row_count(facts)))
    empty = F.col("rows") == 0
    overall = F.when(empty, 0.0).otherwise(
        p.lineage_weight * F.col("lineage") + p.consent_weight * F.col("consent")
        + p.classification_weight * F.col("classification"))
    status = rules.banded(
        overall, [(p.compliance_threshold, "compliant"), (p.needs_review_threshold, "needs_review")],
        "non_compliant")
    components = {"overall": F.bround(overall, 1)} | {
        n: F.when(empty, 0.0).otherwise(F.bround(F.col(n), 4))
        for n in ("lineage", "consent", "classification")}
    return score_rows(row, "governance", components, status, dataset)


def public_pii_rules(df: DataFrame) -> list:
    """Personal data inside rows that are classified as public."""
    if "data_classification" not in df.columns:
        return []
    public = col("data_classification") == "public"
    return [
        issues.CellRule(
            name, "pii_in_public_data", "critical",
            public & text.matches_pii(col(name), pii_type, pattern),
            value=text.mask(col(name)), pii_type=pii_type,
            message=f"PII ({pii_type}) in publicly classified data, column '{name}'")
        for name in columns_of(df, "text") if name != "data_classification"
        for pii_type, pattern in fixed.GOVERNANCE_PII_PATTERNS.items()
    ]


def governance_issues(
    df: DataFrame, key: str | list[str], p: GovernanceParams = GovernanceParams(), dataset: str = "table"
) -> DataFrame:
    made = []
    for fields, kind in ((p.lineage_fields, "missing_lineage_data"),
                         (p.consent_fields, "missing_consent_data")):
        made += [
            issues.CellRule(n, kind, "critical", present(df, n).isNull(),
                            message=f"Missing required field '{n}'")
            for n in fields if n in df.columns
        ]
    for name, kind, allowed in (
        ("consent_status", "invalid_consent_status", p.consent_statuses),
        ("data_classification", "invalid_data_classification", p.data_classifications),
    ):
        if name in df.columns:
            made.append(issues.CellRule(name, kind, "critical", not_allowed(col(name), allowed),
                                        value=col(name), message=f"Value of '{name}' is not allowed"))
    return issues.cell_issues(df, key, made + public_pii_rules(df), dataset)


def governance(
    df: DataFrame, key: str | list[str], p: GovernanceParams = GovernanceParams(), dataset: str = "table"
) -> Governance:
    facts = as_local(governance_facts(df, p))
    findings = as_local(governance_findings(facts, missing_fields(df, p), p, dataset))
    found = governance_issues(df, key, p, dataset)
    if "row_key" in found.columns:
        pii = F.col("issue_type") == "pii_in_public_data"
        listed = issues.first_per_kind(found.filter(~pii), p.rows_listed).unionByName(
            issues.first_per_kind(found.filter(pii), p.pii_rows_listed))
    else:
        listed = found
    return Governance(
        governance_scores(findings, facts, p, dataset),
        findings.drop("area"),
        issues.reported(listed, p.issues_listed),
        issues.issue_summary(found),
    )

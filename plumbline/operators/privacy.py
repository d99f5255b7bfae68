"""Personal-data search, column risk scores and compliance tags."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules, text
from plumbline.functions.columns import sensitive_table
from plumbline.operators import issues
from plumbline.operators.layout import aggregate_rows, written_form
from plumbline.operators.sampling import first_non_null
from plumbline.operators.scores import score_rows, union_all
from plumbline.params import RiskParams
from plumbline.sources.state import as_local


class Risk(NamedTuple):
    column_risks: DataFrame
    scores: DataFrame
    findings: DataFrame
    issues: DataFrame
    issue_summary: DataFrame


def pii_matches(
    df: DataFrame,
    patterns: dict[str, str],
    columns: list[str] | None = None,
    sample_rows: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """(column, pii_type, matches) over whole columns, in one scan.

    With ``sample_rows`` only the first non-null values in key order are read.
    """
    names = columns or df.columns
    if sample_rows is not None:
        sample = first_non_null(df, names, sample_rows, order_by)
        counted = sample.groupBy("column").agg(
            *[F.count_if(text.matches_pii(F.col("value"), t, p)).alias(t) for t, p in patterns.items()]
        )
        return counted.unpivot(["column"], list(patterns), "pii_type", "matches")
    rows = [
        {"column": name, "pii_type": pii_type,
         "matches": F.count_if(text.matches_pii(written_form(df, name), pii_type, pattern))}
        for name in names
        for pii_type, pattern in patterns.items()
    ]
    return aggregate_rows(df, rows, {"column": "string", "pii_type": "string", "matches": "bigint"})


def column_risks(df: DataFrame, p: RiskParams = RiskParams(), order_by=None) -> DataFrame:
    """Risk points, level and reasons per column."""
    names = sensitive_table(df)
    patterns = text.risk_patterns(p.strict_ip, p.unicode_classes)
    if p.pii_detection:
        found = pii_matches(df, patterns, sample_rows=p.pii_sample_rows, order_by=order_by)
        hits = found.groupBy("column").agg(
            F.sort_array(F.collect_list(F.when(F.col("matches") > 0, F.col("pii_type")))).alias("pii_types")
        )
        joined = names.join(F.broadcast(hits), "column", "left")
    else:
        joined = names.withColumn("pii_types", F.array().cast("array<string>"))
    sensitive = F.col("sensitive_term").isNotNull() & F.lit(p.sensitive_fields)
    flagged = joined.withColumns({
        "pii_types": F.coalesce("pii_types", F.array().cast("array<string>")),
        "is_sensitive": sensitive,
    })
    pii = F.size("pii_types") > 0
    gap = (pii | F.col("is_sensitive")) & ~F.col("tracks_consent") & F.lit(p.governance_check)
    scored = flagged.withColumns({
        "pii_detected": pii,
        "governance_gap": gap,
        "risk_score": F.when(F.col("is_sensitive"), 20).otherwise(0)
        + 30 * F.size("pii_types")
        + F.when(gap, 15).otherwise(0),
    })
    level = rules.banded(
        F.col("risk_score"),
        [(p.high_risk_threshold, "critical"), (p.medium_risk_threshold, "high"),
         (p.low_risk_threshold, "medium")],
        "low",
    )
    summary = (
        F.when(pii, F.concat(F.lit("PII detected: "), F.concat_ws(", ", "pii_types")))
        .when(F.col("is_sensitive"), "Sensitive field detected")
        .when(gap, "Governance gaps: 1 issue(s)")
        .otherwise("No significant risks detected")
    )
    return scored.select(
        "column", "risk_score", level.alias("risk_level"), "pii_detected",
        F.concat_ws(",", "pii_types").alias("pii_types"), "is_sensitive", "sensitive_term",
        "governance_gap", summary.alias("summary"),
    )


def risk_scores(risks: DataFrame, p: RiskParams = RiskParams(), dataset: str = "table") -> DataFrame:
    """Mean column score, flag counts, status and the weighted share composite."""
    exposed = F.col("pii_detected") | F.col("is_sensitive")
    row = risks.agg(
        F.coalesce(F.bround(F.avg("risk_score")), F.lit(0.0)).alias("overall"),
        F.count_if("pii_detected").alias("pii_fields"),
        F.count_if("is_sensitive").alias("sensitive_fields"),
        F.count_if("governance_gap").alias("governance_gaps"),
        F.count_if(exposed).alias("exposed_fields"),
        F.count("*").alias("fields"),
    )
    overall = F.col("overall")
    status = (
        F.when((overall >= p.status_high) | (F.col("pii_fields") > 0), "High Risk")
        .when((overall >= p.status_medium) | (F.col("governance_gaps") > 0), "Medium Risk")
        .otherwise("Low Risk")
    )
    share = {n: 100.0 * F.col(n) / F.col("fields") for n in ("pii_fields", "sensitive_fields")}
    gap_share = F.when(F.col("exposed_fields") > 0,
                       100.0 * F.col("governance_gaps") / F.col("exposed_fields")).otherwise(0.0)
    components = {
        "overall": overall,
        "pii_fields": F.col("pii_fields"),
        "sensitive_fields": F.col("sensitive_fields"),
        "governance_gaps": F.col("governance_gaps"),
        "weighted_share": F.bround(
            0.4 * share["pii_fields"] + 0.3 * share["sensitive_fields"] + 0.3 * gap_share, 1),
        "governance_coverage_pct": F.bround(100.0 - gap_share, 1),
    }
    return score_rows(row, "risk", components, status, dataset)


def pii_rules(df: DataFrame, patterns: dict[str, str], columns: list[str] | None = None) -> list:
    return [
        issues.CellRule(
            name, "pii_detected", "critical", text.matches_pii(written_form(df, name), pii_type, pattern),
            value=text.mask(written_form(df, name)), pii_type=pii_type,
            message=f"PII detected ({pii_type}) in column '{name}'")
        for name in (columns or df.columns)
        for pii_type, pattern in patterns.items()
    ]


def column_issues(risks: DataFrame, dataset: str = "table") -> DataFrame:
    """Sensitive columns and governance gaps: issues without a row."""
    made = F.array_compact(F.array(
        F.when(F.col("is_sensitive"), F.struct(
            F.lit("sensitive_field").alias("issue_type"), F.lit("high").alias("severity"),
            F.concat(F.lit("Column '"), "column", F.lit("' contains sensitive data")).alias("message"))),
        F.when(F.col("governance_gap"), F.struct(
            F.lit("governance_gap").alias("issue_type"), F.lit("warning").alias("severity"),
            F.concat(F.lit("Column '"), "column",
                     F.lit("' has sensitive or personal data without consent tracking")).alias("message"))),
    ))
    return risks.withColumn("i", F.explode(made)).select(
        F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("row_id"), "column",
        F.col("i.issue_type").alias("issue_type"), F.lit(None).cast("string").alias("pii_type"),
        F.col("i.severity").alias("severity"), F.lit(None).cast("string").alias("value"),
        F.col("i.message").alias("message"))


def risk_findings(risks: DataFrame, dataset: str = "table") -> DataFrame:
    alerts = risks.filter(F.col("risk_level").isin("critical", "high")).select(
        F.lit(dataset).alias("dataset"), "column", F.col("risk_level").alias("severity"),
        F.lit("risk_assessment").alias("category"), F.lit("column_risk").alias("type"),
        F.col("summary").alias("message"))
    found = risks.filter("pii_detected").select(
        F.lit(dataset).alias("dataset"), "column", F.col("risk_level").alias("severity"),
        F.lit("pii_detection").alias("category"), F.lit("pii_types").alias("type"),
        F.concat(F.lit("PII detected: "), "pii_types").alias("message"))
    return alerts.unionByName(found)


def risk(df: DataFrame, key: str | list[str], p: RiskParams = RiskParams(), dataset: str = "table") -> Risk:
    """Risk per column and table; only columns with hits are searched for rows."""
    order_by = [key] if isinstance(key, str) else key
    risks = as_local(column_risks(df, p, order_by))
    patterns = text.risk_patterns(p.strict_ip, p.unicode_classes)
    hit = {r["column"]: r["pii_types"].split(",") for r in risks.collect() if r["pii_detected"]}
    made = [
        rule
        for name, types in hit.items()
        for rule in pii_rules(df, {t: patterns[t] for t in types}, [name])
    ]
    found = issues.cell_issues(df, key, made, dataset)
    listed = issues.first_per_kind(found, p.rows_listed) if made else found
    by_column = column_issues(risks, dataset)
    return Risk(
        risks.select(F.lit(dataset).alias("dataset"), *risks.columns),
        risk_scores(risks, p, dataset),
        risk_findings(risks, dataset),
        issues.reported(union_all([listed, by_column]), p.issues_listed),
        issues.issue_summary(found.select(*issues.FIELDS).unionByName(by_column)),
    )


def tag_compliance(df: DataFrame, columns: list[str] | None = None, p: RiskParams = RiskParams()) -> DataFrame:
    """The rows with ``pii_types`` found in them and ``contains_pii``. All columns are searched, numbers in written form."""
    names = columns or df.columns
    patterns = text.risk_patterns(p.strict_ip, p.unicode_classes)
    hits = [
        F.when(
            F.coalesce(
                *[F.when(text.matches_pii(written_form(df, n), t, pattern), F.lit(True)) for n in names],
                F.lit(False),
            ),
            F.lit(t),
        )
        for t, pattern in patterns.items()
    ]
    tagged = df.withColumn("pii_types", F.concat_ws(",", *hits))
    return tagged.withColumn("contains_pii", F.col("pii_types") != "")


def column_tags(risks: DataFrame) -> DataFrame:
    """Suggested classification per column from its risk."""
    return risks.select(
        "column", "pii_types", "is_sensitive",
        F.when(F.col("pii_detected") & F.col("is_sensitive"), "restricted")
        .when(F.col("pii_detected") | F.col("is_sensitive"), "confidential")
        .otherwise("internal")
        .alias("suggested_classification"),
    )

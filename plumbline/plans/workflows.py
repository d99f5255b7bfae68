"""Multi-step plans over tables, digests of findings and run records."""

from __future__ import annotations

import datetime as dt
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline
from plumbline.operators import drift as drift_ops
from plumbline.operators import master, privacy
from plumbline.operators import profile as profile_ops
from plumbline.operators import readiness as readiness_ops
from plumbline.operators.scores import side_by_side, union_all
from plumbline.params import DriftParams, ProfileParams, ReadinessParams, RiskParams, effective
from plumbline.sources.state import as_local, small_table

FINDING_FIELDS = ["dataset", "column", "severity", "category", "type", "message"]


class ProfileReport(NamedTuple):
    scores: DataFrame
    steps: DataFrame
    column_profile: DataFrame | None
    drift: DataFrame | None
    findings: DataFrame
    status: DataFrame


class MasterReport(NamedTuple):
    table: DataFrame
    report: DataFrame
    column_tags: DataFrame | None
    findings: DataFrame | None
    steps: DataFrame


def over_tables(tables: dict[str, DataFrame], operator: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """One operator over every table of a collection, results in one table."""
    return union_all([operator(name, df) for name, df in tables.items()])


def findings_digest(findings: DataFrame) -> DataFrame:
    """Counts by severity and the texts of the serious findings."""
    serious = F.col("severity").isin("critical", "warning", "high")
    text = F.concat_ws(" | ", "column", "message")
    return findings.groupBy("severity").agg(
        F.count("*").alias("count"),
        F.sort_array(F.collect_list(F.when(serious, text))).alias("messages"))


def run_record(
    spark: SparkSession, operator: str, dataset: str, columns: list[str], params, started: dt.datetime,
    seconds: float | None = None,
) -> DataFrame:
    """One row about a run: operator, version, time, fields and effective parameters."""
    row = [(operator, plumbline.__version__, dataset, started, seconds, columns, effective(params))]
    return small_table(spark, 
        row, "operator string, version string, dataset string, started timestamp, seconds double, "
             "fields array<string>, parameters map<string,string>")


def profile_workflow(
    df: DataFrame, key: list[str], baseline: DataFrame | None = None, dataset: str = "table",
    stop_below: float = 70, readiness_params: ReadinessParams = ReadinessParams(),
    profile_params: ProfileParams = ProfileParams(), drift_params: DriftParams = DriftParams(),
) -> ProfileReport:
    """Readiness; stop if it is too low; else profile, and drift when a baseline is given."""
    spark = df.sparkSession
    health = as_local(readiness_ops.health_facts(df))
    facts = as_local(readiness_ops.readiness_facts(df, readiness_params, key, health))
    scores = as_local(readiness_ops.readiness_scores(facts, readiness_params, dataset))
    status = scores.filter(F.col("component") == "overall").select("dataset", "status", F.col("score").alias("readiness_score"))
    overall = status.first()["readiness_score"]
    steps = [(1, "readiness", "done")]
    found = readiness_ops.readiness_findings(
        scores, readiness_ops.deductions(df, facts, health, dataset))
    if overall < stop_below:
        steps += [(2, "profile", "stopped"), (3, "drift", "stopped")]
        return ProfileReport(scores, _steps(spark, steps), None, None, found.select(*FINDING_FIELDS), status)
    listed = profile_ops.columns_of(df, "text", "boolean", "other")
    spread, top = None, small_table(spark, [], "column string, rank int, value string, count bigint")
    if listed:
        counts = profile_ops.frequencies.digest_counts(df, listed)
        spread, top = profile_ops.frequencies.spread_and_top(counts, 1)
    columns = as_local(profile_ops.column_profile(df, profile_params, dataset, spread=spread))
    found = found.select(*FINDING_FIELDS).unionByName(
        profile_ops.profile_alerts(columns, top, profile_params).select(*FINDING_FIELDS))
    steps.append((2, "profile", "done"))
    drift = None
    if baseline is not None:
        drift = as_local(drift_ops.drift_table(baseline, df, drift_params))
        found = found.unionByName(drift_ops.drift_findings(drift, dataset).select(*FINDING_FIELDS))
    steps.append((3, "drift", "done" if baseline is not None else "skipped"))
    return ProfileReport(scores, _steps(spark, steps), columns.select(*profile_ops.PROFILE_FIELDS), drift, found, status)


def _steps(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return small_table(spark, rows, "step int, name string, state string")


def master_workflow(
    df: DataFrame, record_id: str, keys: dict[str, str], source_system: str = "UNKNOWN_SYSTEM",
    tagged_at: str | None = None, dedup_on: list[str] | None = None,
    risk_params: RiskParams = RiskParams(), dataset: str = "table",
    stop_when: dict[str, Callable[[DataFrame], bool]] | None = None,
) -> MasterReport:
    """Tag the source, resolve entities, deduplicate and tag compliance.

    Rows count as duplicates when they agree in ``dedup_on`` (by default in all
    columns but the record id).  ``stop_when`` holds conditions by step name
    (tag_source, resolve_entities, deduplicate, tag_compliance); one that is met
    by the step's table ends the workflow with that table, and without tags.
    """
    same = dedup_on or [c for c in df.columns if c != record_id]
    plan = [
        ("tag_source", lambda t: master.tag_source(t, source_system, tagged_at)),
        ("resolve_entities", lambda t: master.resolve_entities(t, keys, record_id)),
        ("deduplicate", lambda t: master.deduplicate(t, same, [record_id])),
        ("tag_compliance", lambda t: privacy.tag_compliance(t, p=risk_params)),
    ]
    table, steps = df, []
    for i, (name, step) in enumerate(plan, 1):
        if steps and steps[-1][2] != "done":
            steps.append((i, name, "skipped"))
            continue
        table = step(table)
        stop = (stop_when or {}).get(name)
        steps.append((i, name, "stopped" if stop is not None and stop(table) else "done"))
    steps = _steps(df.sparkSession, steps)
    if "contains_pii" not in table.columns:
        report = side_by_side([df.agg(F.count("*").alias("original_rows")), table.agg(F.count("*").alias("rows"))])
        return MasterReport(table, report.select(F.lit(dataset).alias("dataset"), "original_rows", "rows"), None, None, steps)
    risks = as_local(privacy.column_risks(df, risk_params, [record_id]))
    counts = table.agg(
        F.count("*").alias("unique_rows"),
        F.countDistinct("entity_id").alias("entities"),
        F.count_if("contains_pii").alias("pii_rows"))
    before = df.agg(F.count("*").alias("original_rows"))
    report = side_by_side([before, counts]).select(
        F.lit(dataset).alias("dataset"), "original_rows", "unique_rows",
        (F.col("original_rows") - F.col("unique_rows")).alias("removed_rows"), "entities", "pii_rows")
    return MasterReport(table, report, privacy.column_tags(risks), privacy.risk_findings(risks, dataset), steps)

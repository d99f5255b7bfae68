"""Profile, readiness, rule checks, risk and governance on small planted defects."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.columns import sensitive_term, tracks_consent
from plumbline.operators import checks, governance, issues, privacy, profile, readiness
from plumbline.operators.facts import column_facts
from plumbline.params import CheckRules, GovernanceParams, ReadinessParams, RiskParams


@pytest.fixture(scope="module")
def widgets(spark):
    """Mixed ids, half-empty columns, a constant column and one duplicate row."""
    rows = [
        (1, "P-543", "2023-01-01", 10.0, None, True), (2, "789", "2023-01-02", 11.0, "SAVE", True),
        (3, "P-100", "2023-01-05", 12.0, None, True), (4, "P-101", "01/09/2023", 900.0, "SAVE", True),
        (5, "P-102", "2023-01-11", 10.5, None, True), (6, "P-543", "2023-01-01", 10.0, None, True),
    ]
    return spark.createDataFrame(rows, "id int, product string, day string, price double, coupon string, sale boolean")


def test_semantic_types_and_statistics(widgets):
    found = {r["column"]: r for r in profile.column_profile(widgets).collect()}
    kinds = {c: r["semantic_type"] for c, r in found.items()}
    assert kinds == {"id": "Numeric", "product": "Categorical", "day": "Temporal", "price": "Numeric",
                     "coupon": "Categorical", "sale": "Categorical"}
    assert found["price"]["outlier_count"] == 1 and found["price"]["median"] == 10.75
    assert found["day"]["span_days"] == 10 and str(found["day"]["latest"]) == "2023-01-11 00:00:00"
    assert found["coupon"]["null_pct"] == pytest.approx(66.7) and found["coupon"]["distinct_count"] == 1


def test_free_text_and_unknown(spark):
    df = spark.range(60).select(F.concat(F.lit("text "), "id").alias("t"), F.lit(None).cast("string").alias("n"))
    kinds = {r["column"]: r["semantic_type"] for r in profile.column_profile(df).collect()}
    assert kinds == {"t": "Free Text", "n": "Unknown"}


def test_profile_findings_issues_and_status(widgets):
    found = profile.profile(widgets, "id")
    messages = [(r["column"], r["category"], r["severity"]) for r in found.findings.collect()]
    assert ("coupon", "data_completeness", "warning") in messages
    assert ("price", "data_quality", "warning") in messages
    assert ("sale", "data_variance", "info") in messages
    assert found.status.first()["status"] == "Needs Review"
    kinds = {r["issue_type"] for r in found.issues.collect()}
    assert kinds == {"null_value", "outlier", "constant_column"}
    totals = {r["key"]: r["count"] for r in found.issue_summary.filter("dimension = 'issue_type'").collect()}
    assert totals["null_value"] == 4 and totals["outlier"] == 1


def test_listed_issues_are_limited_but_counted_in_full(spark):
    df = spark.range(500).select("id", F.lit(None).cast("double").alias("x"))
    found = profile.profile(df, "id")
    assert found.issues.filter("issue_type = 'null_value'").count() == 20
    assert [r["row_id"] for r in found.issues.collect()][:3] == ["0", "1", "2"]
    assert found.issue_summary.filter("dimension = 'total'").first()["count"] == 500


def test_empty_table_needs_review(spark):
    df = spark.createDataFrame([], "id int, t string")
    assert profile.profile(df, "id").status.first()["status"] == "Needs Review"


def test_quartiles_are_exact(spark):
    df = spark.range(3000).select((F.hash("id") % 1000 / 7).alias("x"), (F.col("id") % 5).alias("y"))
    found = {r["column"]: r for r in column_facts(df, ("quartiles",)).collect()}
    for name in found:
        wanted = df.selectExpr(f"percentile({name}, array(0.25D, 0.5D, 0.75D)) AS q").first()["q"]
        assert [found[name][q] for q in ("p25", "median", "p75")] == pytest.approx(wanted)


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").toDF("a.b", "it's ` odd\\")
    found = {r["column"]: r["null_count"] for r in column_facts(df, ("range",)).collect()}
    assert found == {c: n for c, n in zip(df.columns, (0, 1))}


def test_readiness_scores_by_hand(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (2, None, "k"), (3, "7", "k")]
    df = spark.createDataFrame(rows, "id int, t string, c string")
    facts = readiness.readiness_facts(df)
    scores = {r["component"]: r for r in readiness.readiness_scores(facts).collect()}
    # 1 of 12 cells is null, 1 of 4 rows is a copy, one constant and one mixed column.
    assert scores["completeness"]["score"] == 92 and scores["consistency"]["score"] == 75
    assert scores["schema_health"]["score"] == 85
    assert scores["overall"]["score"] == round(0.4 * (100 - 100 / 12) + 0.4 * 75 + 0.2 * 85)
    assert scores["overall"]["status"] == "Needs Review"


def test_readiness_of_an_empty_table_is_zero(spark):
    df = spark.createDataFrame([], "id int, t string")
    scores = readiness.readiness_scores(readiness.readiness_facts(df)).collect()
    assert {r["score"] for r in scores} == {0.0}


def test_readiness_sample_looks_at_first_values_only(spark):
    df = spark.range(10).select("id", F.when(F.col("id") == 9, "12").otherwise("x").alias("t"))
    assert readiness.readiness_facts(df).first()["mixed_columns"] == 1
    assert readiness.readiness_facts(df, ReadinessParams(sample_rows=5), ["id"]).first()["mixed_columns"] == 0


def test_checks_by_hand(spark):
    rows = [(1, "a@b.org", 10), (1, "bad", 200), (3, None, None), (None, "c@d.org", -1), (None, "e@f.org", 5)]
    df = spark.createDataFrame(rows, "id int, email string, age int")
    rules = CheckRules(unique=("id", "nope"), ranges={"age": (0, 120), "email": (0, 1)},
                       formats={"email": CheckRules().formats["email"], "age": "(oops"}, critical=("age",))
    found = {(r["column"], r["test_type"]): r for r in checks.all_checks(df, rules).collect()}
    assert found["id", "uniqueness"]["violations"] == 2  # one repeated 1, one repeated null
    assert found["age", "range"]["violations"] == 2 and found["age", "range"]["total"] == 4
    assert found["email", "format"]["violations"] == 1 and found["email", "format"]["total"] == 4
    assert found["nope", "uniqueness"]["problem"] == "missing_column"
    assert found["email", "range"]["problem"] == "non_numeric" and found["age", "format"]["problem"] == "invalid_pattern"
    scores = {r["component"]: r["score"] for r in checks.run_checks(df, "id", rules).scores.collect()}
    assert scores["uniqueness"] == 100 - 20 - 25 and scores["range"] == 100 - 10 - 20
    assert scores["format"] == 100 - 5 - 15
    assert scores["tests_executed"] == 3 and scores["tests_passed"] == 0


def test_no_rules_score_one_hundred(spark):
    df = spark.createDataFrame([(1,)], "id int")
    rules = CheckRules(unique=(), ranges={}, formats={})
    scores = {r["component"]: r["score"] for r in checks.check_scores(checks.all_checks(df, rules), rules).collect()}
    assert scores["overall"] == 100


@pytest.mark.parametrize("value,types", [
    ("mail me: joe.doe@mail.example.org!", {"email"}),
    ("call 555-123-4567", {"phone"}), ("call +1 (555) 123-4567", {"phone"}), ("call 123-4567", set()),
    ("123-45-6789", {"ssn"}), ("4111 1111 1111 1111", {"credit_card"}),
    ("version 1.2.3.4", {"ip_address"}), ("300.1.1.1", {"ip_address"}), ("AB1234567", {"passport"}), (None, set())])
def test_pii_patterns(spark, value, types):
    df = spark.createDataFrame([(value,)], "t string")
    hits = {r["pii_type"] for r in privacy.pii_matches(df, text.risk_patterns()).collect() if r["matches"]}
    assert types <= hits and (types or not hits)


def test_numbers_are_searched_as_people_write_them(spark):
    df = spark.createDataFrame([(5551234567.0,), (1.5,), (1e300,)], "x double")
    shown = [r["t"] for r in df.select(text.plain_number(F.col("x")).alias("t")).collect()]
    assert shown == ["5551234567.0", "1.5", "1.0E300"]
    assert {r["pii_type"] for r in privacy.pii_matches(df, text.risk_patterns()).collect() if r["matches"]} == {"phone"}


def test_strict_ip_option(spark):
    df = spark.createDataFrame([("300.1.1.1",), ("10.0.0.255",)], "t string")
    counted = {r["pii_type"]: r["matches"] for r in privacy.pii_matches(df, text.risk_patterns(strict_ip=True)).collect()}
    assert counted["ip_address"] == 1


def test_sensitive_names():
    assert sensitive_term("Salary_2020") == "salary" and sensitive_term("ssn_token") == "ssn"
    assert sensitive_term("DateOfBirth") is None
    assert tracks_consent("email_opt_in") and not tracks_consent("email")


def test_risk_points_and_levels(spark):
    rows = [(1, "a@b.org 123-45-6789", 5.0, "a@b.org"), (2, "x", 6.0, "y")]
    df = spark.createDataFrame(rows, "id int, note string, salary double, consent_mail string")
    found = privacy.risk(df, "id")
    risks = {r["column"]: r for r in found.column_risks.collect()}
    assert risks["note"]["risk_score"] == 75 and risks["note"]["risk_level"] == "critical"
    assert risks["salary"]["risk_score"] == 35 and risks["salary"]["risk_level"] == "medium"
    assert risks["consent_mail"]["risk_score"] == 30 and not risks["consent_mail"]["governance_gap"]
    assert risks["id"]["risk_score"] == 0
    scores = {r["component"]: r for r in found.scores.collect()}
    assert scores["overall"]["score"] == round((75 + 35 + 30) / 4) and scores["overall"]["status"] == "High Risk"
    listed = {(r["column"], r["pii_type"], r["value"]) for r in found.issues.collect() if r["issue_type"] == "pii_detected"}
    assert ("note", "ssn", "a@b***") in listed
    by_type = {r["key"]: r["count"] for r in found.issue_summary.filter("dimension = 'issue_type'").collect()}
    assert by_type == {"pii_detected": 3, "sensitive_field": 1, "governance_gap": 2}


def test_risk_options_switch_parts_off(spark):
    df = spark.createDataFrame([("a@b.org", 1.0)], "mail string, salary double")
    off = RiskParams(pii_detection=False, sensitive_fields=False)
    assert {r["risk_score"] for r in privacy.column_risks(df, off).collect()} == {0}


def test_pii_is_found_beyond_the_sample_size(spark):
    df = spark.range(300).select("id", F.when(F.col("id") == 250, "a@b.org").otherwise("x").alias("t"))
    assert {r["pii_detected"] for r in privacy.column_risks(df.select("t")).collect()} == {True}
    sampled = privacy.column_risks(df, RiskParams(pii_sample_rows=100), ["id"]).collect()
    assert not any(r["pii_detected"] for r in sampled)


def test_governance_without_any_governance_column(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    scores = {r["component"]: r for r in governance.governance(df, "id").scores.collect()}
    assert (scores["lineage"]["score"], scores["consent"]["score"], scores["classification"]["score"]) == (40, 25, 40)
    assert scores["overall"]["status"] == "non_compliant"


def test_null_is_missing_and_not_invalid(spark):
    df = spark.createDataFrame([(1, None), (2, "granted"), (3, "other")], "id int, consent_status string")
    found = governance.governance(df, "id")
    kinds = {(r["row_id"], r["issue_type"]) for r in found.issues.collect()}
    assert kinds == {("1", "missing_consent_data"), ("3", "invalid_consent_status")}


def test_public_mismatch_by_table_for_the_score_and_by_row_for_the_issues(spark):
    rows = [(1, "public", "nothing"), (2, "internal", "a@b.org")]
    df = spark.createDataFrame(rows, "id int, data_classification string, t string")
    found = governance.governance(df, "id", GovernanceParams())
    assert "pii_classification_mismatch" in {r["type"] for r in found.findings.collect()}
    assert found.issues.count() == 0


def test_issue_summary_of_all_dimensions(spark):
    df = spark.createDataFrame([(1, None, "a@b.org"), (2, 3, None)], "id int, x int, t string")
    made = [issues.CellRule("t", "pii_detected", "critical", F.col("t").contains("@"), F.col("t"), pii_type="email"),
            issues.CellRule("x", "null_value", "info", F.col("x").isNull())]
    found = {(r["dimension"], r["key"]): r["count"] for r in issues.issue_summary(issues.cell_issues(df, "id", made)).collect()}
    assert found == {("issue_type", "pii_detected"): 1, ("issue_type", "null_value"): 1, ("severity", "critical"): 1,
                     ("severity", "info"): 1, ("column", "t"): 1, ("column", "x"): 1, ("pii_type", "email"): 1, ("total", "all"): 2}


def test_patterns_are_those_of_spark(spark):
    from plumbline.operators import checks

    assert checks.valid_pattern(spark, r"\p{L}+") and not checks.valid_pattern(spark, "(x") and not checks.valid_pattern(spark, "(?P<x>a)")


def test_numbers_are_searched_for_personal_data(spark):
    df = spark.createDataFrame([(1, 2025550123), (2, 7)], "id int, phone bigint")
    found = {r["id"]: r["contains_pii"] for r in privacy.tag_compliance(df).collect()}
    assert found == {1: True, 2: False}


def test_row_issues_come_in_key_order(spark):
    from plumbline.operators import checks
    from plumbline.params import CheckRules

    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(30)], "id int, c string")
    rules = CheckRules(unique=(), ranges={}, formats={}, critical=("c",), check_duplicates=False, issues_listed=7)
    assert [r["row_id"] for r in checks.run_checks(df, "id", rules).issues.collect()] == ["1", "3", "5", "7", "9", "11", "13"]

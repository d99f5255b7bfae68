"""Filters and predicates: nulls, ranges, formats, vocabularies, personal data, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed, text
from plumbline.functions.columns import sensitive_table
from plumbline.operators import checks, drift, frequencies, governance, issues, outliers, privacy, types
from plumbline.operators.facts import column_facts, local_facts, present
from plumbline.params import CheckRules, DriftParams, OutlierParams
from plumbline.plans.catalogue.aggregates import _PII
from plumbline.plans.catalogue.registry import query, table, union_sql, view


@query("f1_null_cells", "SELECT o_orderkey FROM orders_nulls WHERE o_totalprice IS NULL", ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    return df.filter(present(df, "o_totalprice").isNull()).select("o_orderkey")


@query("f2_rows_without_nulls", "SELECT * FROM orders_nulls WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL", ["orders_nulls"])
def _(spark, d):
    return view(spark, d, "orders_nulls").na.drop("any")


@query("f3_range_checks", """
    SELECT 'o_totalprice' AS "column", count(o_totalprice) AS total,
           count(*) FILTER (WHERE o_totalprice < 5000) + count(*) FILTER (WHERE o_totalprice > 400000) AS violations,
           round_even((count(*) FILTER (WHERE o_totalprice < 5000) + count(*) FILTER (WHERE o_totalprice > 400000)) * 100.0 / count(o_totalprice), 2) AS violation_pct
    FROM orders_nulls
    UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) FILTER (WHERE o_custkey < 10),
           round_even(count(*) FILTER (WHERE o_custkey < 10) * 100.0 / count(o_custkey), 2) FROM orders_nulls""", ["orders_nulls"])
def _(spark, d):
    found = checks.range_checks(view(spark, d, "orders_nulls"), {"o_totalprice": (5000, 400000), "o_custkey": (10, None)})
    return found.select("column", "total", "violations", "violation_pct")


@query("f4_format_checks", """
    SELECT 'o_orderpriority' AS "column", count(o_orderpriority) AS total, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-3]-[A-Z]+)')) AS violations FROM orders_nulls
    UNION ALL SELECT 'contact', count(contact), count(*) FILTER (WHERE NOT regexp_matches(contact, '^(?:^[\\w\\.-]+@[\\w\\.-]+\\.[a-zA-Z]{2,}$)')) FROM customer_governed""".replace("\\\\", "\\"),
       ["orders_nulls", "customer_governed"])
def _(spark, d):
    a = checks.format_checks(view(spark, d, "orders_nulls"), {"o_orderpriority": "[1-3]-[A-Z]+"})
    b = checks.format_checks(view(spark, d, "customer_governed"), {"contact": fixed.FORMAT_RULES["email"]})
    return a.unionByName(b).select("column", "total", "violations")


@query("f5_allowed_values", """
    SELECT 'consent_status' AS "column", consent_status AS value, count(*) AS n FROM customer_governed
    WHERE consent_status NOT IN ('granted', 'denied', 'withdrawn', 'pending') GROUP BY 2
    UNION ALL SELECT 'data_classification', data_classification, count(*) FROM customer_governed
    WHERE data_classification NOT IN ('public', 'internal', 'confidential', 'restricted') GROUP BY 2""", ["customer_governed"])
def _(spark, d):
    df = view(spark, d, "customer_governed")
    out = None
    for name, allowed in (("consent_status", fixed.CONSENT_STATUSES), ("data_classification", fixed.DATA_CLASSIFICATIONS)):
        bad = df.filter(governance.not_allowed(F.col(name), allowed)).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
        bad = bad.select(F.lit(name).alias("column"), "value", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("f6_source_format", "SELECT c_custkey FROM customer_governed WHERE NOT regexp_matches(source_system, '^[A-Z_]+$')", ["customer_governed"])
def _(spark, d):
    return view(spark, d, "customer_governed").filter(governance.bad_source(F.col("source_system"))).select("c_custkey")


@query("f7_invalid_dates", """
    SELECT c_custkey FROM customer_governed WHERE consent_date IS NOT NULL AND try_cast(consent_date AS TIMESTAMP) IS NULL""", ["customer_governed"])
def _(spark, d):
    df = view(spark, d, "customer_governed")
    return df.filter(governance.bad_date(df, "consent_date")).select("c_custkey")


def _pii_sql(columns, source, patterns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS pii_type, count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS matches FROM {source}"
        for c in columns for t, p in patterns.items())


@query("f8_pii_search", _pii_sql(["text", "source"], "documents", _PII))
def _(spark, d):
    return privacy.pii_matches(table(spark, d, "documents"), text.risk_patterns(), ["text", "source"])


@query("f9_governance_pii_search", _pii_sql(["contact", "c_name", "source_system"], "customer_governed", {
    "email": _PII["email"], "phone": fixed.GOVERNANCE_PII_PATTERNS["phone"], "ssn": _PII["ssn"]}), ["customer_governed"])
def _(spark, d):
    return privacy.pii_matches(view(spark, d, "customer_governed"), fixed.GOVERNANCE_PII_PATTERNS,
                               ["contact", "c_name", "source_system"])


@query("f10_sensitive_names", """
    SELECT 'salary_amount' AS "column", 'salary' AS sensitive_term, count(salary_amount) AS values FROM customer_sensitive
    UNION ALL SELECT 'api_key_hint', 'api_key', count(api_key_hint) FROM customer_sensitive
    UNION ALL SELECT 'tax_id', 'tax_id', count(tax_id) FROM customer_sensitive""", ["customer_sensitive"])
def _(spark, d):
    df = view(spark, d, "customer_sensitive")
    counts = column_facts(df).select("column", F.col("non_null_count").alias("values"))
    return sensitive_table(df).filter("sensitive_term is not null").join(counts, "column").select("column", "sensitive_term", "values")


@query("f11_consent_names", """
    SELECT 'marketing_opt_in' AS "column", count(marketing_opt_in) AS values FROM customer_sensitive""", ["customer_sensitive"])
def _(spark, d):
    df = view(spark, d, "customer_sensitive")
    counts = column_facts(df).select("column", F.col("non_null_count").alias("values"))
    return sensitive_table(df).filter("tracks_consent").join(counts, "column").select("column", "values")


@query("f12_missing_columns", """
    SELECT area, c AS "column" FROM (VALUES
      ('lineage', 'modified_date'), ('consent', 'data_subject_id'), ('classification', 'sensitivity_level'),
      ('classification', 'retention_period')) AS t(area, c)""", ["customer_governed"])
def _(spark, d):
    df = view(spark, d, "customer_governed")
    return governance.missing_fields(df)


def _outlier_rows(spark, d, p):
    df = view(spark, d, "lineitem_outliers")
    rows = outliers.bounds(df, p, ["l_extendedprice", "l_quantity"]).collect()
    found = outliers.outlier_issues(df, ["l_orderkey", "l_linenumber", "l_partkey"], rows, p)
    return found.groupBy("column", "severity").agg(F.count("*").alias("n"))


def _outlier_sql(condition, severity, stats):
    return union_sql(["l_extendedprice", "l_quantity"], f"""
        SELECT '$c' AS "column", CASE WHEN {severity} THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n
        FROM lineitem_outliers, (SELECT {stats} FROM lineitem_outliers) WHERE {condition} GROUP BY 2""")


@query("f13_iqr_outliers", _outlier_sql(
    "$c < lo OR $c > hi", "greatest(abs($c - lo), abs($c - hi)) > 3 * iqr",
    """quantile_cont($c, 0.25) - 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)) AS lo,
       quantile_cont($c, 0.75) + 1.5 * (quantile_cont($c, 0.75) - quantile_cont($c, 0.25)) AS hi,
       quantile_cont($c, 0.75) - quantile_cont($c, 0.25) AS iqr"""), ["lineitem_outliers"])
def _(spark, d):
    return _outlier_rows(spark, d, OutlierParams())


@query("f14_z_score_outliers", _outlier_sql(
    "abs(($c - m) / s) > 3", "abs(($c - m) / s) > 4", "avg($c) AS m, stddev_pop($c) AS s"), ["lineitem_outliers"])
def _(spark, d):
    return _outlier_rows(spark, d, OutlierParams(method="z_score"))


@query("f15_percentile_outliers", _outlier_sql(
    "$c < lo OR $c > hi", "$c < xlo OR $c > xhi",
    """quantile_cont($c, 0.01) AS lo, quantile_cont($c, 0.99) AS hi, quantile_cont($c, 0.001) AS xlo,
       quantile_cont($c, 0.999) AS xhi"""), ["lineitem_outliers"])
def _(spark, d):
    return _outlier_rows(spark, d, OutlierParams(method="percentile"))


@query("f16_rows_without_outliers", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem_outliers,
      (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem_outliers),
      (SELECT quantile_cont(l_quantity, 0.25) AS e, quantile_cont(l_quantity, 0.75) AS f FROM lineitem_outliers)
    WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AND l_quantity BETWEEN e - 1.5 * (f - e) AND f + 1.5 * (f - e)""",
       ["lineitem_outliers"])
def _(spark, d):
    df = view(spark, d, "lineitem_outliers")
    rows = outliers.bounds(df, OutlierParams(), ["l_extendedprice", "l_quantity"]).collect()
    return outliers.clean(df, rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


@query("f17_baseline_deviation", """
    SELECT CAST(event_id AS VARCHAR) AS row_id, 'value' AS "column" FROM events_cur,
      (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events_base) WHERE abs((value - m) / s) > 2""", ["events_base", "events_cur"])
def _(spark, d):
    base, cur = view(spark, d, "events_base"), view(spark, d, "events_cur")
    facts = local_facts(base, ("range", "moments"), columns=["value"])
    made = drift.numeric_drift_rules(cur, facts, ["value"], DriftParams())
    return issues.cell_issues(cur, "event_id", made).select("row_id", "column")


@query("f18_new_category_rows", """
    SELECT event_id, event_type AS value FROM events_cur WHERE event_type NOT IN (SELECT event_type FROM events_base)""",
       ["events_base", "events_cur"])
def _(spark, d):
    base, cur = view(spark, d, "events_base"), view(spark, d, "events_cur")
    pairs = frequencies.paired_counts(base, cur, ["event_type"])
    rows = drift.rows_with_new_categories(cur, pairs, ["event_type"], ["event_id"])
    return rows.select(F.col("key_0").alias("event_id"), "value")


@query("f18_first_new_category_rows", """
    SELECT CAST(event_id AS VARCHAR) AS row_id, event_type AS value FROM events_cur
    WHERE event_type NOT IN (SELECT event_type FROM events_base) ORDER BY event_id LIMIT 5""", ["events_base", "events_cur"])
def _(spark, d):
    base, cur = view(spark, d, "events_base"), view(spark, d, "events_cur")
    pairs = frequencies.paired_counts(base, cur, ["event_type"])
    cells = drift.new_category_issues(cur, pairs, ["event_type"], ["event_id"])
    return drift.first_of_new_categories(cells, pairs).select("row_id", "value")


@query("f19_pii_in_public_rows", f"""
    SELECT CAST(c_custkey AS VARCHAR) AS row_id, 'contact' AS "column", 'email' AS pii_type,
           concat(substring(contact, 1, 3), '***') AS value
    FROM customer_governed WHERE data_classification = 'public' AND regexp_matches(contact, '{_PII["email"]}')""", ["customer_governed"])
def _(spark, d):
    df = view(spark, d, "customer_governed")
    return issues.cell_issues(df, "c_custkey", governance.public_pii_rules(df)).select("row_id", "column", "pii_type", "value")


@query("f20_withdrawn_consent", "SELECT count(*) AS n FROM customer_governed WHERE consent_status = 'withdrawn'", ["customer_governed"])
def _(spark, d):
    return governance.governance_facts(view(spark, d, "customer_governed")).filter("fact = 'withdrawn'").select("n")


@query("f21_numbers_as_text", """
    SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'cust_text' AS "column", cust_text AS value FROM orders_text
    WHERE regexp_matches(cust_text, '^[0-9]+$')""", ["orders_text"])
def _(spark, d):
    return types.numeric_text_issues(view(spark, d, "orders_text"), "o_orderkey").select("row_id", "column", "value")


@query("f22_missing_critical_values", """
    SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'o_totalprice' AS "column", 'high' AS severity FROM orders_nulls WHERE o_totalprice IS NULL""", ["orders_nulls"])
def _(spark, d):
    rules = CheckRules(critical=("o_totalprice", "absent"), check_duplicates=False)
    return checks.row_issues(view(spark, d, "orders_nulls"), "o_orderkey", rules).select("row_id", "column", "severity")

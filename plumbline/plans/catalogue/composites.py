"""The composite operators: profile, readiness, risk, drift, governance, checks, cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import baseline, checks, drift, governance, nulls, outliers, privacy, profile, readiness, schema_drift, types
from plumbline.params import (
    CheckRules, DriftParams, NullParams, OutlierParams, ProfileParams, ReadinessParams, TypeParams,
)
from plumbline.plans import workflows
from plumbline.plans.catalogue.aggregates import _PII, risk_points_sql
from plumbline.plans.catalogue.distances import BOTH, _KS_P, _changed, _ks_sql, _sides
from plumbline.plans.catalogue.registry import query, rounded, table, union_sql, view
from plumbline.sources.writers import scratch_folder


def _number_row(c, data_type, source):
    return f"""
    SELECT '{c}' AS "column", '{data_type}' AS data_type, 'Numeric' AS semantic_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
      round_even((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, NULL::BIGINT AS distinct_count,
      min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 2) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
      round(stddev_samp({c}), 2) AS std_dev, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75,
      (SELECT count(*) FROM {source} WHERE {c} < (SELECT quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM {source})
                                 OR {c} > (SELECT quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM {source})) AS outlier_count,
      NULL::VARCHAR AS earliest, NULL::VARCHAR AS latest, NULL::BIGINT AS span_days, NULL::DOUBLE AS entropy FROM {source}"""


def _text_row(c, source, semantic="Categorical"):
    return f"""
    SELECT '{c}', 'string', '{semantic}', (SELECT count(*) FROM {source}), (SELECT count(*) - count({c}) FROM {source}),
      (SELECT round_even((count(*) - count({c})) * 100.0 / count(*), 1) FROM {source}), count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      round_even(-sum(p * ln(p)), 3) FROM (SELECT {c}, count(*) / sum(count(*)) OVER () AS p FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"""


def _time_row(c, source):
    return f"""
    SELECT '{c}', 'timestamp', 'Temporal', count(*), count(*) - count({c}), round_even((count(*) - count({c})) * 100.0 / count(*), 1), NULL, NULL, NULL,
      NULL, NULL, NULL, NULL, NULL, NULL, strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S'),
      CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT), NULL FROM {source}"""


_PROFILE_LINEITEM = " UNION ALL ".join(
    [_number_row(c, t, "lineitem") for c, t in (
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
        ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"))]
    + [_text_row("l_returnflag", "lineitem"), _text_row("l_linestatus", "lineitem"), _time_row("l_shipdate", "lineitem")])
_PROFILE_ORDERS = " UNION ALL ".join(
    [_number_row("o_orderkey", "bigint", "orders_nulls"), _number_row("o_custkey", "bigint", "orders_nulls"),
     _number_row("o_totalprice", "double", "orders_nulls"), _text_row("o_orderstatus", "orders_nulls"),
     _text_row("o_orderpriority", "orders_nulls"), _time_row("o_orderdate", "orders_nulls")])


def _shown(columns):
    form = "yyyy-MM-dd HH:mm:ss"
    return rounded(columns.drop("dataset", "variance").withColumns(
        {c: F.date_format(c, form) for c in ("earliest", "latest")}), 2, entropy=3, median=4, p25=4, p75=4)


@query("c1_column_profile", _PROFILE_LINEITEM)
def _(spark, d):
    columns = profile.column_profile(table(spark, d, "lineitem"))
    return _shown(columns.select(*profile.PROFILE_FIELDS))


@query("c1_column_profile_with_nulls", _PROFILE_ORDERS, ["orders_nulls"])
def _(spark, d):
    return _shown(profile.column_profile(view(spark, d, "orders_nulls")).select(*profile.PROFILE_FIELDS))


@query("c1_free_text_profile", " UNION ALL ".join(
    [_number_row("doc_id", "bigint", "documents"), _number_row("n_chars", "bigint", "documents"),
     _text_row("text", "documents", "Free Text"), _text_row("lang", "documents"), _text_row("source", "documents")]))
def _(spark, d):
    return _shown(profile.column_profile(table(spark, d, "documents")).select(*profile.PROFILE_FIELDS))


@query("c1_findings", """
    SELECT 'price' AS "column", 'warning' AS severity, 'data_completeness' AS category,
           concat(printf('%.1f', round_even((count(*) - count(price)) * 100.0 / count(*), 1)), ' % of the rows have no value here') AS message
    FROM orders_mixed
    UNION ALL SELECT 'origin', 'info', 'data_variance', concat('always ''', min(origin), '''') FROM orders_mixed""",
       ["orders_mixed"])
def _(spark, d):
    found = profile.profile(view(spark, d, "orders_mixed"), "o_orderkey").findings
    return found.select("column", "severity", "category", "message")


@query("c1_issue_summary", """
    WITH found AS (
      SELECT 'null_value' AS t, 'info' AS s, 'priority' AS c FROM orders_mixed WHERE priority IS NULL
      UNION ALL SELECT 'null_value', 'warning', 'price' FROM orders_mixed WHERE price IS NULL
      UNION ALL SELECT 'constant_column', 'info', 'origin'
      UNION ALL SELECT 'duplicate_row', 'warning', NULL FROM orders_mixed GROUP BY ALL, o_orderkey, priority, price, origin, code HAVING count(*) > 1)
    SELECT 'issue_type' AS dimension, t AS key, count(*) AS count FROM found GROUP BY 2
    UNION ALL SELECT 'severity', s, count(*) FROM found GROUP BY 2
    UNION ALL SELECT 'column', c, count(*) FROM found WHERE c IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*) FROM found""".replace("GROUP BY ALL, o_orderkey", "GROUP BY o_orderkey"), ["orders_mixed"])
def _(spark, d):
    return profile.profile(view(spark, d, "orders_mixed"), "o_orderkey").issue_summary


@query("c1_status", """
    SELECT 'table' AS dataset, CASE WHEN (count(*) - count(price)) * 100.0 / count(*) > 20 THEN 'Needs Review' ELSE 'Ready' END AS status FROM orders_mixed""", ["orders_mixed"])
def _(spark, d):
    return profile.profile(view(spark, d, "orders_mixed"), "o_orderkey").status.select("dataset", "status")


@query("j5_findings_with_facts", """
    SELECT 'price' AS "column", 'double' AS data_type, 'Numeric' AS semantic_type, round_even((count(*) - count(price)) * 100.0 / count(*), 1) AS null_pct FROM orders_mixed
    UNION ALL SELECT 'origin', 'string', 'Categorical', 0.0 FROM orders_mixed HAVING count(*) > 0""", ["orders_mixed"])
def _(spark, d):
    found = profile.profile(view(spark, d, "orders_mixed"), "o_orderkey").findings
    return found.select("column", "data_type", "semantic_type", "null_pct")


_READINESS = """
    WITH f AS (SELECT count(*) AS n, 2 * count(*) - count(priority) - count(price) AS nulls FROM orders_mixed),
         u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM orders_mixed)),
         s AS (SELECT 100 - nulls * 100.0 / (5 * n) AS a, 100 - (n - k) * 100.0 / n AS b, 85.0 AS c FROM f, u) """


@query("c2_readiness_scores", _READINESS + """
    SELECT 'overall' AS component, round_even(0.4 * a + 0.4 * b + 0.2 * c, 0)::DOUBLE AS score,
           CASE WHEN round_even(0.4 * a + 0.4 * b + 0.2 * c, 0) >= 85 THEN 'Ready' WHEN round_even(0.4 * a + 0.4 * b + 0.2 * c, 0) >= 70 THEN 'Needs Review' ELSE 'Not Ready' END AS status FROM s
    UNION ALL SELECT 'completeness', round_even(a, 0), NULL FROM s UNION ALL SELECT 'consistency', round_even(b, 0), NULL FROM s
    UNION ALL SELECT 'schema_health', round_even(c, 0), NULL FROM s""", ["orders_mixed"])
def _(spark, d):
    return readiness.readiness(view(spark, d, "orders_mixed"), "o_orderkey").scores.select("component", "score", "status")


@query("c2_deductions", _READINESS + """
    SELECT 'data_completeness' AS category, NULL AS "column", round_even(100 - a, 1)::DOUBLE AS points FROM s
    UNION ALL SELECT 'data_consistency', NULL, round_even(100 - b, 1) FROM s
    UNION ALL SELECT 'schema_health', 'origin', 10 FROM s UNION ALL SELECT 'schema_health', 'code', 5 FROM s""", ["orders_mixed"])
def _(spark, d):
    return readiness.readiness(view(spark, d, "orders_mixed"), "o_orderkey").deductions.drop("dataset")


_RISK_SQL = risk_points_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents")


@query("c3_column_risks", f"""
    SELECT "column", points + CASE WHEN points > 0 THEN 15 ELSE 0 END AS risk_score, points > 0 AS pii_detected,
           CASE WHEN points + 15 >= 75 AND points > 0 THEN 'critical' WHEN points + 15 >= 50 AND points > 0 THEN 'high'
                WHEN points + 15 >= 25 AND points > 0 THEN 'medium' ELSE 'low' END AS risk_level FROM ({_RISK_SQL})""")
def _(spark, d):
    return privacy.risk(table(spark, d, "documents"), "doc_id").column_risks.select("column", "risk_score", "pii_detected", "risk_level")


@query("c3_sensitive_column_risks", """
    SELECT c AS "column", points AS risk_score, level AS risk_level, gap AS governance_gap FROM (VALUES
      ('c_custkey', 0, 'low', false), ('full_name', 0, 'low', false), ('salary_amount', 35, 'medium', true), ('marketing_opt_in', 0, 'low', false),
      ('api_key_hint', 35, 'medium', true), ('tax_id', 35, 'medium', true)) AS t(c, points, level, gap)""", ["customer_sensitive"])
def _(spark, d):
    df = view(spark, d, "customer_sensitive")
    risks = privacy.column_risks(df).select("column", "risk_score", "risk_level", "governance_gap")
    return risks


@query("c3_risk_status", f"""
    SELECT count(*) FILTER (WHERE points > 0)::DOUBLE AS pii_fields, round_even(avg(points + CASE WHEN points > 0 THEN 15 ELSE 0 END), 0) AS overall,
           CASE WHEN count(*) FILTER (WHERE points > 0) > 0 THEN 'High Risk' ELSE 'Low Risk' END AS status FROM ({_RISK_SQL})""")
def _(spark, d):
    scores = privacy.risk(table(spark, d, "documents"), "doc_id").scores
    return scores.agg(
        F.max(F.when(F.col("component") == "pii_fields", F.col("score"))).alias("pii_fields"),
        F.max(F.when(F.col("component") == "overall", F.col("score"))).alias("overall"),
        F.max("status").alias("status"))


@query("c3_listed_issues", " UNION ALL ".join(f"""
    SELECT * FROM (SELECT '{t}' AS pii_type, CAST(doc_id AS VARCHAR) AS row_id, concat(substring(text, 1, 3), '***') AS value
                   FROM documents WHERE regexp_matches(text, '{p}') ORDER BY doc_id LIMIT 10)""" for t, p in _PII.items()))
def _(spark, d):
    found = privacy.risk(table(spark, d, "documents"), "doc_id").issues
    return found.filter("issue_type = 'pii_detected'").select("pii_type", "row_id", "value")


@query("c3_issue_summary", " UNION ALL ".join(
    [f"SELECT 'pii_type' AS dimension, '{t}' AS key, count(*) AS count FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for t, p in _PII.items()]))
def _(spark, d):
    return privacy.risk(table(spark, d, "documents"), "doc_id").issue_summary.filter("dimension = 'pii_type'")


def _measures_sql(c: str) -> str:
    """PSI and Jensen-Shannon distance of one column's texts in both tables."""
    return f"""
      (WITH n AS (SELECT v, sum(b) AS b, sum(c) AS c FROM (
          SELECT CAST({c} AS VARCHAR) AS v, 1 AS b, 0 AS c FROM events_base WHERE {c} IS NOT NULL
          UNION ALL SELECT CAST({c} AS VARCHAR), 0, 1 FROM events_cur WHERE {c} IS NOT NULL) GROUP BY 1),
        s AS (SELECT b / sum(b) OVER () AS p, c / sum(c) OVER () AS q FROM n),
        m AS (SELECT round(sum((greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) - greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))
              * ln(greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) / greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))), 6) AS psi,
            round(sqrt(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)), 6) AS js FROM s)
      SELECT '{c}' AS "column", 'categorical' AS kind, 'psi' AS statistic, psi AS value, psi > 0.1 AS drift_detected,
             CASE WHEN psi > 0.25 THEN 'critical' WHEN psi > 0.1 THEN 'warning' END AS severity FROM m
      UNION ALL SELECT '{c}', 'categorical', 'js_distance', js, NULL, NULL FROM m)"""


_DRIFT_SQL = (
    " UNION ALL ".join(_measures_sql(c) for c in ("event_type", "ts", "props")) + " UNION ALL "
    + _ks_sql(["event_id", "user_id", "value"], "events_base", "events_cur",
              "'$c', 'numeric', 'ks', round(d, 6), p < 0.05, CASE WHEN p < 0.05 THEN 'critical' END").replace(
        "FROM (\n          SELECT max(abs(cb", "FROM (SELECT d, (" + _KS_P.split("AS \"column\", ")[1].replace(" AS p_value", "") + ") AS p FROM (\n          SELECT max(abs(cb").replace(
        "GROUP BY v)))", "GROUP BY v))))"))


@query("c4_drift_table", _DRIFT_SQL, BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    found = drift.drift_table(base, cur, DriftParams(p_value_method="asymptotic"))
    return rounded(found.drop("p_value"))


@query("c4_drift_status", "SELECT 'table' AS dataset, CASE WHEN (SELECT count(*) FROM events_cur) > 0 THEN 'Needs Review' ELSE 'Ready' END AS status", BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    return drift.detect_drift(base, cur, ["event_id"]).status


def _stored_base(spark, base):
    folder = scratch_folder(spark, "baseline")
    return baseline.load_baseline(spark, folder, baseline.save_baseline(base, folder))


@query("c4_drift_from_snapshot", _DRIFT_SQL, BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    return rounded(drift.drift_table(_stored_base(spark, base), cur).drop("p_value"))


_NEW_ROWS = """SELECT '$c' AS key, count(*) AS count FROM events_cur WHERE $c IS NOT NULL AND CAST($c AS VARCHAR) NOT IN (
      SELECT CAST($c AS VARCHAR) FROM events_base WHERE $c IS NOT NULL) HAVING count(*) > 0"""


_ISSUES_SQL = ("""
    WITH m AS (SELECT avg(event_id) AS em, stddev_samp(event_id) AS es, avg(value) AS vm, stddev_samp(value) AS vs,
                      avg(user_id) AS um, stddev_samp(user_id) AS us FROM events_base)
    SELECT 'event_id' AS key, count(*) AS count FROM events_cur, m WHERE abs((event_id - em) / es) > 2
    UNION ALL SELECT 'value', count(*) FROM events_cur, m WHERE abs((value - vm) / vs) > 2
    UNION ALL SELECT 'user_id', count(*) FROM events_cur, m WHERE abs((user_id - um) / us) > 2 HAVING count(*) > 0 UNION ALL """
    + union_sql(["ts", "event_type", "props"], _NEW_ROWS))


@query("c4_drift_issue_summary", _ISSUES_SQL, BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    found = drift.detect_drift(base, cur, ["event_id"])
    return found.issue_summary.filter("dimension = 'column'").select("key", "count")


@query("c4_snapshot_issue_summary", _ISSUES_SQL, BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    found = drift.detect_drift(_stored_base(spark, base), cur, ["event_id"])
    return found.issue_summary.filter("dimension = 'column'").select("key", "count")


_GOVERNED = """
    WITH f AS (SELECT count(*) AS n, count(*) - count(source_system) AS s, count(*) - count(created_date) AS c,
        count(*) FILTER (WHERE NOT regexp_matches(source_system, '^[A-Z_]+$')) AS bad_source,
        count(*) FILTER (WHERE consent_status NOT IN ('granted', 'denied', 'withdrawn', 'pending')) AS bad_status,
        count(*) FILTER (WHERE consent_status = 'withdrawn') AS withdrawn,
        count(*) FILTER (WHERE consent_date IS NOT NULL AND try_cast(consent_date AS TIMESTAMP) IS NULL) AS bad_date,
        count(*) FILTER (WHERE data_classification NOT IN ('public', 'internal', 'confidential', 'restricted')) AS bad_class,
        count(*) FILTER (WHERE data_classification = 'public') AS pub, count(*) FILTER (WHERE contact LIKE '%@example.com') AS pii FROM customer_governed),
    findings AS (
      SELECT 'lineage' AS area, 'missing_lineage_fields' AS type, 20.0 AS points FROM f
      UNION ALL SELECT 'lineage', 'incomplete_lineage_data', least(15, s * 100.0 / n) FROM f WHERE s * 100.0 / n > 5
      UNION ALL SELECT 'lineage', 'incomplete_lineage_data', least(15, c * 100.0 / n) FROM f WHERE c * 100.0 / n > 5
      UNION ALL SELECT 'lineage', 'invalid_source_format', 10 FROM f WHERE bad_source > 0
      UNION ALL SELECT 'consent', 'missing_consent_fields', 25 FROM f
      UNION ALL SELECT 'consent', 'invalid_consent_status', 15 FROM f WHERE bad_status > 0
      UNION ALL SELECT 'consent', 'withdrawn_consent_detected', 0 FROM f WHERE withdrawn > 0
      UNION ALL SELECT 'consent', 'invalid_consent_dates', 10 FROM f WHERE bad_date > 0
      UNION ALL SELECT 'classification', 'missing_classification_fields', 40 FROM f
      UNION ALL SELECT 'classification', 'invalid_data_classification', 15 FROM f WHERE bad_class > 0
      UNION ALL SELECT 'classification', 'pii_classification_mismatch', 20 FROM f WHERE pub > 0 AND pii > 0),
    areas AS (SELECT greatest(0, 100 - sum(points) FILTER (WHERE area = 'lineage')) AS l, greatest(0, 100 - sum(points) FILTER (WHERE area = 'consent')) AS c,
                     greatest(0, 100 - sum(points) FILTER (WHERE area = 'classification')) AS k FROM findings) """


@query("c5_governance_findings", _GOVERNED + "SELECT type, round(points, 4)::DOUBLE AS points FROM findings", ["customer_governed"])
def _(spark, d):
    found = governance.governance(view(spark, d, "customer_governed"), "c_custkey").findings
    return rounded(found.select("type", "points"), 4)


@query("c5_governance_scores", _GOVERNED + """
    SELECT 'overall' AS component, round_even(0.3 * l + 0.4 * c + 0.3 * k, 1)::DOUBLE AS score,
           CASE WHEN 0.3 * l + 0.4 * c + 0.3 * k >= 80 THEN 'compliant' WHEN 0.3 * l + 0.4 * c + 0.3 * k >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status FROM areas
    UNION ALL SELECT 'lineage', round(l, 4), NULL FROM areas UNION ALL SELECT 'consent', round(c, 4), NULL FROM areas
    UNION ALL SELECT 'classification', round(k, 4), NULL FROM areas""", ["customer_governed"])
def _(spark, d):
    scores = governance.governance(view(spark, d, "customer_governed"), "c_custkey").scores
    return rounded(scores.select("component", "score", "status"), 4)


@query("c5_issue_summary", """
    SELECT 'missing_lineage_data' AS key, 2 * count(*) - count(source_system) - count(created_date) AS count FROM customer_governed
    UNION ALL SELECT 'missing_consent_data', 2 * count(*) - count(consent_status) - count(consent_date) FROM customer_governed
    UNION ALL SELECT 'invalid_consent_status', count(*) FROM customer_governed WHERE consent_status NOT IN ('granted', 'denied', 'withdrawn', 'pending')
    UNION ALL SELECT 'invalid_data_classification', count(*) FROM customer_governed WHERE data_classification NOT IN ('public', 'internal', 'confidential', 'restricted')
    UNION ALL SELECT 'pii_in_public_data', count(*) FROM customer_governed WHERE data_classification = 'public' AND contact LIKE '%@example.com'""", ["customer_governed"])
def _(spark, d):
    return governance.governance(view(spark, d, "customer_governed"), "c_custkey").issue_summary.filter(
        "dimension = 'issue_type'").select("key", "count")


_RULES = CheckRules(
    unique=("o_orderkey", "code", "nothing"), ranges={"price": (2000, 450000), "code": (0, 1), "o_orderkey": (None, 1e12)},
    formats={"priority": "[1-4]-", "code": "(x", "origin": "[A-Z]{3}$"}, critical=("priority",))
_CHECKS = """
    WITH t AS (
      SELECT 'o_orderkey' AS c, 'uniqueness' AS k, count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS v FROM orders_mixed
      UNION ALL SELECT 'code', 'uniqueness', count(*), count(*) - count(DISTINCT code) FROM orders_mixed
      UNION ALL SELECT 'price', 'range', count(price), count(*) FILTER (WHERE price < 2000 OR price > 450000) FROM orders_mixed
      UNION ALL SELECT 'o_orderkey', 'range', count(*), 0 FROM orders_mixed
      UNION ALL SELECT 'priority', 'format', count(priority), count(*) FILTER (WHERE NOT regexp_matches(priority, '^[1-4]-')) FROM orders_mixed
      UNION ALL SELECT 'origin', 'format', count(origin), count(*) FILTER (WHERE NOT regexp_matches(origin, '^[A-Z]{3}$')) FROM orders_mixed),
    g AS (SELECT greatest(0, 100 - 20 - sum(least(25, v * 100.0 / n)) FILTER (WHERE k = 'uniqueness')) AS u,
                 greatest(0, 100 - 10 - sum(least(20, v * 100.0 / n)) FILTER (WHERE k = 'range')) AS r,
                 greatest(0, 100 - 5 - sum(least(15, v * 100.0 / n)) FILTER (WHERE k = 'format')) AS f, count(*) AS e, count(*) FILTER (WHERE v = 0) AS p FROM t) """


@query("c6_checks", _CHECKS + """
    SELECT c AS "column", k AS test_type, n AS total, v AS violations, round_even(v * 100.0 / n, 2)::DOUBLE AS violation_pct, v = 0 AS passed, NULL AS problem FROM t
    UNION ALL SELECT 'nothing', 'uniqueness', NULL, NULL, NULL, NULL, 'missing_column'
    UNION ALL SELECT 'code', 'range', NULL, NULL, NULL, NULL, 'non_numeric'
    UNION ALL SELECT 'code', 'format', NULL, NULL, NULL, NULL, 'invalid_pattern'""", ["orders_mixed"])
def _(spark, d):
    return checks.run_checks(view(spark, d, "orders_mixed"), "o_orderkey", _RULES).checks.drop("dataset")


@query("c6_check_scores", _CHECKS + """
    SELECT 'overall' AS component, round_even(0.4 * u + 0.3 * r + 0.3 * f, 1)::DOUBLE AS score,
           CASE WHEN 0.4 * u + 0.3 * r + 0.3 * f >= 90 THEN 'excellent' WHEN 0.4 * u + 0.3 * r + 0.3 * f >= 75 THEN 'good' ELSE 'needs_improvement' END AS status FROM g
    UNION ALL SELECT 'uniqueness', round(u, 4), NULL FROM g UNION ALL SELECT 'range', round(r, 4), NULL FROM g UNION ALL SELECT 'format', round(f, 4), NULL FROM g
    UNION ALL SELECT 'tests_executed', e, NULL FROM g UNION ALL SELECT 'tests_passed', p, NULL FROM g""", ["orders_mixed"])
def _(spark, d):
    return rounded(checks.run_checks(view(spark, d, "orders_mixed"), "o_orderkey", _RULES).scores.select("component", "score", "status"), 4)


@query("c6_issue_summary", """
    SELECT 'missing_critical_value' AS key, count(*) AS count FROM orders_mixed WHERE priority IS NULL
    UNION ALL SELECT 'duplicate_row', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders_mixed GROUP BY ALL, o_orderkey, priority, price, origin, code HAVING count(*) > 1)""".replace(
    "GROUP BY ALL, o_orderkey", "GROUP BY o_orderkey"), ["orders_mixed"])
def _(spark, d):
    found = checks.run_checks(view(spark, d, "orders_mixed"), "o_orderkey", _RULES).issue_summary
    return found.filter("dimension = 'issue_type'").select("key", "count")


_SCHEMA_CHANGES = """
    WITH x AS (
      SELECT 'props' AS c, 'removed' AS change, 40 AS points, 'breaking' AS impact UNION ALL SELECT 'channel', 'added', 10, 'non-breaking'
      UNION ALL SELECT 'user_id', 'type', 10, 'non-breaking' UNION ALL SELECT 'user_id', 'constraint', 5, 'non-breaking'
      UNION ALL SELECT 'event_id', 'constraint', 5, 'non-breaking' FROM (SELECT 1) WHERE (SELECT max(event_id) FROM events_base) <> (SELECT max(event_id) FROM events_cur)
      UNION ALL SELECT 'value', 'constraint', 5, 'non-breaking' FROM (SELECT 1) WHERE (SELECT avg(value) FROM events_base) <> (SELECT avg(value) FROM events_cur)
      UNION ALL SELECT 'event_type', 'constraint', 5, 'non-breaking' FROM (SELECT 1)
        WHERE (SELECT max(length(event_type)) FROM events_base) <> (SELECT max(length(event_type)) FROM events_cur)
           OR (SELECT min(length(event_type)) FROM events_base) <> (SELECT min(length(event_type)) FROM events_cur)) """


@query("c7_schema_changes", _SCHEMA_CHANGES + 'SELECT c AS "column", change, points, impact FROM x', BOTH)
def _(spark, d):
    return schema_drift.schema_drift(*_changed(spark, d)).schema_changes.select("column", "change", "points", "impact")


@query("c7_schema_drift_score", _SCHEMA_CHANGES + """, w AS (
      SELECT sum(points * CASE change WHEN 'added' THEN 0.1 WHEN 'removed' THEN 0.4 WHEN 'type' THEN 0.3 ELSE 0.05 END) AS s FROM x)
    SELECT round_even(s, 1)::DOUBLE AS score, CASE WHEN s >= 50 THEN 'critical' WHEN s >= 20 THEN 'moderate' ELSE 'minimal' END AS status FROM w""", BOTH)
def _(spark, d):
    scores = schema_drift.schema_drift(*_changed(spark, d)).scores
    return scores.filter("component = 'overall'").select("score", "status")


@query("c7_recommendations", """
    SELECT c AS "column", priority, category FROM (VALUES
      ('props', 'critical', 'breaking_change'), ('channel', 'medium', 'enhancement'), ('user_id', 'low', 'optimization')) AS t(c, priority, category)""", BOTH)
def _(spark, d):
    base, cur = _changed(spark, d)
    return schema_drift.schema_drift(base, cur).recommendations.select("column", "priority", "category")


_AUTO_FILL = """
    SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_nulls)), 4) AS o_totalprice,
           coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_nulls WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority
    FROM orders_nulls"""


@query("c8_filled_table", _AUTO_FILL, ["orders_nulls"])
def _(spark, d):
    result = nulls.handle_nulls(view(spark, d, "orders_nulls"), "o_orderkey", NullParams(auto=True))
    return rounded(result.table.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), 4)


@query("c8_actions", """
    SELECT 'o_totalprice' AS "column", 'mean' AS strategy, count(*) - count(o_totalprice) AS cells_changed FROM orders_nulls
    UNION ALL SELECT 'o_orderpriority', 'mode', count(*) - count(o_orderpriority) FROM orders_nulls""", ["orders_nulls"])
def _(spark, d):
    result = nulls.handle_nulls(view(spark, d, "orders_nulls"), "o_orderkey", NullParams(auto=True))
    return result.actions.select("column", "strategy", "cells_changed")


@query("c8_drop_rows_score", """
    WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL) AS k FROM orders_nulls)
    SELECT round_even(50 + 30.0 * k / n + 20, 1)::DOUBLE AS score, CASE WHEN 50 + 30.0 * k / n + 20 >= 90 THEN 'Fully Cleaned' WHEN 50 + 30.0 * k / n + 20 >= 75 THEN 'Well Cleaned' ELSE 'Needs More Cleaning' END AS status FROM f""", ["orders_nulls"])
def _(spark, d):
    result = nulls.handle_nulls(view(spark, d, "orders_nulls"), "o_orderkey", NullParams(drop_rows=True))
    return result.scores.filter("component = 'overall'").select("score", "status")


@query("c8_findings", """
    SELECT 'warning' AS severity, 'remaining_after_cleaning' AS type, concat(count(*) - count(o_totalprice), ' nulls remain') AS message FROM orders_nulls HAVING count(*) > count(o_totalprice)""", ["orders_nulls"])
def _(spark, d):
    p = NullParams(strategies={"o_orderpriority": "drop_column"})
    found = nulls.handle_nulls(view(spark, d, "orders_nulls"), "o_orderkey", p).findings
    return found.filter("type = 'remaining_after_cleaning'").select("severity", "type", "message")


@query("c8_drop_column_score", """
    WITH f AS (SELECT count(*) - count(o_totalprice) AS a, count(*) - count(o_orderpriority) AS b FROM orders_nulls),
         s AS (SELECT 0.5 * b * 100.0 / (a + b) + 30 + 20 * 5.0 / 6 AS s FROM f)
    SELECT round_even(s, 1)::DOUBLE AS score, CASE WHEN s >= 75 THEN 'Well Cleaned' ELSE 'Needs More Cleaning' END AS status FROM s""", ["orders_nulls"])
def _(spark, d):
    p = NullParams(strategies={"o_orderpriority": "drop_column"})
    result = nulls.handle_nulls(view(spark, d, "orders_nulls"), "o_orderkey", p)
    return result.scores.filter("component = 'overall'").select("score", "status")


# All numeric columns of the table with their fences, and the rows within all of them.
_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_FENCED = """
    WITH q AS (SELECT count(*) AS n, """ + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _NUMBERS) + """ FROM lineitem_outliers),
         i AS (SELECT """ + ", ".join(f"{c} BETWEEN a_{c} - 1.5 * (b_{c} - a_{c}) AND b_{c} + 1.5 * (b_{c} - a_{c}) AS {c}" for c in _NUMBERS) + """
               FROM lineitem_outliers, q),
         k AS (SELECT count(*) FILTER (WHERE """ + " AND ".join(_NUMBERS) + ") AS kept, " + " + ".join(
    f"count(*) FILTER (WHERE NOT {c})" for c in _NUMBERS) + """ AS cells FROM i) """


@query("c9_outlier_score", _FENCED + """
    SELECT round_even(50 + 30.0 * kept / n + 20, 1)::DOUBLE AS score, 'Fully Cleaned' AS status, cells::DOUBLE AS found FROM q, k""", ["lineitem_outliers"])
def _(spark, d):
    scores = outliers.handle_outliers(view(spark, d, "lineitem_outliers"), ["l_orderkey", "l_linenumber", "l_partkey"]).scores
    return scores.agg(
        F.max(F.when(F.col("component") == "overall", F.col("score"))).alias("score"), F.max("status").alias("status"),
        F.max(F.when(F.col("component") == "found", F.col("score"))).alias("found"))


@query("c9_findings", _FENCED + """
    SELECT 'critical' AS severity, 'low_cleaning_score' AS type FROM q, k WHERE 50 + 30.0 * kept / n + 20 < 100""", ["lineitem_outliers"])
def _(spark, d):
    p = OutlierParams(excellent_threshold=100.5, good_threshold=100)
    return outliers.handle_outliers(view(spark, d, "lineitem_outliers"), ["l_orderkey", "l_linenumber", "l_partkey"], p).findings.select("severity", "type")


@query("c9_outlier_actions", _FENCED + union_sql(_NUMBERS, """
    SELECT '$c' AS "column", 'impute_mean' AS strategy, count(*) AS cells_changed FROM i WHERE NOT $c HAVING count(*) > 0"""), ["lineitem_outliers"])
def _(spark, d):
    p = OutlierParams(strategy="impute_mean")
    result = outliers.handle_outliers(view(spark, d, "lineitem_outliers"), ["l_orderkey", "l_linenumber", "l_partkey"], p)
    return result.actions.select("column", "strategy", "cells_changed")


@query("c10_fixed_types", """
    SELECT o_orderkey, try_cast(cust_text AS DOUBLE) AS cust_text, strftime(try_cast(date_text AS TIMESTAMP), '%Y-%m-%d') AS date_text,
           CAST(cust_float AS BIGINT) AS cust_float, o_orderpriority FROM orders_text""", ["orders_text"])
def _(spark, d):
    fixed = types.fix_types(view(spark, d, "orders_text"), "o_orderkey", TypeParams(auto=True)).table
    return fixed.select("o_orderkey", "cust_text", F.date_format("date_text", "yyyy-MM-dd").alias("date_text"), "cust_float", "o_orderpriority")


@query("c10_type_issues", """
    SELECT 'cust_text' AS "column", 'numeric' AS suggested_type FROM orders_text HAVING count(try_cast(cust_text AS DOUBLE)) > 0.7 * count(cust_text)
    UNION ALL SELECT 'date_text', 'datetime' FROM orders_text HAVING count(try_cast(date_text AS DATE)) > 0.7 * count(date_text)
    UNION ALL SELECT 'cust_float', 'integer' FROM orders_text HAVING bool_and(cust_float = floor(cust_float))
    UNION ALL SELECT 'o_totalprice', 'integer' FROM orders_text HAVING bool_and(o_totalprice = floor(o_totalprice))""", ["orders_text"])
def _(spark, d):
    return types.fix_types(view(spark, d, "orders_text"), "o_orderkey").type_issues.select("column", "suggested_type")


@query("c10_findings", """
    SELECT 'warning' AS severity, 'remaining_after_cleaning' AS type FROM orders_text HAVING count(try_cast(date_text AS DATE)) > 0.7 * count(date_text)
    UNION ALL SELECT 'critical', 'low_cleaning_score' FROM orders_text HAVING 0.6 * 100.0 / 3 + 30 + 10 < 75 AND count(*) > 0""", ["orders_text"])
def _(spark, d):
    p = TypeParams(column_fixes={"cust_float": "integer"})
    return types.fix_types(view(spark, d, "orders_text"), "o_orderkey", p).findings.select("severity", "type")


@query("c10_issue_summary", """
    SELECT 'total' AS dimension, 'all' AS key, count(*) FILTER (WHERE try_cast(cust_text AS DOUBLE) IS NOT NULL) + count(*) FILTER (WHERE try_cast(date_text AS DOUBLE) IS NOT NULL)
      + count(*) FILTER (WHERE try_cast(o_orderpriority AS DOUBLE) IS NOT NULL) AS count FROM orders_text
    UNION ALL SELECT 'column', 'cust_text', count(*) FROM orders_text WHERE try_cast(cust_text AS DOUBLE) IS NOT NULL""", ["orders_text"])
def _(spark, d):
    summary = types.fix_types(view(spark, d, "orders_text"), "o_orderkey").issue_summary
    return summary.filter("dimension in ('total', 'column')")


@query("c10_type_score", """
    SELECT round_even(0.6 * 100.0 / 3 + 30 + 10, 1)::DOUBLE AS score, 'Needs More Fixing' AS status, 3.0::DOUBLE AS found FROM orders_text HAVING count(*) > 0""", ["orders_text"])
def _(spark, d):
    scores = types.fix_types(view(spark, d, "orders_text"), "o_orderkey", TypeParams(column_fixes={"cust_float": "integer"})).scores
    return scores.agg(
        F.max(F.when(F.col("component") == "overall", F.col("score"))).alias("score"), F.max("status").alias("status"),
        F.max(F.when(F.col("component") == "found", F.col("score"))).alias("found"))


@query("c11_workflow_steps", """
    SELECT step, name, CASE WHEN score >= 70 OR step = 1 THEN 'done' ELSE 'stopped' END AS state FROM (VALUES (1, 'readiness'), (2, 'profile'), (3, 'drift')) AS t(step, name),
      (SELECT round_even(0.4 * 100 + 0.4 * 100 + 0.2 * 100, 0) AS score FROM events_cur HAVING count(*) > 0)""", BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    return workflows.profile_workflow(cur, ["event_id"], base).steps


@query("c11_workflow_stops", _READINESS + """
    SELECT step, name, CASE WHEN step = 1 THEN 'done' WHEN round_even(0.4 * a + 0.4 * b + 0.2 * c, 0) < 95 THEN 'stopped' ELSE 'skipped' END AS state
    FROM (VALUES (1, 'readiness'), (2, 'profile'), (3, 'drift')) AS t(step, name), s""", ["orders_mixed"])
def _(spark, d):
    return workflows.profile_workflow(view(spark, d, "orders_mixed"), ["o_orderkey"], stop_below=95).steps


@query("c11_workflow_findings", _READINESS + """
    SELECT 'data_completeness' AS category, 'info' AS severity, NULL AS "column" FROM s UNION ALL SELECT 'data_consistency', 'info', NULL FROM s
    UNION ALL SELECT 'schema_health', 'info', 'origin' FROM s UNION ALL SELECT 'schema_health', 'info', 'code' FROM s
    UNION ALL SELECT 'data_completeness', 'warning', 'price' FROM s UNION ALL SELECT 'data_variance', 'info', 'origin' FROM s""", ["orders_mixed"])
def _(spark, d):
    return workflows.profile_workflow(view(spark, d, "orders_mixed"), ["o_orderkey"]).findings.select("category", "severity", "column")


@query("c11_workflow_status", _READINESS + """
    SELECT round_even(0.4 * a + 0.4 * b + 0.2 * c, 0)::DOUBLE AS readiness_score,
           CASE WHEN round_even(0.4 * a + 0.4 * b + 0.2 * c, 0) >= 85 THEN 'Ready' WHEN round_even(0.4 * a + 0.4 * b + 0.2 * c, 0) >= 70 THEN 'Needs Review' ELSE 'Not Ready' END AS status FROM s""", ["orders_mixed"])
def _(spark, d):
    return workflows.profile_workflow(view(spark, d, "orders_mixed"), ["o_orderkey"]).status.select("readiness_score", "status")


@query("c12_findings_digest", _GOVERNED + """
    SELECT CASE WHEN type IN ('missing_lineage_fields', 'missing_consent_fields', 'missing_classification_fields', 'invalid_consent_status',
                              'invalid_data_classification', 'pii_classification_mismatch') THEN 'critical' ELSE 'warning' END AS severity, count(*) AS count
    FROM findings GROUP BY 1""", ["customer_governed"])
def _(spark, d):
    found = governance.governance(view(spark, d, "customer_governed"), "c_custkey").findings
    return workflows.findings_digest(found).select("severity", "count")


@query("c13_run_record", """
    SELECT 'profile' AS operator, 'lineitem' AS dataset, 11 AS fields, '50' AS categorical_threshold""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    record = workflows.run_record(spark, "profile", "lineitem", df.columns, ProfileParams(), dt.datetime(2024, 5, 1))
    return record.select("operator", "dataset", F.size("fields").alias("fields"),
                         F.col("parameters")["categorical_threshold"].alias("categorical_threshold"))

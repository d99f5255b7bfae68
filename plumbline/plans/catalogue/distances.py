"""Baseline against current: alignments, statistical distances, schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift, frequencies, privacy, schema_drift
from plumbline.operators.facts import column_facts, local_facts
from plumbline.operators.scores import union_all
from plumbline.plans.catalogue.aggregates import risk_points_sql
from plumbline.plans.catalogue.registry import query, rounded, table, union_sql, view

BOTH = ["events_base", "events_cur"]


def _sides(spark, d):
    return view(spark, d, "events_base"), view(spark, d, "events_cur")


def _changed(spark, d):
    """A current schema with a dropped, an added and a retyped column."""
    base, cur = _sides(spark, d)
    return base, cur.drop("props").withColumn("channel", F.lit("web")).withColumn("user_id", F.col("user_id").cast("string"))


_PAIRS = """
    WITH pairs AS (
      SELECT 'event_type' AS "column", coalesce(b.v, c.v) AS value, coalesce(b.n, 0) AS baseline_count, coalesce(c.n, 0) AS current_count
      FROM (SELECT event_type AS v, count(*) AS n FROM events_base GROUP BY 1) b
      FULL OUTER JOIN (SELECT event_type AS v, count(*) AS n FROM events_cur GROUP BY 1) c ON b.v = c.v),
    shares AS (SELECT *, baseline_count / sum(baseline_count) OVER () AS p, current_count / sum(current_count) OVER () AS q,
                      sum(baseline_count) OVER () AS nb, sum(current_count) OVER () AS nc FROM pairs) """


@query("j1_aligned_schemas", """
    SELECT c AS "column", change, CASE change WHEN 'added' THEN NULL ELSE (SELECT count(*) FROM events_base) END AS baseline_rows,
           CASE change WHEN 'dropped' THEN NULL ELSE (SELECT count(*) FROM events_cur) END AS current_rows
    FROM (VALUES ('event_id', 'common'), ('ts', 'common'), ('user_id', 'common'), ('event_type', 'common'),
                 ('value', 'common'), ('props', 'dropped'), ('channel', 'added')) AS t(c, change)""", BOTH)
def _(spark, d):
    base, cur = _changed(spark, d)
    b = column_facts(base).select("column", F.col("row_count").alias("baseline_rows"))
    c = column_facts(cur).select("column", F.col("row_count").alias("current_rows"))
    return drift.column_sets(base, cur).join(b, "column", "left").join(c, "column", "left")


@query("j2_aligned_categories", _PAIRS + 'SELECT "column", value, baseline_count, current_count FROM pairs', BOTH)
def _(spark, d):
    return frequencies.paired_counts(*_sides(spark, d), ["event_type"])


@query("j3_new_and_missing_categories", _PAIRS + """
    SELECT "column", value, CASE WHEN baseline_count = 0 THEN 'new' ELSE 'missing' END AS change, greatest(baseline_count, current_count) AS rows
    FROM pairs WHERE baseline_count = 0 OR current_count = 0""", BOTH)
def _(spark, d):
    pairs = frequencies.paired_counts(*_sides(spark, d), ["event_type"])
    return drift.category_changes(pairs)


@query("j3_long_new_categories", """
    WITH b AS (SELECT text, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL GROUP BY 1),
         c AS (SELECT text, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL GROUP BY 1)
    SELECT 'text' AS "column", coalesce(b.text, c.text) AS value, CASE WHEN b.n IS NULL THEN 'new' ELSE 'missing' END AS change,
           coalesce(b.n, c.n) AS rows FROM b FULL OUTER JOIN c ON b.text = c.text WHERE b.n IS NULL OR c.n IS NULL""")
def _(spark, d):
    df = table(spark, d, "documents")
    return drift.category_changes(frequencies.paired_counts(df.filter("doc_id % 2 = 0"), df.filter("doc_id % 2 = 1"), ["text"]))


@query("j4_catalog_drift", """
    WITH old AS (SELECT DISTINCT concat('customer_', c_nationkey) AS t, concat('col_', c_custkey % 40) AS c FROM customer WHERE c_nationkey < 20),
         new AS (SELECT DISTINCT concat('customer_', c_nationkey) AS t, concat('col_', c_custkey % 40 + c_custkey % 2) AS c FROM customer WHERE c_nationkey >= 3)
    SELECT t AS "table", NULL AS "column", 'table_dropped' AS change FROM old WHERE t NOT IN (SELECT t FROM new) GROUP BY t
    UNION ALL SELECT t, NULL, 'table_added' FROM new WHERE t NOT IN (SELECT t FROM old) GROUP BY t
    UNION ALL SELECT t, c, 'column_dropped' FROM old WHERE t IN (SELECT t FROM new) AND (t, c) NOT IN (SELECT (t, c) FROM new)
    UNION ALL SELECT t, c, 'column_added' FROM new WHERE t IN (SELECT t FROM old) AND (t, c) NOT IN (SELECT (t, c) FROM old)""")
def _(spark, d):
    rows = table(spark, d, "customer").withColumn("table", F.concat(F.lit("customer_"), "c_nationkey"))
    old = rows.filter("c_nationkey < 20").select("table", F.expr("concat('col_', c_custkey % 40)").alias("column"))
    new = rows.filter("c_nationkey >= 3").select("table", F.expr("concat('col_', c_custkey % 40 + c_custkey % 2)").alias("column"))
    return schema_drift.catalog_changes(old, new).drop("severity")


def _ks_sql(columns, base, cur, final):
    return union_sql(columns, f"""
        SELECT {final} FROM (
          SELECT max(abs(cb / nb - cc / nc)) AS d, max(nb) AS n1, max(nc) AS n2 FROM (
            SELECT sum(b) OVER (ORDER BY v) AS cb, sum(c) OVER (ORDER BY v) AS cc, sum(b) OVER () AS nb, sum(c) OVER () AS nc FROM (
              SELECT v, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(c) AS DOUBLE) AS c FROM (
                SELECT CAST($c AS DOUBLE) AS v, 1 AS b, 0 AS c FROM {base} WHERE $c IS NOT NULL
                UNION ALL SELECT CAST($c AS DOUBLE), 0, 1 FROM {cur} WHERE $c IS NOT NULL) GROUP BY v)))""")


_KS_FIELDS = """'$c' AS "column", CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(d, 9) AS ks_statistic"""


@query("t1_ks_statistic", _ks_sql(["event_id", "user_id", "value"], "events_base", "events_cur", _KS_FIELDS), BOTH)
def _(spark, d):
    found = drift.ks_statistics(*_sides(spark, d), ["event_id", "user_id", "value"])
    return rounded(found.select("column", "n1", "n2", "ks_statistic"), 9)


@query("t1_ks_by_ranges", _ks_sql(["user_id", "value"], "events_base", "events_cur", _KS_FIELDS), BOTH)
def _(spark, d):
    found = drift.ks_statistics(*_sides(spark, d), ["user_id", "value"], rows_per_range=500)
    return rounded(found.select("column", "n1", "n2", "ks_statistic"), 9)


_KS_P = """'$c' AS "column", round((SELECT CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
    (SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * l * l)) FROM range(1, 101) AS r(k)))) END
  FROM (SELECT (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS l)), 6) AS p_value"""


@query("t2_ks_p_value", _ks_sql(["event_id", "user_id", "value"], "events_base", "events_cur", _KS_P), BOTH)
def _(spark, d):
    found = drift.ks_statistics(*_sides(spark, d), ["event_id", "user_id", "value"], "asymptotic")
    return rounded(found.select("column", "p_value"))


@query("w4_running_shares", union_sql(["l_quantity", "l_extendedprice"], """
    SELECT '$c' AS "column", $c AS value, round(sum(count(*)) OVER (ORDER BY $c) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 2"""))
def _(spark, d):
    return rounded(drift.running_shares(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 5000), 9, value=2)


def _categories(spark, d):
    return drift.categorical_drift(frequencies.paired_counts(*_sides(spark, d), ["event_type"]))


@query("t3_psi", _PAIRS + """
    SELECT "column", round(sum((greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) - greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))
      * ln(greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) / greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))), 9) AS psi
    FROM shares GROUP BY 1""", BOTH)
def _(spark, d):
    return rounded(_categories(spark, d).select("column", "psi"), 9)


@query("t4_js_distance", _PAIRS + """
    SELECT "column", round(sqrt(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
      + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)), 9) AS js_distance FROM shares GROUP BY 1""", BOTH)
def _(spark, d):
    return rounded(_categories(spark, d).select("column", "js_distance"), 9)


@query("t5_chi_square", _PAIRS + """
    SELECT "column", count(*) - 1 AS dof, round(sum(pow(baseline_count - eb, 2) / eb + pow(current_count - ec, 2) / ec), 6) AS chi_square
    FROM (SELECT *, (baseline_count + current_count) * nb / (nb + nc) AS eb, (baseline_count + current_count) * nc / (nb + nc) AS ec FROM shares) GROUP BY 1""", BOTH)
def _(spark, d):
    return rounded(_categories(spark, d).select("column", "dof", "chi_square"))


# The upper tail of the chi-square distribution, one less the series of the lower incomplete gamma function.
@query("t5_chi_square_p_value", _PAIRS + """,
    k AS (SELECT "column", count(*) - 1 AS dof, sum(pow(baseline_count - eb, 2) / eb + pow(current_count - ec, 2) / ec) AS chi_square
      FROM (SELECT *, (baseline_count + current_count) * nb / (nb + nc) AS eb, (baseline_count + current_count) * nc / (nb + nc) AS ec FROM shares) GROUP BY 1),
    x AS (SELECT *, dof / 2.0 AS a, greatest(chi_square / 2, 1e-12) AS h FROM k),
    t AS (SELECT "column", sum(exp(a * ln(h) - h + n * ln(h) - lgamma(a + 1 + n))) AS lower_tail FROM x, range(0, 600) AS r(n) GROUP BY 1)
    SELECT k."column", dof, round(chi_square, 6) AS chi_square,
           round(CASE WHEN chi_square > 400 THEN 0 ELSE greatest(0, 1 - lower_tail) END, 6)::DOUBLE AS chi_square_p FROM k JOIN t ON k."column" = t."column" """, BOTH)
def _(spark, d):
    return rounded(drift.with_chi_square_p_value(_categories(spark, d)).select("column", "chi_square", "dof", "chi_square_p"))


@query("t6_entropy_change", _PAIRS + """
    SELECT "column", round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 9) AS entropy_baseline,
           round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END), 9) AS entropy_current FROM shares GROUP BY 1""", BOTH)
def _(spark, d):
    return rounded(_categories(spark, d).select("column", "entropy_baseline", "entropy_current"), 9)


@query("t7_mean_shift", union_sql(["user_id", "value"], """
    SELECT '$c' AS "column", round(c.m - b.m, 6) AS mean_shift, CASE WHEN c.m > b.m THEN 'increase' WHEN c.m < b.m THEN 'decrease' ELSE 'none' END AS direction,
           round(c.s - b.s, 6) AS std_dev_change
    FROM (SELECT avg($c) AS m, stddev_samp($c) AS s FROM events_base) b, (SELECT avg($c) AS m, stddev_samp($c) AS s FROM events_cur) c"""), BOTH)
def _(spark, d):
    b, c = (column_facts(t, ("range", "moments"), ["user_id", "value"]) for t in _sides(spark, d))
    return rounded(drift.numeric_shift(b, c).select("column", "mean_shift", "direction", "std_dev_change"))


@query("t8_outlier_introduction", """
    WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events_base)
    SELECT 'value' AS "column",
      (SELECT count(*) FROM events_base, f WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS baseline_outliers,
      (SELECT count(*) FROM events_cur, f WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS current_outliers""", BOTH)
def _(spark, d):
    base, cur = _sides(spark, d)
    found = drift.outlier_introduction(base, cur, local_facts(base, ("quartiles",), columns=["value"]))
    return found.select("column", "baseline_outliers", "current_outliers")


@query("t9_missing_value_drift", union_sql(["o_custkey", "o_orderpriority", "o_totalprice"], """
    SELECT '$c' AS "column", round(b, 6) AS null_pct_baseline, round(c, 6) AS null_pct_current,
           CASE WHEN c > b THEN 'increase' WHEN c < b THEN 'decrease' ELSE 'none' END AS direction
    FROM (SELECT (count(*) - count($c)) * 100.0 / count(*) AS b FROM orders), (SELECT (count(*) - count($c)) * 100.0 / count(*) AS c FROM orders_nulls)"""), ["orders_nulls"])
def _(spark, d):
    names = ["o_custkey", "o_orderpriority", "o_totalprice"]
    b, c = column_facts(table(spark, d, "orders"), columns=names), column_facts(view(spark, d, "orders_nulls"), columns=names)
    return rounded(drift.missing_value_drift(b, c).drop("null_pct_change"))


@query("t10_date_range_shift", """
    SELECT 'ts' AS "column", strftime((SELECT max(ts) FROM events_base), '%Y-%m-%d %H:%M:%S') AS latest_baseline,
           strftime((SELECT max(ts) FROM events_cur), '%Y-%m-%d %H:%M:%S') AS latest_current,
           (SELECT min(ts) FROM events_cur) < (SELECT min(ts) FROM events_base) AS new_earliest,
           (SELECT max(ts) FROM events_cur) > (SELECT max(ts) FROM events_base) AS new_latest""", BOTH)
def _(spark, d):
    b, c = (column_facts(t, ("dates",), ["ts"]) for t in _sides(spark, d))
    form = "yyyy-MM-dd HH:mm:ss"
    return drift.date_range_shift(b, c).select(
        "column", F.date_format("latest_baseline", form).alias("latest_baseline"),
        F.date_format("latest_current", form).alias("latest_current"), "new_earliest", "new_latest")


@query("t11_date_gaps", """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS period FROM (
      SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM gapped)
    WHERE CAST(d AS DATE) NOT IN (SELECT CAST(day AS DATE) FROM gapped)""".join(
    ["WITH gapped AS (SELECT date_trunc('day', ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END) AS day FROM events_base) ", ""]), ["events_base"])
def _(spark, d):
    df = view(spark, d, "events_base").select(
        F.expr("ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END").alias("ts"))
    return drift.date_gaps(df, "ts").select(F.col("period").cast("string").alias("period"))


@query("t12_frequency_change", """
    SELECT coalesce(b.slot, c.slot) AS slot, round(coalesce(b.m, 0), 6) AS baseline_mean, round(coalesce(c.m, 0), 6) AS current_mean,
           CASE WHEN coalesce(c.m, 0) > coalesce(b.m, 0) THEN 'increase' WHEN coalesce(c.m, 0) < coalesce(b.m, 0) THEN 'decrease' ELSE 'none' END AS direction
    FROM (SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS slot, avg(n) AS m FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events_base GROUP BY 1) GROUP BY 1) b
    FULL OUTER JOIN (SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS slot, avg(n) AS m FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events_cur GROUP BY 1) GROUP BY 1) c
    ON b.slot = c.slot""", BOTH)
def _(spark, d):
    return rounded(drift.frequency_change(*_sides(spark, d), "ts").drop("change"))


@query("t11_hour_gaps", """
    WITH e AS (SELECT date_trunc('hour', ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END) AS h FROM events_base)
    SELECT strftime(h, '%Y-%m-%d %H:%M') AS period FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM e)
    WHERE h NOT IN (SELECT h FROM e)""", ["events_base"])
def _(spark, d):
    df = view(spark, d, "events_base").select(
        F.expr("ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END").alias("ts"))
    found = drift.date_gaps(df, "ts", "HOUR")
    return found.select(F.date_format("period", "yyyy-MM-dd HH:mm").alias("period"))


_SPANS = " UNION ALL ".join(f"""
    SELECT '{unit}' AS unit, strftime(b + INTERVAL 1 {unit}, '%Y-%m-%d %H:%M:%S') AS gap_start,
           strftime(p - INTERVAL 1 {unit}, '%Y-%m-%d %H:%M:%S') AS gap_end, CAST(date_diff('{unit}', b, p) - 1 AS BIGINT) AS missing
    FROM (SELECT p, lag(p) OVER (ORDER BY p) AS b FROM (SELECT DISTINCT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS p FROM moved))
    WHERE date_diff('{unit}', b, p) > 1""" for unit in ("DAY", "HOUR", "SECOND"))


@query("t11_gap_intervals", """
    WITH moved AS (SELECT ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 50 DAY ELSE INTERVAL 0 DAY END AS ts FROM events) """ + _SPANS)
def _(spark, d):
    df = table(spark, d, "events").select(
        F.expr("ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 50 DAY ELSE INTERVAL 0 DAY END").alias("ts"))
    form = "yyyy-MM-dd HH:mm:ss"
    return union_all([
        drift.date_gap_spans(df, "ts", unit).select(
            F.lit(unit).alias("unit"), F.date_format("gap_start", form).alias("gap_start"),
            F.date_format("gap_end", form).alias("gap_end"), "missing")
        for unit in ("DAY", "HOUR", "SECOND")])


@query("t12_frequency_change_by_hour", """
    SELECT coalesce(b.slot, c.slot) AS slot, round(coalesce(b.m, 0), 6) AS baseline_mean, round(coalesce(c.m, 0), 6) AS current_mean,
           CASE WHEN coalesce(c.m, 0) > coalesce(b.m, 0) THEN 'increase' WHEN coalesce(c.m, 0) < coalesce(b.m, 0) THEN 'decrease' ELSE 'none' END AS direction
    FROM (SELECT CAST(hour(h) AS INTEGER) AS slot, avg(n) AS m FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events_base GROUP BY 1) GROUP BY 1) b
    FULL OUTER JOIN (SELECT CAST(hour(h) AS INTEGER) AS slot, avg(n) AS m FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events_cur GROUP BY 1) GROUP BY 1) c
    ON b.slot = c.slot""", BOTH)
def _(spark, d):
    return rounded(drift.frequency_change(*_sides(spark, d), "ts", "HOUR").drop("change"))


@query("t13_rename_candidates", """
    SELECT 'c_mktsegment' AS dropped, 'c_market_segment' AS added, round(1 - levenshtein('c_mktsegment', 'c_market_segment') / 16.0, 6) AS similarity""")
def _(spark, d):
    df = table(spark, d, "customer")
    renamed = df.withColumnRenamed("c_mktsegment", "c_market_segment").withColumn("zz", F.lit(1))
    return rounded(drift.rename_candidates(df, renamed))


def _flags_source(spark, d):
    base, cur = _changed(spark, d)
    return base.drop("event_id"), cur.drop("event_id").withColumn(
        "value", F.when(F.col("value") < 30, F.col("value")))


_FLAG_ROWS = """
    SELECT 'ts' AS "column", NULL AS schema_change, false AS type_changed, true AS distribution_drift, false AS missing_drift, true AS date_drift
    UNION ALL SELECT 'user_id', NULL, true, false, false, false
    UNION ALL SELECT 'event_type', NULL, false, (SELECT psi > 0.1 FROM psi), false, false
    UNION ALL SELECT 'value', NULL, false, true, (SELECT count(*) FROM events_cur WHERE value >= 30) > 0, false
    UNION ALL SELECT 'props', 'dropped', false, false, false, false
    UNION ALL SELECT 'channel', 'added', false, false, false, false"""
_PSI_CTE = _PAIRS + """, psi AS (SELECT sum((greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) - greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))
      * ln(greatest(q, CASE WHEN q = 0 THEN 0.0001 ELSE 0 END) / greatest(p, CASE WHEN p = 0 THEN 0.0001 ELSE 0 END))) AS psi FROM shares) """


@query("t14_drift_flags", _PSI_CTE + _FLAG_ROWS, BOTH)
def _(spark, d):
    return drift.drift_flags(*_flags_source(spark, d))


@query("t15_drift_score", _PSI_CTE + f"""
    SELECT round(100.0 * c / n, 6) AS schema_stability, round(100.0 * t / c, 6) AS type_consistency, round(100.0 * s / c, 6) AS distribution_similarity,
           round_even(0.4 * 100.0 * c / n + 0.3 * 100.0 * t / c + 0.3 * 100.0 * s / c, 1) AS drift_score FROM (
      SELECT count(*) AS n, count(*) FILTER (WHERE schema_change IS NULL) AS c,
             count(*) FILTER (WHERE schema_change IS NULL AND NOT type_changed) AS t,
             count(*) FILTER (WHERE schema_change IS NULL AND NOT distribution_drift) AS s FROM ({_FLAG_ROWS}))""", BOTH)
def _(spark, d):
    return rounded(drift.drift_score(drift.drift_flags(*_flags_source(spark, d))))


@query("t16_glossary_ratios", union_sql(["o_custkey", "o_orderpriority"], """
    SELECT '$c' AS "column", round(count(DISTINCT $c) * 100.0 / count(*), 6) AS uniqueness_pct,
           round((count(*) - count($c)) * 100.0 / count(*), 6) AS null_density_pct FROM orders_nulls"""), ["orders_nulls"])
def _(spark, d):
    facts = schema_drift.schema_facts(view(spark, d, "orders_nulls").select("o_custkey", "o_orderpriority"))
    return rounded(facts.select("column", F.col("distinct_pct").alias("uniqueness_pct"), F.col("null_pct").alias("null_density_pct")))


@query("t17_weighted_risk", f"""
    SELECT round_even(0.4 * 100.0 * p / 5 + 0.3 * 0 + 0.3 * CASE WHEN p > 0 THEN 100.0 ELSE 0 END, 1) AS weighted_share,
           CAST(100.0 - CASE WHEN p > 0 THEN 100.0 ELSE 0 END AS DOUBLE) AS governance_coverage_pct
    FROM (SELECT count(*) FILTER (WHERE points > 0) AS p FROM ({risk_points_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents")}))""")
def _(spark, d):
    scores = privacy.risk_scores(privacy.column_risks(table(spark, d, "documents")))
    return scores.agg(
        F.max(F.when(F.col("component") == "weighted_share", F.col("score"))).alias("weighted_share"),
        F.max(F.when(F.col("component") == "governance_coverage_pct", F.col("score"))).alias("governance_coverage_pct"))

"""Scalar functions: conversions, fills, severities, advice and rounding rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import rules, text
from plumbline.operators import nulls, outliers, profile, types
from plumbline.operators.facts import column_facts
from plumbline.params import OutlierParams
from plumbline.plans.catalogue.registry import query, rounded, table, union_sql, view

# Texts in many notations, made from the whole orders table.
_NOTATIONS = """
    SELECT o_orderkey,
      CASE o_orderkey % 9
        WHEN 0 THEN CAST(o_custkey AS VARCHAR(20))
        WHEN 1 THEN concat(' ', CAST(o_custkey AS VARCHAR(20)), '.5 ')
        WHEN 2 THEN concat('-', CAST(o_custkey AS VARCHAR(20)), 'e2')
        WHEN 3 THEN concat(CAST(o_custkey AS VARCHAR(20)), 'd')
        WHEN 4 THEN 'nan'
        WHEN 5 THEN concat('1_', CAST(o_custkey AS VARCHAR(20)))
        WHEN 6 THEN 'twelve'
        WHEN 7 THEN NULL
        ELSE concat('+.', CAST(o_custkey AS VARCHAR(20))) END AS number_text,
      CASE o_orderkey % 6
        WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20))
        WHEN 1 THEN concat('0', CAST(1 + o_orderkey % 9 AS VARCHAR(2)), '/1', CAST(o_custkey % 10 AS VARCHAR(2)), '/2020')
        WHEN 2 THEN concat('1', CAST(o_orderkey % 3 AS VARCHAR(2)), '-2', CAST(o_custkey % 10 AS VARCHAR(2)), '-2021')
        WHEN 3 THEN concat('2020/02/', CAST(20 + o_custkey % 12 AS VARCHAR(2)))
        WHEN 4 THEN 'next week'
        ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), ' 10:20:30') END AS date_text
    FROM {orders}"""


def _notations(spark, d):
    return spark.sql(_NOTATIONS, orders=table(spark, d, "orders"))


_NOTATIONS_SQL = _NOTATIONS.format(orders="orders")


@query("x1_to_number", f"""
    SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 IN (3, 4, 5, 6, 7) THEN NULL
      ELSE CAST(trim(number_text) AS DOUBLE) END, 6) AS value FROM ({_NOTATIONS_SQL})""")
def _(spark, d):
    return rounded(_notations(spark, d).select("o_orderkey", text.to_number(F.col("number_text")).alias("value")))


@query("x2_to_integer", f"""
    SELECT o_orderkey, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS value FROM (
      SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (3, 4, 5, 6, 7) THEN NULL
        ELSE CAST(trim(number_text) AS DOUBLE) END AS v FROM ({_NOTATIONS_SQL}))""")
def _(spark, d):
    return _notations(spark, d).select("o_orderkey", text.to_integer(F.col("number_text")).alias("value"))


@query("x3_to_timestamp", f"""
    SELECT o_orderkey, strftime(CASE o_orderkey % 6
        WHEN 0 THEN try_cast(date_text AS TIMESTAMP)
        WHEN 5 THEN try_cast(date_text AS TIMESTAMP)
        WHEN 3 THEN try_cast(replace(date_text, '/', '-') AS TIMESTAMP)
        WHEN 4 THEN NULL
        ELSE try_cast(concat(substring(date_text, 7, 4), '-', substring(date_text, 1, 2), '-', substring(date_text, 4, 2)) AS TIMESTAMP) END,
      '%Y-%m-%d %H:%M:%S') AS value FROM ({_NOTATIONS_SQL})""")
def _(spark, d):
    return _notations(spark, d).select(
        "o_orderkey", F.date_format(text.to_timestamp(F.col("date_text")), "yyyy-MM-dd HH:mm:ss").alias("value"))


@query("x4_to_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders_nulls", ["orders_nulls"])
def _(spark, d):
    fixed = types.apply_fixes(view(spark, d, "orders_nulls"), {"o_custkey": "string", "o_orderpriority": "string"})
    return fixed.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("x5_to_category", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, d):
    return types.apply_fixes(table(spark, d, "part"), {"p_size": "category"}).select("p_partkey", "p_size")


@query("x6_is_numeric_text", f"""
    SELECT o_orderkey, CASE WHEN number_text IS NOT NULL THEN o_orderkey % 9 NOT IN (3, 6) END AS is_number FROM ({_NOTATIONS_SQL})""")
def _(spark, d):
    return _notations(spark, d).select("o_orderkey", text.is_numeric_text(F.col("number_text")).alias("is_number"))


@query("x7_is_date_text", f"SELECT o_orderkey, o_orderkey % 6 NOT IN (3, 4) AS is_date FROM ({_NOTATIONS_SQL})")
def _(spark, d):
    return _notations(spark, d).select("o_orderkey", text.is_date_text(F.col("date_text")).alias("is_date"))


@query("x8_scalar_fills", """
    SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_nulls)), 4) AS by_mean,
           round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_nulls)), 4) AS by_median,
           coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_nulls WHERE o_orderpriority IS NOT NULL
             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS by_mode,
           coalesce(o_orderpriority, 'unknown') AS by_constant
    FROM orders_nulls""", ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls").selectExpr(
        "o_orderkey", "o_totalprice AS by_mean", "o_totalprice AS by_median",
        "o_orderpriority AS by_mode", "o_orderpriority AS by_constant")
    strategies = {"by_mean": "mean", "by_median": "median", "by_mode": "mode", "by_constant": "constant"}
    values = nulls.scalar_fills(df, strategies, {"by_constant": "unknown"})
    return rounded(nulls.fill_scalars(df, values), 4)


@query("x9_replaced_outliers", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)
             THEN m ELSE l_extendedprice END, 4) AS l_extendedprice
    FROM lineitem_outliers, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b,
                                    quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem_outliers)""", ["lineitem_outliers"])
def _(spark, d):
    df = view(spark, d, "lineitem_outliers")
    p = OutlierParams(strategy="impute_median")
    cleaned = outliers.clean(df, outliers.bounds(df, p, ["l_extendedprice"]).collect(), p)
    return rounded(cleaned.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 4)


@query("x10_nearest_fence_severity", """
    SELECT CASE WHEN least(abs(l_extendedprice - lo), abs(l_extendedprice - hi)) > 3 * (hi - lo) / 4 THEN 'critical' ELSE 'warning' END AS severity,
           count(*) AS n FROM lineitem_outliers, (SELECT
             quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS lo,
             quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS hi
             FROM lineitem_outliers)
    WHERE l_extendedprice < lo OR l_extendedprice > hi GROUP BY 1""", ["lineitem_outliers"])
def _(spark, d):
    df, p = view(spark, d, "lineitem_outliers"), OutlierParams(nearest_fence=True)
    rows = outliers.bounds(df, p, ["l_extendedprice"]).collect()
    found = outliers.outlier_issues(df, ["l_orderkey", "l_linenumber"], rows, p)
    return found.groupBy("severity").agg(F.count("*").alias("n"))


@query("x11_type_compatibility", """
    SELECT c AS "column", old, new, compatibility, (SELECT count(*) FROM orders) AS row_count FROM (VALUES
      ('o_custkey', 'bigint', 'string', 'compatible'), ('o_orderkey', 'bigint', 'double', 'compatible'),
      ('o_totalprice', 'double', 'bigint', 'downgrade'), ('o_orderstatus', 'string', 'string', 'identical'),
      ('o_orderdate', 'timestamp', 'double', 'incompatible'), ('o_orderpriority', 'string', 'boolean', 'downgrade'))
      AS t(c, old, new, compatibility)""")
def _(spark, d):
    old = table(spark, d, "orders")
    new = old.selectExpr(
        "CAST(o_custkey AS STRING) AS o_custkey", "CAST(o_orderkey AS DOUBLE) AS o_orderkey",
        "CAST(o_totalprice AS BIGINT) AS o_totalprice", "o_orderstatus",
        "CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate", "o_orderpriority = '1-URGENT' AS o_orderpriority")
    b = column_facts(old).select("column", F.col("data_type").alias("old"), "row_count")
    c = column_facts(new).select("column", F.col("data_type").alias("new"))
    return b.join(c, "column").select(
        "column", "old", "new", rules.type_compatibility(F.col("old"), F.col("new")).alias("compatibility"), "row_count")


@query("x12_alert_categories", """
    SELECT 'price' AS "column", 'data_completeness' AS category FROM orders_mixed HAVING count(price) < 0.8 * count(*)
    UNION ALL SELECT 'priority', 'data_completeness' FROM orders_mixed HAVING count(priority) < 0.8 * count(*)
    UNION ALL SELECT 'origin', 'data_variance' FROM orders_mixed HAVING count(DISTINCT origin) = 1""", ["orders_mixed"])
def _(spark, d):
    found = profile.profile(view(spark, d, "orders_mixed"), "o_orderkey").findings
    return found.select("column", "category")


_NULL_SHARES = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END AS rare, CASE WHEN o_orderkey % 5 < 2 THEN o_totalprice END AS sparse,
           CASE WHEN o_orderkey % 5 < 3 THEN o_orderpriority END AS common, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS ordered,
           CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END END AS skewed,
           CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS even
    FROM {orders}"""


@query("x13_null_advice", union_sql(["rare", "sparse", "common", "ordered", "skewed", "even"], """
    SELECT '$c' AS "column", round_even(pct, 2) AS null_pct,
           CASE WHEN pct > 70 THEN 'consider_dropping' WHEN pct > 30 THEN 'advanced_imputation' ELSE 'simple_imputation' END AS advice,
           CASE WHEN pct > 70 THEN 'high' WHEN pct > 30 THEN 'medium' ELSE 'low' END AS priority
    FROM (SELECT (count(*) - count($c)) * 100.0 / count(*) AS pct FROM shares)""").join(
        [f"WITH shares AS ({_NULL_SHARES.format(orders='orders')}) ", ""]))
def _(spark, d):
    df = spark.sql(_NULL_SHARES, orders=table(spark, d, "orders"))
    return nulls.null_analysis(column_facts(df, ("skew",))).select("column", "null_pct", "advice", "priority")


@query("x14_fill_strategy", union_sql(["rare", "sparse", "common", "ordered", "skewed", "even"], """
    SELECT '$c' AS "column", CASE WHEN pct > 70 THEN 'drop_column' WHEN pct > 50 THEN 'knn_imputation'
      WHEN '$c' = 'common' THEN 'mode' WHEN '$c' = 'ordered' THEN 'forward_fill'
      WHEN '$c' = 'skewed' AND (SELECT abs(skewness(skewed)) FROM shares) > 1 THEN 'median' ELSE 'mean' END AS suggested_strategy
    FROM (SELECT (count(*) - count($c)) * 100.0 / count(*) AS pct FROM shares)""").join(
        [f"WITH shares AS ({_NULL_SHARES.format(orders='orders')}) ", ""]))
def _(spark, d):
    df = spark.sql(_NULL_SHARES, orders=table(spark, d, "orders"))
    return nulls.null_analysis(column_facts(df, ("skew",))).select("column", "suggested_strategy")


@query("x15_outlier_advice", union_sql(["a", "b", "c"], """
    SELECT '$c' AS "column", CASE WHEN pct > 20 THEN 'review_data_quality' WHEN pct > 5 THEN 'consider_removal' ELSE 'safe_to_remove' END AS advice,
           CASE WHEN pct > 20 THEN 'high' WHEN pct > 5 THEN 'medium' ELSE 'low' END AS priority
    FROM (SELECT count(*) FILTER (WHERE $c < lo - 1.5 * (hi - lo) OR $c > hi + 1.5 * (hi - lo)) * 100.0 / count(*) AS pct
          FROM spread, (SELECT quantile_cont($c, 0.25) AS lo, quantile_cont($c, 0.75) AS hi FROM spread))""").join(
    ["""WITH spread AS (SELECT CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 100 < 96 THEN 1e6 * (1 + o_orderkey % 3) ELSE 5.0 END AS a,
          CASE WHEN o_orderkey % 10 = 0 THEN -1e6 ELSE 5.0 END AS b, CASE WHEN o_orderkey % 50 = 0 THEN 1e6 ELSE 5.0 END AS c FROM orders) """, ""]))
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 100 < 96 THEN 1e6 * (1 + o_orderkey % 3) ELSE 5.0D END AS a",
        "CASE WHEN o_orderkey % 10 = 0 THEN -1e6 ELSE 5.0D END AS b", "CASE WHEN o_orderkey % 50 = 0 THEN 1e6 ELSE 5.0D END AS c")
    return outliers.outlier_summary(df, outliers.bounds(df).collect()).select("column", "advice", "priority")


@query("x16_report_numbers", """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' ELSE '0.5' END AS value FROM orders""")
def _(spark, d):
    value = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN double('nan') WHEN 1 THEN double('inf') WHEN 2 THEN double('-inf') ELSE 0.5D END""")
    return table(spark, d, "orders").select("o_orderkey", text.report_number(value).alias("value"))


@query("x17_status_bands", """
    SELECT CASE WHEN c_acctbal >= 8500 THEN 'Ready' WHEN c_acctbal >= 7000 THEN 'Needs Review' ELSE 'Not Ready' END AS status, count(*) AS n
    FROM customer GROUP BY 1""")
def _(spark, d):
    status = rules.banded(F.col("c_acctbal"), [(8500, "Ready"), (7000, "Needs Review")], "Not Ready")
    return table(spark, d, "customer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("x18_half_even_rounding", "SELECT l_linenumber, round_even(l_linenumber / 2.0, 0) AS rounded, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return df.select("l_linenumber", F.bround(F.col("l_linenumber") / 2.0).alias("rounded"), "n")

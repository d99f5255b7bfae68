"""Aggregations: counts, statistics, frequencies, duplicates, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed, stats
from plumbline.operators import (
    deliveries, duplicates, frequencies, issues, outliers, privacy, profile, readiness, schema_drift, types,
)
from plumbline.operators.facts import column_facts, local_facts, table_counts
from plumbline.operators.scores import mean_scores, union_all
from plumbline.params import OutlierParams
from plumbline.plans.catalogue.registry import query, rounded, table, union_sql, view
from plumbline.sources.writers import scratch_folder

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a1_row_count", "SELECT count(*) AS row_count, 11 AS column_count FROM lineitem")
def _(spark, d):
    return table_counts(table(spark, d, "lineitem")).select("row_count", F.col("column_count").cast("int").alias("column_count"))


@query("a2_null_counts", union_sql(
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"], """
    SELECT '$c' AS "column", count(*) AS row_count, count($c) AS non_null_count, count(*) - count($c) AS null_count,
           round((count(*) - count($c)) * 100.0 / count(*), 6) AS null_pct FROM orders_nulls"""), ["orders_nulls"])
def _(spark, d):
    facts = column_facts(view(spark, d, "orders_nulls"))
    return rounded(facts.select("column", "row_count", "non_null_count", "null_count",
                                stats.percent(F.col("null_count"), F.col("row_count")).alias("null_pct")))


@query("a3_null_cells", """
    SELECT CAST(sum(n) AS BIGINT) AS null_cells, round(sum(n) * 100.0 / (6 * max(total)), 6) AS null_cell_pct FROM (
      SELECT count(*) - count(o_totalprice) AS n, count(*) AS total FROM orders_nulls
      UNION ALL SELECT count(*) - count(o_orderpriority), count(*) FROM orders_nulls)""", ["orders_nulls"])
def _(spark, d):
    return rounded(table_counts(view(spark, d, "orders_nulls")).select("null_cells", "null_cell_pct"))


@query("a4_distinct_counts", union_sql(
    ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], """
    SELECT '$c' AS "column", count(DISTINCT $c) AS distinct_count,
           round(count(DISTINCT $c) * 100.0 / count(*), 6) AS distinct_pct FROM orders_nulls"""), ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(schema_drift.schema_facts(df).select("column", "distinct_count", "distinct_pct"))


_NUMERIC_STATS = """
    SELECT '$c' AS "column", min($c) AS min, max($c) AS max, round(avg($c), 4) AS mean,
           round(quantile_cont($c, 0.5), 4) AS median, round(stddev_samp($c), 4) AS std_dev,
           round(var_samp($c), 1) AS variance, round(quantile_cont($c, 0.25), 4) AS p25,
           round(quantile_cont($c, 0.75), 4) AS p75 FROM lineitem"""


@query("a5_numeric_stats", union_sql(LINEITEM_NUMBERS, _NUMERIC_STATS))
def _(spark, d):
    facts = column_facts(table(spark, d, "lineitem"), ("range", "moments", "quartiles"), LINEITEM_NUMBERS)
    return rounded(facts.select("column", "min", "max", "mean", "median", "std_dev", "variance", "p25", "p75"), 4, variance=1)


@query("a5_numeric_stats_by_narrowing", union_sql(LINEITEM_NUMBERS, """
    SELECT '$c' AS "column", round(quantile_cont($c, 0.25), 4) AS p25, round(quantile_cont($c, 0.5), 4) AS median,
           round(quantile_cont($c, 0.75), 4) AS p75 FROM lineitem"""))
def _(spark, d):
    facts = column_facts(table(spark, d, "lineitem"), ("quartiles",), LINEITEM_NUMBERS)
    return rounded(facts.select("column", "p25", "median", "p75"), 4)


def _outlier_counts_sql(columns, source):
    return union_sql(columns, f"""
        SELECT '$c' AS "column", count(*) FILTER (WHERE $c < a - 1.5 * (b - a) OR $c > b + 1.5 * (b - a)) AS outlier_count
        FROM {source}, (SELECT quantile_cont(CAST($c AS DOUBLE), 0.25) AS a, quantile_cont(CAST($c AS DOUBLE), 0.75) AS b FROM {source})""")


@query("a6_outlier_counts", _outlier_counts_sql(LINEITEM_NUMBERS, "lineitem_outliers"), ["lineitem_outliers"])
def _(spark, d):
    df = view(spark, d, "lineitem_outliers").select(*LINEITEM_NUMBERS)
    return profile.outlier_counts(df, local_facts(df, ("quartiles",)), 1.5)


_COUNTS = """
    SELECT 'lang' AS "column", lang AS value, count(*) AS count FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"""


@query("a7_value_counts", _COUNTS)
def _(spark, d):
    return frequencies.value_counts(table(spark, d, "documents"), ["lang", "source"])


@query("a7_long_value_counts", """SELECT 'text' AS "column", text AS value, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY 2""")
def _(spark, d):
    return frequencies.value_counts(table(spark, d, "documents"), ["text"])


@query("a16_long_mode", """
    SELECT 'text' AS "column", text AS mode, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1""")
def _(spark, d):
    return frequencies.modes(frequencies.value_counts(table(spark, d, "documents"), ["text"]))


@query("a8_relative_frequencies", f"""
    SELECT "column", value, round(count / sum(count) OVER (PARTITION BY "column"), 9) AS share FROM ({_COUNTS})""")
def _(spark, d):
    counts = frequencies.value_counts(table(spark, d, "documents"), ["lang", "source"])
    return rounded(frequencies.relative_frequencies(counts).select("column", "value", "share"), 9)


@query("a9_entropy", f"""
    SELECT "column", count(*) AS distinct_count, round(-sum(p * ln(p)), 9) AS entropy FROM (
      SELECT "column", count / sum(count) OVER (PARTITION BY "column") AS p FROM ({_COUNTS})) GROUP BY "column" """)
def _(spark, d):
    counts = frequencies.value_counts(table(spark, d, "documents"), ["lang", "source"])
    return rounded(frequencies.distribution(counts).select("column", "distinct_count", "entropy"), 9)


@query("a10_temporal_range", """
    SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
           CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS span_days FROM events""")
def _(spark, d):
    p = profile.column_profile(table(spark, d, "events").select("ts"))
    return p.select("column", F.date_format("earliest", "yyyy-MM-dd HH:mm:ss").alias("earliest"),
                    F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), "span_days")


@query("a11_duplicate_rows", """
    SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS unique_rows,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS duplicate_rows,
           round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups))) * 100.0 / count(*), 6) AS duplicate_pct
    FROM orders_dups""", ["orders_dups"])
def _(spark, d):
    return rounded(duplicates.duplicate_summary(view(spark, d, "orders_dups")).drop("duplicate_groups"))


@query("a12_duplicate_groups", """
    SELECT CAST(min(doc_id) AS VARCHAR) AS first_row_id, count(*) AS duplicate_count FROM documents GROUP BY text HAVING count(*) > 1""")
def _(spark, d):
    groups = duplicates.duplicate_groups(table(spark, d, "documents"), "doc_id", ["text"])
    return groups.select("first_row_id", "duplicate_count")


@query("a12_group_members", """
    SELECT array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id)[1:5], ',') AS first_row_ids, count(*) AS duplicate_count
    FROM documents GROUP BY text HAVING count(*) > 1""")
def _(spark, d):
    rows = duplicates.rows_of_duplicate_groups(table(spark, d, "documents"), ["text"])
    return duplicates.group_members(rows, "doc_id").select(
        F.concat_ws(",", "first_row_ids").alias("first_row_ids"), "duplicate_count")


@query("a13_key_duplicates", """
    SELECT 'l_orderkey' AS "column", count(*) AS total, count(*) - count(DISTINCT l_orderkey) AS violations FROM lineitem
    UNION ALL SELECT 'l_comment', count(*), count(*) - count(DISTINCT k) - max(CASE WHEN k IS NULL THEN 1 ELSE 0 END)
    FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS k FROM lineitem)""")
def _(spark, d):
    df = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS l_comment")
    return duplicates.key_duplicates(df, ["l_orderkey", "l_comment"])


@query("a14_constant_columns", union_sql(["o_orderstatus", "o_custkey", "o_orderpriority", "origin"], """
    SELECT '$c' AS "column", CAST(max($c) AS VARCHAR) AS value FROM (SELECT *, 'ERP' AS origin FROM orders)
    HAVING count(DISTINCT $c) = 1 AND count(*) > 1"""))
def _(spark, d):
    facts = column_facts(table(spark, d, "orders").withColumn("origin", F.lit("ERP")), ("constant",))
    return facts.filter("constant").select("column", F.col("sample_value").alias("value"))


@query("a15_skewness", union_sql(LINEITEM_NUMBERS, "SELECT '$c' AS \"column\", round(skewness($c), 6) AS skew FROM lineitem_outliers"), ["lineitem_outliers"])
def _(spark, d):
    facts = column_facts(view(spark, d, "lineitem_outliers"), ("skew",), LINEITEM_NUMBERS)
    return rounded(facts.select("column", stats.sample_skewness(F.col("non_null_count"), F.col("skew")).alias("skew")))


@query("a16_mode", """
    SELECT 'p_brand' AS "column", p_brand AS mode, count FROM (SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    UNION ALL SELECT 'p_type', p_type, count FROM (SELECT p_type, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
def _(spark, d):
    return frequencies.modes(frequencies.value_counts(table(spark, d, "part"), ["p_brand", "p_type"]))


@query("a17_text_lengths", union_sql(["text", "lang", "source"], """
    SELECT '$c' AS "column", min(length($c)) AS min_length, max(length($c)) AS max_length FROM documents"""))
def _(spark, d):
    return column_facts(table(spark, d, "documents"), ("lengths",), ["text", "lang", "source"]).select(
        "column", "min_length", "max_length")


@query("a18_schema_facts", " UNION ALL ".join([
    """SELECT 'o_custkey' AS "column", 'bigint' AS data_type, false AS nullable, 0 AS null_count, count(DISTINCT o_custkey) AS distinct_count,
       CAST(min(o_custkey) AS DOUBLE) AS min, CAST(max(o_custkey) AS DOUBLE) AS max, round(avg(o_custkey), 6) AS mean, NULL AS min_length, NULL AS max_length FROM orders_nulls""",
    """SELECT 'o_totalprice', 'double', true, count(*) - count(o_totalprice), count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice),
       round(avg(o_totalprice), 6), NULL, NULL FROM orders_nulls""",
    """SELECT 'o_orderpriority', 'string', true, count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), NULL, NULL, NULL,
       min(length(o_orderpriority)), max(length(o_orderpriority)) FROM orders_nulls"""]), ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls").select("o_custkey", "o_totalprice", "o_orderpriority")
    return rounded(schema_drift.schema_facts(df).drop("position", "row_count", "null_pct", "distinct_pct"))


_TYPE_SHARE_SQL = union_sql(["cust_text", "date_text", "o_orderpriority"], """
    SELECT '$c' AS "column",
           round(avg(CASE WHEN regexp_matches($c, '^[0-9]+$') THEN 100.0 ELSE 0 END), 6) AS numeric_pct,
           round(avg(CASE WHEN regexp_matches($c, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 100.0 ELSE 0 END), 6) AS date_pct,
           round(avg(CASE WHEN regexp_matches($c, '^[0-9]+$') OR regexp_matches($c, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 0 ELSE 100.0 END), 6) AS text_pct
    FROM orders_text""")


@query("a19_type_shares", _TYPE_SHARE_SQL, ["orders_text"])
def _(spark, d):
    df = view(spark, d, "orders_text").select("cust_text", "date_text", "o_orderpriority")
    return rounded(types.type_shares(column_facts(df, ("shapes",))).select("column", "numeric_pct", "date_pct", "text_pct"))


@query("a20_whole_number_floats", """
    SELECT 'cust_float' AS "column", bool_and(cust_float = floor(cust_float)) AS whole_numbers FROM orders_text
    UNION ALL SELECT 'o_totalprice', bool_and(o_totalprice = floor(o_totalprice)) FROM orders_text""", ["orders_text"])
def _(spark, d):
    df = view(spark, d, "orders_text").select("cust_float", "o_totalprice")
    return column_facts(df, ("shapes",)).select("column", "whole_numbers")


@query("a21_numeric_looking_text", union_sql(["cust_text", "date_text", "o_orderpriority"], """
    SELECT '$c' AS "column", count(*) FILTER (WHERE regexp_matches($c, '^[0-9]+$')) AS numeric_values FROM orders_text"""), ["orders_text"])
def _(spark, d):
    return readiness.numeric_looking_columns(view(spark, d, "orders_text"))


@query("a22_issue_summary", """
    WITH found AS (
      SELECT 'null_value' AS issue_type, 'warning' AS severity, 'o_totalprice' AS c FROM orders_nulls WHERE o_totalprice IS NULL
      UNION ALL SELECT 'null_value', 'warning', 'o_orderpriority' FROM orders_nulls WHERE o_orderpriority IS NULL)
    SELECT 'issue_type' AS dimension, issue_type AS key, count(*) AS count FROM found GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM found GROUP BY 2
    UNION ALL SELECT 'column', c, count(*) FROM found GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*) FROM found""", ["orders_nulls"])
def _(spark, d):
    return issues.issue_summary(issues.null_issues(view(spark, d, "orders_nulls"), "o_orderkey"))


_MEANS = """
    WITH s AS (
      SELECT 100 - n * 100.0 / (6 * total) AS completeness FROM (
        SELECT count(*) AS total, 2 * count(*) - count(o_totalprice) - count(o_orderpriority) AS n FROM orders_nulls)
      UNION ALL SELECT 100 FROM (SELECT count(*) FROM orders))
    SELECT 'completeness' AS component, round_even(avg(round_even(completeness, 0)), 0) AS score, 2 AS datasets FROM s"""


@query("a23_mean_scores", _MEANS, ["orders_nulls"])
def _(spark, d):
    scores = union_all([
        readiness.readiness_scores(readiness.readiness_facts(df), dataset=n)
        for n, df in (("dirty", view(spark, d, "orders_nulls")), ("clean", table(spark, d, "orders")))])
    return mean_scores(scores).filter("component = 'completeness'").select(
        "component", "score", F.col("datasets").cast("int").alias("datasets"))


_PII = fixed.RISK_PII_PATTERNS


def risk_points_sql(columns, source):
    """Points per column: 30 per personal-data type found, 15 for the missing consent."""
    per_type = " + ".join(
        f"max(CASE WHEN regexp_matches(CAST($c AS VARCHAR), '{p}') THEN 1 ELSE 0 END)" for p in _PII.values())
    return union_sql(columns, f"SELECT '$c' AS \"column\", 30 * ({per_type}) AS points FROM {source}")


@query("a24_overall_risk", f"""
    SELECT round_even(avg(points + CASE WHEN points > 0 THEN 15 ELSE 0 END), 0) AS score
    FROM ({risk_points_sql(["doc_id", "text", "lang", "source", "n_chars"], "documents")})""")
def _(spark, d):
    risks = privacy.column_risks(table(spark, d, "documents"))
    return privacy.risk_scores(risks).filter("component = 'overall'").select("score")


@query("a25_severity_counts", """
    SELECT n1 + n2 AS total, 0::BIGINT AS critical, 0::BIGINT AS high, n2 AS warning, 0::BIGINT AS medium, 0::BIGINT AS low, n1 AS info FROM (
      SELECT count(*) FILTER (WHERE o_totalprice IS NULL) AS n1, count(*) FILTER (WHERE o_orderpriority IS NULL) AS n2 FROM orders_nulls)""", ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    found = issues.null_issues(df, "o_orderkey", ["o_totalprice", "o_orderpriority"],
                               {"o_totalprice": "info", "o_orderpriority": "warning"})
    return issues.severity_counts(found)


@query("a26_baseline_stats", """
    SELECT 'value' AS "column", min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_dev
    FROM events_base""", ["events_base"])
def _(spark, d):
    facts = column_facts(view(spark, d, "events_base"), ("range", "moments"), ["value"])
    return rounded(facts.select("column", "min", "max", "mean", "std_dev"))


@query("a6_outlier_shares", """
    SELECT 'l_extendedprice' AS "column", count(*) AS outlier_count, round_even(count(*) * 100.0 / max(n), 2) AS outlier_pct,
           CASE WHEN count(*) * 100.0 / max(n) > 20 THEN 'review_data_quality' WHEN count(*) * 100.0 / max(n) > 5 THEN 'consider_removal' ELSE 'safe_to_remove' END AS advice
    FROM lineitem_outliers, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b, count(*) AS n FROM lineitem_outliers)
    WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)""", ["lineitem_outliers"])
def _(spark, d):
    df = view(spark, d, "lineitem_outliers")
    rows = outliers.bounds(df, OutlierParams(), ["l_extendedprice"]).collect()
    return outliers.outlier_summary(df, rows).select("column", "outlier_count", "outlier_pct", "advice")


@query("a10_profile_of_deliveries", union_sql(
    ["o_orderkey", "o_custkey", "o_totalprice"], """
    SELECT '$c' AS "column", count(*) AS row_count, count(*) - count($c) AS null_count, CAST(min($c) AS DOUBLE) AS min,
           CAST(max($c) AS DOUBLE) AS max, round(avg($c), 4) AS mean, round(stddev_samp($c), 4) AS std_dev FROM orders_nulls"""), ["orders_nulls"])
def _(spark, d):
    orders, folder = view(spark, d, "orders_nulls"), scratch_folder(spark, "deliveries")
    status = F.coalesce(F.col("o_orderstatus"), F.lit("none"))
    # One delivery for each of the few order states.
    for (name,) in orders.select(status).distinct().collect():
        deliveries.save_delivery(orders.filter(status == name), folder, name)
    merged = deliveries.merged_profile(spark, folder).filter(F.col("mean").isNotNull())
    return rounded(merged.select("column", "row_count", "null_count", "min", "max", "mean", "std_dev"), 4)

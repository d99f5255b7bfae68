"""Sources, sinks, projections, sampling, row ids, limits and set operations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.columns import columns_of
from plumbline.operators import duplicates, fills, frequencies, issues, master, nulls, outliers, sampling, schema_drift
from plumbline.operators.facts import column_facts, table_counts
from plumbline.operators.layout import melt_numbers, with_row_id
from plumbline.operators.scores import side_by_side, union_all
from plumbline.params import NullParams, OutlierParams
from plumbline.plans.catalogue.registry import query, table, union_sql, view
from plumbline.plans.workflows import over_tables
from plumbline.sources import readers, writers


@query("s1_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    folder = writers.scratch_folder(spark, "csv")
    table(spark, d, "customer").write.option("header", True).csv(folder)
    return readers.read_csv(spark, folder)


@query("s1_csv_long_integers", """
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 1234567890123450000 + c_custkey AS long_id, concat('98765432109876543210', c_custkey) AS longer_id FROM customer""")
def _(spark, d):
    folder = writers.scratch_folder(spark, "csv")
    table(spark, d, "customer").select(
        "c_custkey", (F.lit(1234567890123450000) + F.col("c_custkey")).alias("long_id"),
        F.concat(F.lit("98765432109876543210"), "c_custkey").alias("longer_id")).write.option("header", True).csv(folder)
    read = readers.read_csv(spark, folder)
    return read.withColumn("longer_id", F.col("longer_id").cast("string"))


@query("s2_tolerant_csv_header_and_breaks", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, chr(10), 'second line') ELSE c_name END AS name FROM customer
    UNION ALL SELECT 'id', 'name' FROM customer WHERE c_custkey = 1""")
def _(spark, d):
    folder = writers.scratch_folder(spark, "breaks")
    df = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\nsecond line"))).otherwise(F.col("c_name")).alias("name"))
    header = df.filter("id = '1'").select(F.lit("id").alias("id"), F.lit("name").alias("name"))
    df.unionByName(header).coalesce(1).write.options(header=True, quoteAll=True).csv(folder)
    return readers.read_csv_tolerant(spark, folder, multi_line=True)[0]


_TOLERANT_LINES = """
    SELECT CASE WHEN c_custkey % 50 = 0 THEN concat(c_custkey, ',', c_name, ',', c_mktsegment, ',spare,more')
                WHEN c_custkey % 40 = 1 THEN concat(c_custkey, ',', c_name)
                ELSE concat(c_custkey, ',"', c_name, ', Ltd",', c_mktsegment) END AS line
    FROM {customer}"""


def _tolerant(spark, d):
    folder = writers.scratch_folder(spark, "lines")
    spark.sql(_TOLERANT_LINES, customer=table(spark, d, "customer")).write.text(folder)
    return readers.read_csv_tolerant(spark, folder, columns=["id", "name", "segment"])


@query("s2_tolerant_csv", """
    SELECT CAST(c_custkey AS BIGINT) AS id,
           CASE WHEN c_custkey % 40 = 1 THEN c_name ELSE concat(c_name, ', Ltd') END AS name,
           CASE WHEN c_custkey % 40 = 1 THEN NULL ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 50 <> 0""")
def _(spark, d):
    return _tolerant(spark, d)[0]


@query("s2_skipped_lines", """
    SELECT count(*) AS lines, count(*) FILTER (WHERE c_custkey % 50 = 0) AS skipped_lines FROM customer""")
def _(spark, d):
    return _tolerant(spark, d)[1]


@query("s3_json_scan", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    folder = writers.scratch_folder(spark, "json")
    table(spark, d, "supplier").write.json(folder)
    return readers.read_json_records(spark, folder, lines=True)


@query("s4_missing_tokens", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0
                           THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def _(spark, d):
    dirty = table(spark, d, "customer").select("c_custkey", F.expr("""
        CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 7 = 0 THEN ' '
             WHEN c_custkey % 11 = 0 THEN 'null' ELSE c_mktsegment END""").alias("segment"))
    return readers.normalize_missing(dirty)


@query("s5_many_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS row_count, {n} AS column_count FROM {t}"
    for t, n in (("nation", 3), ("region", 2), ("supplier", 4), ("customer", 5), ("orders", 6))))
def _(spark, d):
    tables = {t: table(spark, d, t) for t in ("nation", "region", "supplier", "customer", "orders")}
    return over_tables(tables, lambda name, df: table_counts(df).select(
        F.lit(name).alias("dataset"), "row_count", F.col("column_count").cast("int").alias("column_count")))


@query("s6_paired_tables", """
    SELECT 'customer' AS dataset, (SELECT count(*) FROM customer) AS baseline_rows,
           (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS current_rows
    UNION ALL SELECT 'orders', (SELECT count(*) FROM orders),
           (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')""")
def _(spark, d):
    old = {t: table(spark, d, t) for t in ("customer", "orders", "nation")}
    new = {"orders": old["orders"].filter("o_orderstatus <> 'P'"),
           "customer": old["customer"].filter("c_acctbal > 0"), "part": table(spark, d, "part")}
    pairs = readers.pair_tables(old, new)
    return union_all([
        side_by_side([b.agg(F.count("*").alias("baseline_rows")), c.agg(F.count("*").alias("current_rows"))])
        .select(F.lit(name).alias("dataset"), "baseline_rows", "current_rows")
        for name, (b, c) in pairs.items()])


class _NullReport(NamedTuple):
    column_nulls: DataFrame
    top_values: DataFrame


def _null_report(spark, d):
    df = view(spark, d, "orders_nulls")
    return _NullReport(
        column_facts(df).select("column", "row_count", "null_count"),
        frequencies.top_values(frequencies.value_counts(df, ["o_orderpriority", "o_orderstatus"]), 3))


_NULLS_SQL = union_sql(
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"],
    "SELECT '$c' AS \"column\", count(*) AS row_count, count(*) - count($c) AS null_count FROM orders_nulls")


@query("s7_result_sink", _NULLS_SQL, ["orders_nulls"])
def _(spark, d):
    folder = writers.scratch_folder(spark, "results")
    writers.write_results(_null_report(spark, d), folder)
    return spark.read.parquet(f"{folder}/column_nulls")


@query("s8_report_document", _NULLS_SQL, ["orders_nulls"])
def _(spark, d):
    document = writers.report_json(_null_report(spark, d))
    rows = F.from_json(F.get_json_object("report", "$.column_nulls"),
                       "array<struct<column: string, row_count: bigint, null_count: bigint>>")
    return document.select(F.inline(rows))


class _Written(NamedTuple):
    orders: DataFrame


@query("s7_run_record", union_sql(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"], """
    SELECT '$c' AS "column", 'written' AS status, count(*) AS rows, count(*) - count($c) AS nulls FROM orders_nulls"""), ["orders_nulls"])
def _(spark, d):
    folder = writers.scratch_folder(spark, "recorded")
    writers.write_recorded(_Written(view(spark, d, "orders_nulls")), folder, "null_handler", "orders", NullParams())
    record = spark.read.parquet(f"{folder}/run_record")
    return record.select("status", "rows", F.explode("nulls").alias("column", "nulls"))


@query("s8_report_in_parts", _NULLS_SQL, ["orders_nulls"])
def _(spark, d):
    folder = writers.scratch_folder(spark, "report")
    writers.write_recorded(_null_report(spark, d), folder, "null_handler", "orders", fmt="json")
    return spark.read.schema("column string, row_count bigint, null_count bigint").json(f"{folder}/column_nulls")


_EXTENDED_FENCES = """
    WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b
               FROM lineitem_outliers)"""


@query("s9_cleaned_sink", _EXTENDED_FENCES + """
    SELECT l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem_outliers, q
    WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)
    GROUP BY l_linenumber""", ["lineitem_outliers"])
def _(spark, d):
    df = view(spark, d, "lineitem_outliers")
    bounds = outliers.bounds(df, OutlierParams(), ["l_extendedprice"]).collect()
    folder = writers.scratch_folder(spark, "cleaned")
    paths = writers.write_cleaned({"lineitem": outliers.clean(df, bounds)}, folder)
    cleaned = readers.read_parquet(spark, paths["lineitem"])
    return cleaned.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("p1_fields_scanned", " UNION ALL ".join(
    f"SELECT table_name AS dataset, column_name AS \"column\", CAST(ordinal_position - 1 AS INTEGER) AS position, "
    f"(SELECT count(*) FROM {t}) AS row_count FROM information_schema.columns WHERE table_name = '{t}'"
    for t in ("orders", "customer", "documents")))
def _(spark, d):
    return over_tables(
        {t: table(spark, d, t) for t in ("orders", "customer", "documents")},
        lambda name, df: column_facts(df).select(F.lit(name).alias("dataset"), "column", "position", "row_count"))


@query("p2_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    df = table(spark, d, "orders")
    return df.select(*columns_of(df, "numeric"))


@query("p3_drop_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice FROM orders_nulls", ["orders_nulls"])
def _(spark, d):
    return nulls.apply_strategies(view(spark, d, "orders_nulls"), {"o_orderpriority": "drop_column"}, "o_orderkey")[0]


@query("p4_long_form", union_sql(["p_partkey", "p_size", "p_retailprice"],
                                 "SELECT '$c' AS \"column\", CAST($c AS DOUBLE) AS value FROM part"))
def _(spark, d):
    return melt_numbers(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"])


@query("p5_masked_values", """
    SELECT c_custkey, CASE WHEN length(c_name) > 3 THEN concat(substring(c_name, 1, 3), '***') ELSE '***' END AS name,
           CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 3
                THEN concat(substring(CAST(c_custkey AS VARCHAR), 1, 3), '***') ELSE '***' END AS id
    FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", text.mask(F.col("c_name")).alias("name"), text.mask(F.col("c_custkey")).alias("id"))


@query("p6_shortened_text", "SELECT doc_id, substring(text, 1, 100) AS start FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("start"))


@query("p7_shape_report", """
    SELECT 'before' AS state, count(*) AS row_count, 6 AS column_count FROM orders_nulls
    UNION ALL SELECT 'after', count(*), 5 FROM orders_nulls WHERE o_totalprice IS NOT NULL""", ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    after = df.drop("o_orderpriority").na.drop("any")
    return union_all([
        table_counts(t).select(F.lit(s).alias("state"), "row_count", F.col("column_count").cast("int").alias("column_count"))
        for s, t in (("before", df), ("after", after))])


@query("p8_sample_values", union_sql(["cust_text", "date_text"], """
    SELECT * FROM (SELECT '$c' AS "column", CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS position,
                          $c AS value FROM orders_text WHERE $c IS NOT NULL) WHERE position <= 5"""), ["orders_text"])
def _(spark, d):
    return sampling.first_non_null(view(spark, d, "orders_text"), ["cust_text", "date_text"], 5, ["o_orderkey"])


@query("w1_first_issues", union_sql(["o_totalprice", "o_orderpriority"], """
    SELECT * FROM (SELECT '$c' AS "column", CAST(o_orderkey AS VARCHAR) AS row_id, 'null_value' AS issue_type
                   FROM orders_nulls WHERE $c IS NULL ORDER BY o_orderkey LIMIT 20)"""), ["orders_nulls"])
def _(spark, d):
    found = issues.null_issues(view(spark, d, "orders_nulls"), "o_orderkey")
    return issues.first_per_kind(found, 20).select("column", "row_id", "issue_type")


_FILL = """
    SELECT o_orderkey, {f}(o_orderpriority IGNORE NULLS) OVER (ORDER BY o_orderkey {w}) AS o_orderpriority,
           {f}(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderkey {w}) AS o_totalprice
    FROM orders_nulls"""


@query("w2_forward_fill", _FILL.format(f="last_value", w="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    filled = fills.forward_fill(df, ["o_orderpriority", "o_totalprice"], ["o_orderkey"])
    return filled.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("w3_backward_fill", _FILL.format(f="first_value", w="ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"), ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    filled = fills.backward_fill(df, ["o_orderpriority", "o_totalprice"], ["o_orderkey"])
    return filled.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("w2_forward_fill_by_customer", """
    SELECT o_orderkey, o_custkey,
           last_value(o_totalprice IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_totalprice
    FROM orders_nulls""", ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    filled = fills.forward_fill(df, ["o_totalprice"], ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return filled.select("o_orderkey", "o_custkey", "o_totalprice")


@query("w5_value_ranks", """
    SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (
      SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS count,
             row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY p_brand
      UNION ALL SELECT 'p_name', p_name, count(*), row_number() OVER (ORDER BY count(*) DESC, p_name)
      FROM part GROUP BY p_name) WHERE rank <= 5""")
def _(spark, d):
    counts = frequencies.value_counts(table(spark, d, "part"), ["p_brand", "p_name"])
    return frequencies.top_values(counts, 5)


@query("w6_row_ids", """
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events""")
def _(spark, d):
    return with_row_id(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "row_id")


_TOP_SQL = """
    SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (
      SELECT 'source' AS "column", source AS value, count(*) AS count,
             row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source
      UNION ALL SELECT 'text', text, count(*), row_number() OVER (ORDER BY count(*) DESC, text) FROM documents GROUP BY text) WHERE rank <= 10"""


@query("l1_top_values", _TOP_SQL)
def _(spark, d):
    return frequencies.top_values(frequencies.value_counts(table(spark, d, "documents"), ["source", "text"]), 10)


@query("l1_frequent_values", _TOP_SQL)
def _(spark, d):
    return frequencies.frequent_values(table(spark, d, "documents"), ["source", "text"], 10)


@query("l2_reported_issues", """
    SELECT row_id, "column" FROM (
      SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS row_id, 'o_totalprice' AS "column" FROM orders_nulls WHERE o_totalprice IS NULL
      UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 'o_orderpriority' FROM orders_nulls WHERE o_orderpriority IS NULL)
    ORDER BY o_orderkey, "column" LIMIT 100""", ["orders_nulls"])
def _(spark, d):
    found = issues.null_issues(view(spark, d, "orders_nulls"), "o_orderkey")
    return issues.reported(found).select("row_id", "column")


_OUTLIER_LIST = _EXTENDED_FENCES + """
    SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) AS row_id
    FROM lineitem_outliers, q
    WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)
    ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT {n}"""


def _listed_outliers(spark, d, n):
    df = view(spark, d, "lineitem_outliers")
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    bounds = outliers.bounds(df, OutlierParams(), ["l_extendedprice"]).collect()
    found = outliers.outlier_issues(df, key, bounds, OutlierParams())
    return issues.first_per_kind(found, n, ("column",)).select("row_id")


@query("l3_outlier_sample", _OUTLIER_LIST.format(n=5), ["lineitem_outliers"])
def _(spark, d):
    return _listed_outliers(spark, d, 5)


@query("l4_listed_outliers", _OUTLIER_LIST.format(n=50), ["lineitem_outliers"])
def _(spark, d):
    return _listed_outliers(spark, d, 50)


@query("l5_first_non_null", union_sql(["o_totalprice", "o_orderpriority"], """
    SELECT '$c' AS "column", count(*) AS values, min(k) AS first_key, max(k) AS last_key FROM (
      SELECT o_orderkey AS k FROM orders_nulls WHERE $c IS NOT NULL ORDER BY o_orderkey LIMIT 100)"""), ["orders_nulls"])
def _(spark, d):
    df = view(spark, d, "orders_nulls")
    keys = df.select("o_orderkey", *[
        F.when(F.col(c).isNotNull(), F.col("o_orderkey")).alias(c) for c in ("o_totalprice", "o_orderpriority")])
    sample = sampling.first_non_null(keys, ["o_totalprice", "o_orderpriority"], 100, ["o_orderkey"])
    key = F.col("value").cast("bigint")
    return sample.groupBy("column").agg(
        F.count("*").alias("values"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def _catalogs(spark, d):
    names = ("customer", "orders", "nation")
    old = {t: table(spark, d, t) for t in names}
    new = {"customer": old["customer"].drop("c_name").withColumn("c_email", F.lit("x")),
           "orders": old["orders"], "part": table(spark, d, "part")}
    return old, new


@query("u1_column_sets", """
    SELECT c AS "column", change FROM (VALUES
      ('c_custkey', 'common'), ('c_nationkey', 'common'), ('c_acctbal', 'common'),
      ('c_mktsegment', 'common'), ('c_name', 'dropped'), ('c_email', 'added')) AS t(c, change)""")
def _(spark, d):
    from plumbline.operators.drift import column_sets

    old, new = _catalogs(spark, d)
    return column_sets(old["customer"], new["customer"])


@query("u2_table_sets", """
    SELECT t AS dataset, change, CASE t WHEN 'nation' THEN (SELECT count(*) FROM nation)
           ELSE (SELECT count(*) FROM part) END AS row_count
    FROM (VALUES ('nation', 'table_dropped'), ('part', 'table_added')) AS x(t, change)""")
def _(spark, d):
    old, new = _catalogs(spark, d)
    changes = schema_drift.catalog_changes(schema_drift.catalog_of(old), schema_drift.catalog_of(new))
    sizes = over_tables({**old, **new}, lambda n, df: df.agg(F.count("*").alias("row_count")).withColumn("dataset", F.lit(n)))
    tables = changes.filter(F.col("column").isNull()).select(F.col("table").alias("dataset"), "change")
    return tables.join(F.broadcast(sizes), "dataset")


@query("u3_category_union", """
    SELECT DISTINCT event_type AS value FROM (
      SELECT event_type FROM events_base UNION ALL SELECT event_type FROM events_cur)""", ["events_base", "events_cur"])
def _(spark, d):
    pairs = frequencies.paired_counts(view(spark, d, "events_base"), view(spark, d, "events_cur"), ["event_type"])
    return pairs.select("value")


@query("u4_all_findings", """
    SELECT 'orders' AS dataset, 'o_totalprice' AS "column", count(*) AS n FROM orders_nulls WHERE o_totalprice IS NULL
    UNION ALL SELECT 'orders', 'o_orderpriority', count(*) FROM orders_nulls WHERE o_orderpriority IS NULL
    UNION ALL SELECT 'customers', 'source_system', count(*) FROM customer_governed WHERE source_system IS NULL
    UNION ALL SELECT 'customers', 'created_date', count(*) FROM customer_governed WHERE created_date IS NULL
    UNION ALL SELECT 'customers', 'consent_status', count(*) FROM customer_governed WHERE consent_status IS NULL""",
       ["orders_nulls", "customer_governed"])
def _(spark, d):
    tables = {"orders": (view(spark, d, "orders_nulls"), "o_orderkey"),
              "customers": (view(spark, d, "customer_governed"), "c_custkey")}
    every = union_all([issues.null_issues(df, key, dataset=n) .select("dataset", "column") for n, (df, key) in tables.items()])
    return every.groupBy("dataset", "column").agg(F.count("*").alias("n"))


@query("u5_distinct_items", "SELECT DISTINCT text FROM documents")
def _(spark, d):
    return master.distinct_items(table(spark, d, "documents"), "text")


@query("u5_item_counts", "SELECT count(*) AS original_rows, count(DISTINCT text) AS unique_rows FROM documents")
def _(spark, d):
    return duplicates.duplicate_summary(table(spark, d, "documents"), ["text"]).select(
        F.col("row_count").alias("original_rows"), "unique_rows")

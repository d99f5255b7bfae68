"""Registry of queries, the given tables, and the derived input views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Derived inputs with planted defects.  The same text serves both engines.
VIEWS = {
    "orders_nulls": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    "orders_dups": """
        SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 50 = 0""",
    "lineitem_outliers": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
               CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END
                 AS l_extendedprice
        FROM {lineitem}""",
    "orders_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS cust_text,
               CASE WHEN o_orderkey % 19 = 0 THEN 'soon'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS date_text,
               o_orderpriority,
               CAST(o_custkey AS DOUBLE) AS cust_float,
               o_totalprice
        FROM {orders}""",
    "events_base": "SELECT * FROM {events} WHERE ts < DATE '2024-01-16'",
    "events_cur": """
        SELECT event_id, ts, user_id, props, value * 1.5 AS value,
               CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'scroll' ELSE event_type END
                 AS event_type
        FROM {events} WHERE ts >= DATE '2024-01-16'""",
    "customer_governed": """
        SELECT c_custkey, c_name, c_mktsegment,
               CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Billing'
                    ELSE 'CRM' END AS source_system,
               CASE WHEN c_custkey % 33 = 0 THEN NULL ELSE '2024-01-01' END AS created_date,
               CASE WHEN c_custkey % 20 = 0 THEN 'maybe' WHEN c_custkey % 6 = 0 THEN 'withdrawn'
                    WHEN c_custkey % 25 = 0 THEN NULL ELSE 'granted' END AS consent_status,
               CASE WHEN c_custkey % 30 = 0 THEN 'not a date' ELSE '2024-03-05' END AS consent_date,
               CASE WHEN c_custkey % 10 = 0 THEN 'public' WHEN c_custkey % 77 = 0 THEN 'top'
                    ELSE 'internal' END AS data_classification,
               CASE WHEN c_custkey % 3 = 0
                    THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com')
                    ELSE 'none' END AS contact
        FROM {customer}""",
    "customer_sensitive": """
        SELECT c_custkey, c_name AS full_name, c_acctbal AS salary_amount,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS marketing_opt_in,
               c_mktsegment AS api_key_hint, c_nationkey AS tax_id
        FROM {customer}""",
    "orders_mixed": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, 'ERP' AS origin,
               CASE WHEN o_custkey % 10 = 0 THEN CAST(o_custkey AS VARCHAR(20)) ELSE 'x' END AS code
        FROM {orders}
        UNION ALL
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END, 'ERP',
               CASE WHEN o_custkey % 10 = 0 THEN CAST(o_custkey AS VARCHAR(20)) ELSE 'x' END
        FROM {orders} WHERE o_orderkey % 20 = 0""",
    "people": """
        SELECT c_custkey AS person_id, c_mktsegment AS segment,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    WHEN c_custkey % 2 = 0
                    THEN concat(' User', CAST(c_custkey % 700 AS VARCHAR(20)), '@Example.com ')
                    ELSE concat('user', CAST(c_custkey % 700 AS VARCHAR(20)), '@example.com') END AS email,
               CASE WHEN c_custkey % 3 = 0
                    THEN concat('(555) ', CAST(100000 + c_custkey % 900 AS VARCHAR(20)))
                    ELSE concat('555-', CAST(100000 + c_custkey % 900 AS VARCHAR(20))) END AS phone
        FROM {customer}""",
    "customer_typos": """
        SELECT person_id, CASE WHEN person_id % 17 = 0 THEN NULL WHEN person_id % 3 = 0 THEN tag
               WHEN person_id % 3 = 1 THEN concat(substring(tag, 1, place - 1), 'x', substring(tag, place + 1))
               WHEN person_id % 5 = 0 THEN concat(' ', upper(substring(tag, 1, place)), 'yz', substring(tag, place + 1))
               ELSE concat(substring(tag, 1, place - 1), substring(tag, place + 1)) END AS tag
        FROM (SELECT c_custkey AS person_id, c_custkey % 12 + 1 AS place,
                     substring(md5(CAST(c_custkey % 499 AS VARCHAR(20))), 1, 12) AS tag FROM {customer}) AS tagged""",
}
_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived input, as Spark SQL over the given table."""
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(names: list[str], body: str) -> str:
    """The SQL twin's text: its derived inputs as common table expressions."""
    same = {t: t for t in _TABLES}
    parts = [f"{n} AS ({VIEWS[n].format(**same)})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Register a query (and its SQL twin) under a name."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_views(views, sql) if views else sql
        return function
    return register


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double":
            c = F.round(c, by_column.get(f.name, digits)).alias(f.name)
        out.append(c)
    return df.select(*out)


def union_sql(columns: list[str], template: str) -> str:
    """One SELECT per column, joined by UNION ALL."""
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


def text_of(name: str) -> Column:
    return F.col(name).cast("string")

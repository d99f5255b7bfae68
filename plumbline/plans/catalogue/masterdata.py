"""Duplicate rows, nearest donors, entities and the master-data steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import duplicates, master, neighbors, privacy
from plumbline.plans import workflows
from plumbline.plans.catalogue.aggregates import _PII
from plumbline.plans.catalogue.registry import VIEWS, query, rounded, table, view


@query("j6_rows_of_duplicate_groups", """
    SELECT doc_id, n AS duplicate_count FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""")
def _(spark, d):
    return duplicates.rows_of_duplicate_groups(table(spark, d, "documents"), ["text"]).select("doc_id", "duplicate_count")


_KNN = """
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer),
    near AS (
      SELECT r.k AS id, b.k AS donor, b.v AS value, row_number() OVER (PARTITION BY r.k
               ORDER BY sqrt(((r.k - b.k) * (r.k - b.k) + (r.n - b.n) * (r.n - b.n)) * 3.0 / 2), b.k) AS rank
      FROM c r, c b WHERE r.v IS NULL AND b.v IS NOT NULL) """


def _sparse_customers(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey", "c_nationkey", "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal", "c_mktsegment")


@query("w7_nearest_donors", _KNN + "SELECT id, donor, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 5")
def _(spark, d):
    near = neighbors.nearest_donors(_sparse_customers(spark, d), "c_acctbal", "c_custkey", 5, block_rows=500)
    return near.select("id", "donor", "rank")


@query("j7_knn_fill", _KNN + """
    SELECT k AS c_custkey, round(coalesce(v, (SELECT avg(value) FROM near WHERE id = k AND rank <= 5)), 4) AS c_acctbal FROM c""")
def _(spark, d):
    filled = neighbors.knn_fill(_sparse_customers(spark, d), "c_acctbal", "c_custkey", 5)
    return rounded(filled.select("c_custkey", "c_acctbal"), 4)


@query("j8_same_key_entities", """
    SELECT person_id, CASE WHEN email IS NULL THEN person_id ELSE min(person_id) OVER (PARTITION BY lower(trim(email))) END AS entity_id
    FROM people""", ["people"])
def _(spark, d):
    return master.resolve_by_key(view(spark, d, "people"), "email", "person_id").select("person_id", "entity_id")


@query("m1_tagged_source", """
    SELECT c_custkey, 'CRM' AS source_system, '2024-05-01 00:00:00' AS created_date FROM customer""")
def _(spark, d):
    tagged = master.tag_source(table(spark, d, "customer"), "CRM", "2024-05-01 00:00:00")
    return tagged.select("c_custkey", "source_system", F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created_date"))


# Least person over everyone reachable by equal e-mails or equal phone digits.
_COMPONENTS = """
    WITH RECURSIVE k AS (
      SELECT person_id AS id, '0' || lower(trim(email)) AS link FROM ({people}) WHERE email IS NOT NULL
      UNION ALL SELECT person_id, '1' || regexp_replace(phone, '[^0-9]', '', 'g') FROM ({people})),
    edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.link = b.link),
    reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
    SELECT a AS person_id, min(b) AS entity_id FROM reach GROUP BY a""".format(
    people=VIEWS["people"].format(customer="customer"))


@query("m2_resolved_entities", _COMPONENTS)
def _(spark, d):
    resolved = master.resolve_entities(view(spark, d, "people"), {"email": "text", "phone": "phone"}, "person_id")
    return resolved.select("person_id", "entity_id")


# Least person over everyone reachable by keys of at most $d edits.
_SIMILAR = """
    WITH RECURSIVE k AS (SELECT person_id, lower(trim(tag)) AS tag FROM ({people})),
    tags AS (SELECT tag, min(person_id) AS first FROM k WHERE tag IS NOT NULL GROUP BY tag),
    edges AS (SELECT a.tag AS a, b.tag AS b FROM tags a JOIN tags b ON abs(length(a.tag) - length(b.tag)) <= $d AND levenshtein(a.tag, b.tag) <= $d),
    reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    least AS (SELECT a AS tag, min(first) AS entity FROM reach JOIN tags ON b = tags.tag GROUP BY a)
    SELECT person_id, coalesce(entity, person_id) AS entity_id FROM k LEFT JOIN least ON k.tag = least.tag""".format(
    people=VIEWS["customer_typos"].format(customer="customer"))


@query("m2_similar_keys", _SIMILAR.replace("$d", "1"))
def _(spark, d):
    return master.resolve_similar(view(spark, d, "customer_typos"), "tag", "person_id", 1).select("person_id", "entity_id")


@query("m2_similar_keys_two_edits", _SIMILAR.replace("$d", "2"))
def _(spark, d):
    return master.resolve_similar(view(spark, d, "customer_typos"), "tag", "person_id", 2).select("person_id", "entity_id")


@query("m3_deduplicated", """
    SELECT min(doc_id) AS doc_id, length(text)::INTEGER AS length FROM documents GROUP BY text""")
def _(spark, d):
    kept = master.deduplicate(table(spark, d, "documents"), ["text"], ["doc_id"])
    return kept.select("doc_id", F.length("text").alias("length"))


@query("m3_deduplicated_rows", "SELECT DISTINCT * FROM orders_dups", ["orders_dups"])
def _(spark, d):
    return master.deduplicate(view(spark, d, "orders_dups"))


@query("m3_report", """
    SELECT count(*) AS original_rows, count(DISTINCT text) AS unique_rows, count(*) - count(DISTINCT text) AS removed_rows FROM documents""")
def _(spark, d):
    return master.deduplicate_with_report(table(spark, d, "documents"), ["text"], ["doc_id"]).report


_TAGS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, p in _PII.items())


@query("m4_compliance_tags", f"""
    SELECT doc_id, pii_types, pii_types <> '' AS contains_pii FROM (SELECT doc_id, concat_ws(',', {_TAGS}) AS pii_types FROM documents)""")
def _(spark, d):
    return privacy.tag_compliance(table(spark, d, "documents"), ["text"]).select("doc_id", "pii_types", "contains_pii")


def _any_pii(column: str) -> str:
    tests = " OR ".join(f"regexp_matches(CAST({column} AS VARCHAR), '{p}')" for p in _PII.values())
    return f"coalesce({tests}, false)"


_TERMS = {"c_custkey": "", "full_name": "", "salary_amount": "salary", "marketing_opt_in": "", "api_key_hint": "api_key", "tax_id": "tax_id"}


@query("m4_column_tags", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", CASE WHEN {'true' if term else 'false'} AND bool_or({_any_pii(c)}) THEN 'restricted'
           WHEN {'true' if term else 'false'} OR bool_or({_any_pii(c)}) THEN 'confidential' ELSE 'internal' END AS suggested_classification
    FROM customer_sensitive""" for c, term in _TERMS.items()), ["customer_sensitive"])
def _(spark, d):
    risks = privacy.column_risks(view(spark, d, "customer_sensitive"))
    return privacy.column_tags(risks).select("column", "suggested_classification")


@query("m4_numeric_columns", f"""
    SELECT o_orderkey, {_any_pii("phone")} AS contains_pii FROM (SELECT o_orderkey, 2025550000 + o_custkey AS phone FROM orders)""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", (F.lit(2025550000) + F.col("o_custkey")).alias("phone"))
    return privacy.tag_compliance(df, ["phone"]).select("o_orderkey", "contains_pii")


@query("m5_master_report", f"""
    SELECT 'documents' AS dataset, (SELECT count(*) FROM documents) AS original_rows, (SELECT count(*) FROM kept) AS unique_rows,
           (SELECT count(*) FROM documents) - (SELECT count(*) FROM kept) AS removed_rows,
           (SELECT count(DISTINCT lower(trim(text))) FROM documents) AS entities,
           (SELECT count(*) FROM kept WHERE concat_ws(',', {_TAGS}) <> '') AS pii_rows""".join(
    ["WITH kept AS (SELECT text, lang, source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY ALL) ", ""]))
def _(spark, d):
    result = workflows.master_workflow(
        table(spark, d, "documents"), "doc_id", {"text": "text"}, "CRAWL", "2024-05-01 00:00:00",
        ["text", "lang", "source", "n_chars"], dataset="documents")
    return result.report


@query("m5_master_table", """
    SELECT min(doc_id) AS doc_id, 'CRAWL' AS source_system, min(min(doc_id)) OVER (PARTITION BY lower(trim(text))) AS entity_id
    FROM documents GROUP BY text, lang, source, n_chars""")
def _(spark, d):
    result = workflows.master_workflow(
        table(spark, d, "documents"), "doc_id", {"text": "text"}, "CRAWL", "2024-05-01 00:00:00",
        ["text", "lang", "source", "n_chars"], dataset="documents")
    return result.table.select("doc_id", "source_system", "entity_id")


@query("m5_stopped_workflow", """
    SELECT step, name, CASE WHEN step < 3 THEN 'done' WHEN step = 3 THEN CASE WHEN (SELECT count(DISTINCT text) FROM documents) < (SELECT count(*) FROM documents)
             THEN 'stopped' ELSE 'done' END ELSE 'skipped' END AS state
    FROM (VALUES (1, 'tag_source'), (2, 'resolve_entities'), (3, 'deduplicate'), (4, 'tag_compliance')) AS t(step, name)""")
def _(spark, d):
    df = table(spark, d, "documents")
    report = workflows.master_workflow(
        df, "doc_id", {"text": "text"}, dedup_on=["text"], stop_when={"deduplicate": lambda t: t.count() < df.count()})
    return report.steps

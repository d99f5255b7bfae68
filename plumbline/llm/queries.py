"""The operators as queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, exact_dedup, fim, html, language, line_dedup, mixing, near_dedup, quality, search, sharding, simhash, surrogates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


@query("op1_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
         g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, FALSE) AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, folder, "documents"), exact_dedup.DigestIndex(spark))


@query("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_line_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicate_runs(_table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_near_dedup", """
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
    u AS (SELECT doc_id, unnest(g) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
          WHERE 100 * n >= 85 * (len(sa.g) + len(sb.g) - n)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
    m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
    SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
    FROM s JOIN m USING (doc_id)""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents")).drop("mark")


@query("op6_pii_surrogates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replaced(_table(spark, folder, "documents").select("doc_id", "text"), b"catalogue key")


@query("op7_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    done = mixing.mix(_table(spark, folder, "documents"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = bpe.encode(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(tokens, ranks))


@query("op11_fill_in_middle", """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
    g AS (
        SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
               CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
    f AS (
        SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                    WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
    p AS (
        SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(_table(spark, folder, "documents")))


@query("op12_simhash_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""


@query("op13_ranked_search", f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
    t AS (SELECT doc_id, x, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM d) GROUP BY 1, 2),
    q AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS x FROM benchmark) GROUP BY 1, 2),
    v AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
          FROM t JOIN s ON TRUE GROUP BY x, docs),
    r AS (SELECT item_id, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
          FROM q JOIN t USING (x) JOIN v USING (x) JOIN s ON TRUE GROUP BY 1, 2)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM r WHERE score > 0 QUALIFY rank <= 10""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))

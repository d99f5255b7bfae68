"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A delivery is reduced to one row per digest
before its shuffle, compared with the index by a sort-merge anti-join in which the index side is read bucket by bucket
without a shuffle, and its new digests are appended.

Defined cases. A null text counts as empty. Rows that repeat a doc_id with an equal text are one document: they all come
back, marked alike. A null doc_id counts in its group and never stays, unless the group has no other id; then ``keep_id``
is null and no row is kept. An empty table gives an empty result. Only doc_id and text are read; other columns may have
any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.support import attach, shared_folder, stored


class DigestIndex:
    """Digests of all texts delivered so far, in the folder ``path``; the first delivery of a text keeps its document."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark = spark
        self.path = path or shared_folder(spark, "digest-index")
        self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests that the index lacks. ``groups``: one row per digest with its keep_id."""
        dealt = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        dealt.hint("merge").join(self.table(), "digest", "left_anti").write.insertInto(self.name)

    def close(self) -> None:
        """Forget the table's name; the files stay and a later index may open them."""
        self.spark.sql(f"DROP TABLE {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Add a delivery to the index and decide on each of its rows.

    Of equal texts within the delivery the largest doc_id stays, unless an earlier delivery had the text: then its
    document stays and the delivery's rows go. ``group_size`` counts the rows of this delivery with the text.
    """
    rows = stored(digests(docs), "digests")
    total = rows.count()
    groups = stored(
        rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.append(groups)
    sizes = groups.select("digest", "group_size").repartition(index.buckets, "digest")
    known = sizes.hint("merge").join(index.table(), "digest")
    found = attach(rows, known, "digest", "group_size", total, F.col("doc_id"))
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

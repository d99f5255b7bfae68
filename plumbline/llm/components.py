"""Connected components of a table of links, by alternating large-star and small-star steps.

A node with many links is a hub. Its links look up its least neighbour by ``attach``, so that they need not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import attach, stored


def _with_least(links: DataFrame, node: str, other: str, total: int) -> DataFrame:
    """The links with ``m``, the least ``other`` of their ``node``."""
    key = F.encode(F.col(node).cast("string"), "UTF-8")
    least = links.groupBy(key.alias("mark")).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("n"))
    return attach(links.withColumn("mark", key), least, "mark", "n", total, F.col(other))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    return _with_least(both, "u", "v", 2 * total).where(F.col("v") > F.col("u")).select(
        F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. links: a > b."""
    found = _with_least(links, "a", "b", total)
    # A node itself goes with the least neighbour; the others go to that neighbour.
    return found.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """The least node that each linked node can reach: (node, component). links: two columns of ids, a and b."""
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = stored(ordered.distinct(), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b"), F.col("b")).distinct())
        before = state
        larger = stored(_large_star(now, state[0]).distinct(), "links-larger")
        now = stored(_small_star(larger, larger.count()).distinct(), "links")

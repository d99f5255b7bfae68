"""Mixing sources to target weights by subset-sum budget fitting.

Sources get shares of a budget by weight, at most ``most`` times their own size. Within a source, documents are counted
by exact size. The words that whole passes leave over are spread over the sizes in proportion, and what then still lacks
is fitted by bounded-knapsack dynamic programming over sizes and counts. Which documents of a size are taken follows from
a seeded hash of the document, so that reruns agree.

A source's plan needs one row per distinct size, in one task per source. Rows are only ranked within a 1/SPREAD slice of
the documents of one source and size, so a hot source or a hot size is split.

Defined cases. A null text has size 0 and takes 0. A null source is a source of its own, last in order. Rows that repeat a
document are documents of their own. An empty table gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.support import columns_of, stored, unused
from plumbline.sources.state import small_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SPREAD = 256
# Words that the dynamic programming fits; above them documents are added in order of their rounding loss.
FITTED = 20_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """The words each source should give. What a source has above ``most`` times its size is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, budget = list(order), share * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if budget * weight[s] / whole > most * sizes[s]]
        if not above:
            return out | {s: budget * weight[s] / whole for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
        budget -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def _reach(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that the sum is the largest possible up to ``budget`` (bounded knapsack).

    The reachable sums are the bits of an integer. Counts are split into powers of two; it ends once the budget is reached.
    """
    parts: list[tuple[int, int]] = []
    states, limit = [1], (1 << (budget + 1)) - 1
    for i, (size, count) in enumerate(zip(sizes, counts)):
        step = 1
        while size > 0 and count > 0 and min(step, count) * size <= budget and not states[-1] >> budget:
            k = min(step, count)
            count, step = count - k, 2 * step
            parts.append((i, k))
            states.append((states[-1] | (states[-1] << (k * size))) & limit)
    at, out = states[-1].bit_length() - 1, [0] * len(counts)
    for (i, k), before in zip(reversed(parts), reversed(states[:-1])):
        if not before >> at & 1:
            out[i] += k
            at -= k * sizes[i]
    return out


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take, so that their sizes sum to ``budget``, or nearly so.

    Of a budget over half of all words, the documents to leave are fitted: there are more ways to fill what is small.
    """
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    if 2 * budget > total:
        return [c - t for c, t in zip(counts, fit(sizes, counts, total - budget))]
    exact = [c * budget / total for c in counts]
    take = [min(c, int(e)) for c, e in zip(counts, exact)]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    for i in sorted(range(len(sizes)), key=lambda i: (take[i] - exact[i], sizes[i])):
        if take[i] < counts[i] and 0 < sizes[i] <= rest - FITTED:
            take[i] += 1
            rest -= sizes[i]
    unit = math.gcd(*sizes) or 1
    more = _reach([s // unit for s in sizes], [c - t for c, t in zip(counts, take)], rest // unit)
    return [t + m for t, m in zip(take, more)]


def _draw(seed: int) -> Column:
    """A seeded number for a document, by its id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Each document with its size, its source's size and target, and the words that the mix takes of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        _draw(seed).alias("_draw"),
    ).withColumn("_slice", F.pmod("_draw", F.lit(SPREAD)).cast("int"))
    rows = stored(rows, "mix-sizes")
    spark = docs.sparkSession
    # One row per source.
    sizes = {r["source"]: r["total"] for r in rows.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    goal = targets(sizes, weights, share, most)
    passes = {s: min(most, int(goal[s] // sizes[s])) if sizes[s] else 0 for s in sizes}
    plan_of = small_table(
        spark, [(s, sizes[s], goal[s], passes[s], round(goal[s]) - passes[s] * sizes[s]) for s in sizes],
        "source string, source_size bigint, target double, passes bigint, budget bigint")

    slices = rows.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("n"))
    by_size = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_size = by_size.join(plan_of, by_size["source"].eqNullSafe(plan_of["source"])).drop(plan_of["source"])

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size").reset_index(drop=True)
        budget = int(frame["budget"].iloc[0])
        frame["take"] = fit(frame["size"].tolist(), frame["n"].tolist(), max(0, budget)) if len(frame) else []
        return frame[["source", "size", "source_size", "target", "passes", "take"]]

    planned = by_size.groupBy("source").applyInPandas(
        plan, "source string, size bigint, source_size bigint, target double, passes bigint, take bigint")
    planned = planned.withColumnRenamed("source", "_source").withColumnRenamed("size", "_size")
    earlier = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    quotas = slices.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        planned, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    quotas = stored(quotas.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("_slice").alias("_part"),
        "source_size", "target", "passes", F.least(F.col("n"), F.greatest(F.lit(0), F.col("take") - F.col("_before"))).alias("_quota")),
        "mix-quotas")
    drawn = Window.partitionBy("source", "size", "_slice").orderBy("_draw", "doc_id")
    ranked = rows.withColumn("_rank", F.row_number().over(drawn)).join(
        quotas,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_slice") == F.col("_part")))
    copies = F.col("passes") + F.when(F.col("_rank") <= F.col("_quota"), 1).otherwise(0)
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("bigint").alias("taken"),
        copies.cast("int").alias("copies"), "_draw")


def mixture(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as the mix takes it."""
    id_, draw, copies, n_rows, own, turn, time = unused(docs, "id", "draw", "copies", "n_rows", "own", "turn", "time")
    taken = mix(docs, seed, weights, share, most).groupBy(F.col("doc_id").alias(id_), F.col("_draw").alias(draw)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n_rows)).where(F.col(copies) > 0)
    # Rows with one id, text and source share a draw: what the mix takes of them is dealt out among them.
    equal = Window.partitionBy("doc_id", own).orderBy(F.lit(0))
    drawn = docs.withColumn(own, _draw(seed)).withColumn(turn, F.row_number().over(equal))
    found = drawn.join(taken, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(draw)))
    times = F.floor((F.col(copies) + F.col(n_rows) - F.col(turn)) / F.col(n_rows)).cast("int")
    return found.withColumn(time, F.explode(F.array_repeat(F.lit(0), times))).select(*columns_of(docs))

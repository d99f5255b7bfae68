"""Helpers that several operators share: stored tables, skew-safe lookups, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.state import shared_folder, stored  # noqa: F401

# A key that holds at least 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000

# Bytes of text that one numpy step looks at; longer texts come alone.
STEP_BYTES = 4 << 20


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with marks in front until the table has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """A table's columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``groups`` (one row per binary ``key``, never null) to ``rows``, safe for hot keys.

    Keys with at least 1/1000 of the ``total`` rows number at most 1000: they are broadcast. Their rows, and rows
    without a key, take a key of their own from ``spread`` in the shuffled join, so that they do not meet in one task.
    """
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE >= total).select(
        F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    # With a key that no row has, the plan is the same whether there are hot keys or not.
    none = groups.sparkSession.range(1).select(
        F.lit(b"\x00none").alias("_hot_key"), *[F.lit(None).cast(groups.schema[c].dataType).alias(f"_hot_{c}") for c in values])
    hot = hot.unionByName(none)
    cold = groups.where(F.col(size) * HOT_SHARE < total).select(F.col(key).alias("_cold_key"), *values)
    own = F.concat(F.lit(b"\x00spread"), F.encode(F.hex(F.xxhash64(spread)), "UTF-8"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_probe", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    out = out.join(cold, F.col("_probe") == F.col("_cold_key"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in values])


def join_spread(rows: DataFrame, values: DataFrame, key: str, spread: Column, counted: DataFrame) -> DataFrame:
    """Inner join of wide ``values`` (one or few rows per ``key``) to ``rows``, safe for hot keys without a broadcast of values.

    A key with at least 1/1000 of the rows has its values copied once for each such share, and its rows are dealt out to the
    copies; so there are at most 2000 more of them. ``counted``: the keys of the rows, as a stored table.
    """
    share = max(1, counted.count() // HOT_SHARE)
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(
        F.col(key).alias("_key"), F.ceil(F.col("_n") / share).cast("int").alias("_copies"))
    # At most HOT_SHARE keys.
    hot = F.broadcast(hot)

    def with_copies(df: DataFrame) -> DataFrame:
        found = df.join(hot, F.col(key) == F.col("_key"), "left")
        return found.withColumn("_copies", F.coalesce("_copies", F.lit(1))).drop("_key")

    dealt = with_copies(rows).withColumn("_copy", F.pmod(F.xxhash64(spread), F.col("_copies")).cast("int")).drop("_copies")
    copied = with_copies(values).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return dealt.join(copied, [key, "_copy"]).drop("_copy")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Hand unused memory back to the system: Spark keeps a Python worker, with what it holds, for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, giving back memory before and after it: what an earlier task's function held is free only then."""
    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from function(batches)
        give_back()

    return run


def map_steps(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str = "text",
              size: int = STEP_BYTES, release: bool = False) -> DataFrame:
    """``function`` over the batches of a table, cut by ``steps``. release: its tasks give back memory."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps([batch.rename_columns(names)], text, size):
                yield function(step)

    # Spark reads a dot in a column's name as the way to a field.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(released(run) if release else run, schema)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and their number in each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(text, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    filled = full.to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = group_sums(filled.astype(np.int64), lengths)
    return (flat if filled.all() else flat.filter(full)), counts


def codes_of(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal values, and the distinct values."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def group_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over runs of ``values`` with the given lengths (which may be 0)."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

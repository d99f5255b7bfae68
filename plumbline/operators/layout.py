"""Table layouts the operators share: long form, row digests, safe joins, order.

Nothing here sends a whole table, or one unbounded group of it, to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, columns_of
from plumbline.functions.text import plain_number
from plumbline.sources.state import as_local, durable, small_table

# A key is hot from 1/HOT_SHARE of the rows on, so at most HOT_SHARE keys are.
HOT_SHARE = 1_000
LONG_TEXT = 100


def sql_literal(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else repr(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def aggregate_rows(df: DataFrame, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """One global aggregate, returned as one row per dict of ``rows``.

    Values are aggregate Columns or literals; a field that a row does not have
    is null.  All rows come from the same scan.
    """
    if not rows:
        return small_table(df.sparkSession, [], ", ".join(f"`{n}` {t}" for n, t in types.items()))
    measures, cells = [], []
    for i, row in enumerate(rows):
        parts = []
        for field, kind in types.items():
            value = row.get(field)
            if isinstance(value, Column):
                measures.append(value.alias(f"m{i}_{field}"))
                source = f"m{i}_{field}"
            else:
                source = sql_literal(value)
            parts.append(f"'{field}', cast({source} as {kind})")
        cells.append(f"named_struct({', '.join(parts)})")
    return df.agg(*measures).selectExpr(f"inline(array({', '.join(cells)}))")


def text_form(df: DataFrame, name: str) -> Column:
    """A column as text; nested values as JSON, NaN as null."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        # Adding zero turns -0.0 into 0.0, so equal numbers have equal text.
        return F.when(~F.isnan(col(name)), (col(name) + F.lit(0.0)).cast("string"))
    return col(name).cast("string")


def written_form(df: DataFrame, name: str) -> Column:
    """A column as text for pattern searches: numbers without an exponent."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return plain_number(F.when(~F.isnan(col(name)), col(name)))
    return text_form(df, name)


def melt(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Wide to long: one (column, value) row per cell, value as text."""
    names = columns or df.columns
    keys = keys or []
    texts = [text_form(df, n).alias(n) for n in names]
    kept = [col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    aliases = [f"key_{i}" for i in range(len(keys))]
    wide = df.select(*kept, *texts)
    return wide.unpivot(aliases, [col(n) for n in names], "column", "value")


def melt_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide to long for numeric and boolean columns: values as double, no nulls."""
    if not columns:
        return small_table(df.sparkSession, [], "column string, value double")
    boolean = set(columns_of(df, "boolean"))
    numbers = [
        (col(n).cast("int") if n in boolean else col(n)).cast("double").alias(n) for n in columns
    ]
    long = df.select(*numbers).unpivot([], [col(n) for n in columns], "column", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 32-byte digest of a row; nulls equal each other and nothing else.

    Every cell is written with its length before it, so that different rows
    never give the same text.
    """
    cells = [text_form(df, n) for n in (columns or df.columns)]
    framed = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in cells
    ]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def key_text(key: str | list[str]) -> Column:
    """The caller's key columns as one text value that identifies a row."""
    names = [key] if isinstance(key, str) else list(key)
    if len(names) == 1:
        return col(names[0]).cast("string")
    return F.concat_ws("|", *[col(n).cast("string") for n in names])


def key_columns(key: str | list[str]) -> list[Column]:
    return [col(n) for n in ([key] if isinstance(key, str) else key)]


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "inner",
    stored: bool = False,
    hot_by: str | None = None,
) -> DataFrame:
    """Join to a right side that has one row per key, safe for hot left keys.

    Keys with at least 1/``HOT_SHARE`` of the left rows, so at most that many
    keys, are looked up by broadcast; the others are shuffled, where Spark still
    turns to a broadcast if the right side is small in bytes.  So no task gets
    all rows of a frequent key, however many there are.  ``hot_by`` names a right
    column that already holds the key frequencies; without it the left side is
    read once more to count them.  The right side is written once (unless
    ``stored``).  Left rows without a key never match.
    """
    right = right if stored else durable(right)
    if hot_by:
        ranked = right.select(on, F.col(hot_by).alias("_frequency"))
    else:
        ranked = left.groupBy(on).agg(F.count("*").alias("_frequency"))
    hot = _hot_keys(ranked.filter(col(on).isNotNull()), on)
    if not hot:
        return left.join(right, on, how)
    if how != "left":
        left = left.filter(col(on).isNotNull())
    # The left side is read once: its rows look up the hot keys first, and those that found one, or have no key, take a key of
    # their own kind to the shuffled join.
    values = [c for c in right.columns if c != on]
    is_hot = F.broadcast(small_table(left.sparkSession, [(k,) for k in hot], T.StructType([left.schema[on]])).select(col(on).alias("_key")))
    hot_right = F.broadcast(right.join(is_hot, col(on) == F.col("_key"), "left_semi").select(
        col(on).alias("_hot_key"), F.struct(F.lit(True), *[col(c) for c in values]).alias("_hot")))
    cold_right = right.select(col(on).alias("_cold_key"), F.struct(F.lit(True), *[col(c) for c in values]).alias("_cold"))
    found = left.join(hot_right, col(on) == F.col("_hot_key"), "left")
    aside = F.col("_hot_key").isNotNull() | col(on).isNull()
    spread = F.when(aside, F.rand(7)).otherwise(F.lit(-1.0))
    found = found.withColumns({"_cold_probe": F.when(~aside, col(on)), "_spread": spread})
    cold_right = cold_right.withColumn("_even", F.lit(-1.0))
    found = found.join(cold_right, (F.col("_cold_probe") == F.col("_cold_key")) & (F.col("_spread") == F.col("_even")), "left")
    if how != "left":
        found = found.filter(F.col("_hot_key").isNotNull() | F.col("_cold_key").isNotNull())
    chosen = F.coalesce("_hot", "_cold")
    kept = [c for c in left.columns if c != on]
    values = [] if how == "left_semi" else values
    return found.select(col(on), *[col(c) for c in kept], *[chosen.getField(c).alias(c) for c in values])


def _hot_keys(ranked: DataFrame, on: str) -> list:
    """The keys with their share of the rows: at most ``HOT_SHARE``."""
    total = ranked.agg(F.sum("_frequency")).first()[0] or 0
    return [r[0] for r in ranked.filter(F.col("_frequency") * HOT_SHARE >= F.lit(total)).select(col(on)).collect()]


def range_buckets(df: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """Split a table into ordered ranges and name each row's range ``_bucket``.

    The result is durable: the ranges come from sampling and must not be drawn
    anew when a lost task is run again.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(
        df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id())
    )


def with_row_id(
    df: DataFrame, order_by: list[str], name: str = "row_id", buckets: int | None = None
) -> DataFrame:
    """Consecutive ids 0..n-1 in the given order, without a one-task sort.

    ``order_by`` must identify rows for the ids to be repeatable.
    """
    order = [col(n) for n in order_by]
    ranged = range_buckets(df, order, buckets)
    sizes = sorted((r["_bucket"], r["n"]) for r in
                   ranged.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    offsets, start = [], 0
    for bucket, n in sizes:
        offsets.append((bucket, start))
        start += n
    table = small_table(df.sparkSession, offsets, "_bucket int, _start bigint")
    within = Window.partitionBy("_bucket").orderBy(*order)
    return (
        ranged.withColumn("_position", F.row_number().over(within))
        .join(F.broadcast(table), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_position") - 1)
        .drop("_bucket", "_start", "_position")
    )

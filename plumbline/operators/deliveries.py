"""Profile state of deliveries: each delivery of a table is read once, and any set of them is profiled from what was kept.

A delivery's state has one row per column: counts, extremes, moments, and two mergeable sketches, a HyperLogLog of the values' text
and a KLL of the numbers. Merged counts, extremes, means and deviations are those of all rows together; ``distinct`` has a
relative standard error of 1.04 / sqrt(2 ** distinct_bits), the quartiles a rank error of about 2.3 / ranks ** 0.9 (99 %).

Defined cases. NaN is null. A column that a delivery lacks counts that delivery's rows nowhere; ``data_types`` names every type
that a column had. A delivery stored again replaces the one of that name. The row in ``deliveries`` is written last: state whose
writing broke off is never seen. An empty delivery counts with no rows; columns without numbers have no quartiles.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import kind_of, type_name
from plumbline.operators.facts import BATCH, number, present
from plumbline.operators.layout import aggregate_rows, text_form
from plumbline.sources.state import small_table

_STATE = {
    "column": "string", "data_type": "string", "row_count": "bigint", "non_null_count": "bigint",
    "numbers": "bigint", "min": "double", "max": "double", "mean": "double", "variance": "double",
    "earliest": "timestamp", "latest": "timestamp", "min_length": "bigint", "max_length": "bigint",
    "values": "binary", "ranks": "binary",
}
_DELIVERIES = "delivery string, folder string, saved timestamp"


@dataclass(frozen=True)
class SketchParams:
    """Sizes of the sketches; states merge only if they were stored with the same sizes."""

    distinct_bits: int = 14
    ranks: int = 800


def delivery_state(df: DataFrame, params: SketchParams = SketchParams()) -> DataFrame:
    """One row per column, from one scan per ``BATCH`` columns."""
    def row(name: str) -> dict:
        value, kind = present(df, name), kind_of(df.schema[name].dataType)
        out = {"column": name, "data_type": type_name(df, name), "row_count": F.count("*"), "non_null_count": F.count(value),
               "values": F.hll_sketch_agg(text_form(df, name), F.lit(params.distinct_bits))}
        if kind in ("numeric", "boolean"):
            v = number(df, name)
            out |= {"numbers": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "variance": F.var_pop(v),
                    "ranks": F.kll_sketch_agg_double(v, F.lit(params.ranks))}
        elif kind == "temporal":
            out |= {"earliest": F.min(value.cast("timestamp")), "latest": F.max(value.cast("timestamp"))}
        elif kind == "text":
            out |= {"min_length": F.min(F.length(value)), "max_length": F.max(F.length(value))}
        return out

    chunks = [df.columns[i:i + BATCH] for i in range(0, len(df.columns), BATCH)]
    return reduce(DataFrame.unionByName, [aggregate_rows(df, [row(n) for n in some], _STATE) for some in chunks])


def save_delivery(df: DataFrame, folder: str, delivery: str, params: SketchParams = SketchParams()) -> None:
    """Read a delivery once and keep its state."""
    part = f"{folder}/state/{uuid.uuid4().hex}"
    delivery_state(df, params).coalesce(1).write.parquet(part)
    row = small_table(df.sparkSession, [(delivery, part, dt.datetime.now())], _DELIVERIES)
    row.write.mode("append").parquet(f"{folder}/deliveries")


def saved_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The state folder in force of each delivery."""
    try:
        rows = spark.read.schema(_DELIVERIES).parquet(f"{folder}/deliveries")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = small_table(spark, [], _DELIVERIES)
    return rows.groupBy("delivery").agg(F.max_by("folder", F.struct("saved", "folder")).alias("folder"), F.max("saved").alias("saved"))


def merged_profile(spark: SparkSession, folder: str, deliveries: list[str] | None = None) -> DataFrame:
    """One row per column over all stored deliveries, or the named ones; no delivery is read again."""
    # One folder name per delivery.
    places = {r["delivery"]: r["folder"] for r in saved_deliveries(spark, folder).collect()}
    missing = sorted(set(deliveries or []) - set(places))
    if missing:
        raise ValueError(f"no stored delivery {', '.join(missing)} in {folder}")
    paths = [places[d] for d in sorted(places if deliveries is None else set(deliveries))]
    schema = ", ".join(f"`{n}` {t}" for n, t in _STATE.items())
    state = spark.read.schema(schema).parquet(*paths) if paths else small_table(spark, [], schema)

    # Second moments about the common mean: those within deliveries and those between their means.
    whole = Window.partitionBy("column")
    common = F.sum(F.col("mean") * F.col("numbers")).over(whole) / F.sum("numbers").over(whole)
    moment = F.col("numbers") * (F.col("variance") + (F.col("mean") - F.col("common")) * (F.col("mean") - F.col("common")))
    filled = F.when(F.col("numbers") > 0, F.col("ranks"))
    merged = state.withColumn("common", common).groupBy("column").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("data_type"))).alias("data_types"), F.count("*").alias("deliveries"),
        F.sum("row_count").alias("row_count"), F.sum("non_null_count").alias("non_null_count"),
        (F.sum("row_count") - F.sum("non_null_count")).alias("null_count"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.first("common", ignorenulls=True).alias("mean"),
        F.when(F.sum("numbers") > 1, F.sqrt(F.sum(moment) / (F.sum("numbers") - 1))).alias("std_dev"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct"),
        F.sum("numbers").alias("_numbers"), F.kll_merge_agg_double(filled).alias("_ranks"),
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
    held = F.when(F.col("_numbers") > 0, F.col("_ranks"))
    quartiles = {n: F.kll_sketch_get_quantile_double(held, F.lit(q)) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))}
    return merged.withColumns(quartiles).drop("_numbers", "_ranks")

"""Per-column facts from one wide aggregate, returned one row per column.

All columns of a table are aggregated in the same scan; columns that no fact
needs are not read.  Very wide tables are split into batches so that the
generated code keeps a workable size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.columns import col, kind_of, type_name
from plumbline.operators import quantiles
from plumbline.operators.layout import aggregate_rows
from plumbline.sources.state import as_local, small_table

BATCH = 100
QUARTILES = [0.25, 0.5, 0.75]

_TYPES = {
    "position": "int", "column": "string", "data_type": "string", "kind": "string",
    "row_count": "bigint", "non_null_count": "bigint", "null_count": "bigint",
    "min": "double", "max": "double", "mean": "double",
    "variance": "double", "std_dev": "double", "std_pop": "double", "skew": "double",
    "p25": "double", "median": "double", "p75": "double",
    "earliest": "timestamp", "latest": "timestamp", "parsed_dates": "bigint",
    "numbers": "bigint", "numeric_text": "bigint", "date_text": "bigint", "whole_numbers": "boolean",
    "constant": "boolean", "sample_value": "string",
    "min_length": "bigint", "max_length": "bigint",
}
_PARTS = {
    "range": ["min", "max", "mean"],
    "moments": ["variance", "std_dev", "std_pop"],
    "skew": ["skew"],
    "quartiles": ["p25", "median", "p75"],
    "dates": ["earliest", "latest", "parsed_dates"],
    "shapes": ["numeric_text", "date_text", "whole_numbers"],
    "numbers": ["numbers"],
    "constant": ["constant", "sample_value"],
    "lengths": ["min_length", "max_length"],
}


def number(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as double, NaN as null."""
    kind = kind_of(df.schema[name].dataType)
    value = (col(name).cast("int") if kind == "boolean" else col(name)).cast("double")
    plain = df.schema[name].dataType.simpleString()
    return text.nan_to_null(value) if plain in ("double", "float") else value


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    if df.schema[name].dataType.simpleString() in ("double", "float"):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def _measures(df: DataFrame, name: str, parts: set[str]) -> dict[str, Column]:
    kind = kind_of(df.schema[name].dataType)
    value = present(df, name)
    counted = F.count(value)
    total = F.count("*")
    out = {"row_count": total, "non_null_count": counted, "null_count": total - counted}
    if kind in ("numeric", "boolean"):
        v = number(df, name)
        if "range" in parts:
            out |= {"min": F.min(v), "max": F.max(v), "mean": F.avg(v)}
    if kind == "numeric":
        if "moments" in parts:
            # One second moment per column; the deviations follow from it.
            variance = F.var_samp(v)
            out |= {
                "variance": variance,
                "std_dev": F.sqrt(variance),
                "std_pop": F.when(counted == 1, 0.0).otherwise(F.sqrt(variance * (counted - 1) / counted)),
            }
        if "skew" in parts:
            out["skew"] = F.skewness(v)
        if "shapes" in parts:
            out["whole_numbers"] = F.bool_and((v == F.floor(v)) & (F.abs(v) < float("inf")))
    elif kind == "text":
        if "dates" in parts:
            dates = text.to_timestamp(value)
            out |= {"earliest": F.min(dates), "latest": F.max(dates), "parsed_dates": F.count(dates)}
        if "numbers" in parts:
            out["numbers"] = F.count_if(text.converts_to_number(value))
        if "shapes" in parts:
            out["numeric_text"] = F.count_if(text.is_numeric_text(value))
            out["date_text"] = F.count_if(~text.is_numeric_text(value) & text.is_date_text(value))
        if "lengths" in parts:
            size = F.length(value)
            out |= {"min_length": F.min(size), "max_length": F.max(size)}
    elif kind == "temporal" and "dates" in parts:
        moment = value.cast("timestamp")
        out |= {"earliest": F.min(moment), "latest": F.max(moment), "parsed_dates": counted}
    if "constant" in parts:
        comparable = value if kind != "other" else F.to_json(value)
        low = F.min(comparable)
        out |= {
            "constant": F.coalesce((low == F.max(comparable)) & (total > 1), F.lit(False)),
            "sample_value": low.cast("string"),
        }
    return out


def column_facts(
    df: DataFrame,
    parts: tuple[str, ...] = (),
    columns: list[str] | None = None,
) -> DataFrame:
    """One row per column with counts and the facts of the named parts."""
    names = columns or df.columns
    wanted = set(parts)
    fields = ["row_count", "non_null_count", "null_count"]
    for part in parts:
        fields += [f for f in _PARTS[part] if f not in fields]
    positions = {f.name: i for i, f in enumerate(df.schema.fields)}

    def batch(some: list[str]) -> DataFrame:
        rows = []
        for name in some:
            rows.append({
                "position": positions[name],
                "column": name,
                "data_type": type_name(df, name),
                "kind": kind_of(df.schema[name].dataType),
                **_measures(df, name, wanted),
            })
        types = {f: _TYPES[f] for f in ("position", "column", "data_type", "kind", *fields)}
        return aggregate_rows(df, rows, types)

    chunks = [names[i : i + BATCH] for i in range(0, len(names), BATCH)]
    long = reduce(DataFrame.unionByName, [batch(c) for c in chunks])
    if "quartiles" in wanted:
        long = _with_narrowed(df, names, long)
    return long


def _with_narrowed(df: DataFrame, names: list[str], long: DataFrame) -> DataFrame:
    numeric = [n for n in names if kind_of(df.schema[n].dataType) == "numeric"]
    if not numeric:
        return long
    found = quantiles.narrowed(df, {n: number(df, n) for n in numeric}, QUARTILES)
    table = small_table(df.sparkSession, 
        [(n, *found[n]) for n in numeric],
        "column string, p25 double, median double, p75 double",
    )
    rest = long.drop("p25", "median", "p75")
    return rest.join(F.broadcast(table), "column", "left").select(long.columns)


def local_facts(df: DataFrame, parts: tuple[str, ...] = (), **options) -> DataFrame:
    """``column_facts`` evaluated once; O(columns) rows."""
    return as_local(column_facts(df, parts, **options))


def table_counts(df: DataFrame) -> DataFrame:
    """Row count, column count, null cells and their share of all cells."""
    facts = column_facts(df)
    return facts.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.sum("null_count").alias("null_cells"),
        F.when(F.sum("row_count") > 0, F.sum("null_count") * 100.0 / F.sum("row_count"))
        .otherwise(F.lit(0.0))
        .alias("null_cell_pct"),
    )

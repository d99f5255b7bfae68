"""Readers: CSV (strict and tolerant), JSON records, Parquet, collections."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.functions.columns import col, columns_of


# The column that holds the text of records with a wrong number of fields.
_RAW = "_raw_record"
_WHOLE = r"^[+-]?\d+$"


def normalize_missing(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Cell texts that stand for a missing value become null; NaN as well."""
    tokens = fixed.MISSING_TOKENS if tokens is None else tokens
    out = {
        n: F.when(~F.trim(col(n)).isin(tokens), col(n)) for n in columns_of(df, "text")
    }
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(col(f.name)), col(f.name))
    return df.withColumns(out) if out else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value reads as bigint, decimal, double or boolean get that type.

    Whole numbers beyond bigint become decimal(38, 0), so that no digit is lost. One aggregate over all columns decides; dates
    stay text.
    """
    names = columns_of(df, "text")
    if not names:
        return df
    def all_of(c: Column) -> Column:
        return F.coalesce(F.bool_and(c), F.lit(False))

    checks = []
    for i, n in enumerate(names):
        text = F.trim(col(n))
        checks += [
            all_of(F.when(col(n).isNotNull(), text.rlike(_WHOLE) & text.try_cast("bigint").isNotNull())).alias(f"i{i}"),
            all_of(F.when(col(n).isNotNull(), text.rlike(_WHOLE) & text.try_cast("decimal(38,0)").isNotNull())).alias(f"w{i}"),
            all_of(F.when(col(n).isNotNull(), text.rlike(fixed.NUMERIC_TEXT) & ~text.contains("_"))).alias(f"d{i}"),
            all_of(F.when(col(n).isNotNull(), F.lower(text).isin("true", "false"))).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    made = {}
    for i, n in enumerate(names):
        kinds = [("i", "bigint"), ("w", "decimal(38,0)"), ("d", "double"), ("b", "boolean")]
        target = next((kind for letter, kind in kinds if row[f"{letter}{i}"]), None)
        if target:
            made[n] = F.trim(col(n)).try_cast(target)
    return df.withColumns(made) if made else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header.  A schema saves the inference pass; prefer one at scale."""
    reader = spark.read.option("header", True).options(**options)
    if schema is not None:
        return normalize_missing(reader.schema(schema).csv(path))
    return infer_types(normalize_missing(reader.csv(path)))


def read_csv_tolerant(
    spark: SparkSession, path: str, separator: str = ",", columns: list[str] | None = None, multi_line: bool = False,
    infer: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV without its over-long records, and the counts of both.

    Short records are padded with null.  Each file's first line names the columns
    unless ``columns`` does; a later line that equals it is data.  With
    ``multi_line`` quoted values may hold line breaks, and a file is one task.
    """
    reader = spark.read.options(sep=separator, multiLine=multi_line, escape='"')
    names = columns or reader.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
    read = reader.schema(schema).options(
        header=columns is None, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, columnPruning=False).csv(path)
    # Records with a wrong number of fields come with their text.
    unquoted = F.regexp_replace(_RAW, '"(?:[^"]|"")*"', "")
    too_long = F.coalesce(F.size(F.split(unquoted, re.escape(separator))) > len(names), F.lit(False))
    kept = normalize_missing(read.filter(~too_long).select(*[col(n) for n in names]))
    # Spark only knows which records are wrong where it reads a value, too.
    value = col(names[0])
    report = read.agg((F.count(value) + F.count_if(value.isNull())).alias("lines"), F.count_if(too_long).alias("skipped_lines"))
    return (infer_types(kept) if infer else kept), report


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None
) -> DataFrame:
    """JSON Lines, which Spark can split, or a JSON array of records, which is one task per file.

    Unless ``lines`` says which, the first character tells.
    """
    if lines is None:
        first = spark.read.text(path).filter(F.trim("value") != "").first()
        lines = first is None or not first["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", not lines)
    return normalize_missing((reader.schema(schema) if schema is not None else reader).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_collection(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables named by their file's stem, read by their file's extension."""
    readers = {".csv": read_csv, ".json": read_json_records, ".parquet": read_parquet}
    out = {}
    for path in paths:
        stem, extension = os.path.splitext(os.path.basename(path.rstrip("/")))
        if extension not in readers:
            raise ValueError(f"unsupported file format: {path}")
        out[stem] = readers[extension](spark, path)
    return out


def pair_tables(baseline: dict[str, DataFrame], current: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Tables of two collections paired by name."""
    common = [n for n in baseline if n in current]
    if not common:
        raise ValueError("the two collections have no table name in common")
    return {n: (baseline[n], current[n]) for n in common}


def record_summary(df: DataFrame) -> DataFrame:
    """Field names and row count of a record list."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(",".join(df.columns)).alias("fields"), "row_count")

"""Column selection by type and schema predicates (driver side, O(columns))."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed
from plumbline.sources.state import small_table

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, TEMPORAL):
        return "temporal"
    return "other"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of the given kinds, in table order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def type_name(df: DataFrame, name: str) -> str:
    plain = df.schema[name].dataType.simpleString()
    return "timestamp" if plain == "timestamp_ntz" else plain


def sensitive_term(name: str) -> str | None:
    """The first sensitive term in a column name."""
    lowered = name.lower()
    return next((t for t in fixed.SENSITIVE_NAME_TERMS if t in lowered), None)


def tracks_consent(name: str) -> bool:
    lowered = name.lower()
    return any(t in lowered for t in fixed.CONSENT_NAME_TERMS)


def missing_columns(df: DataFrame, required) -> list[str]:
    present = set(df.columns)
    return [name for name in required if name not in present]


def column_table(df: DataFrame) -> DataFrame:
    """The scanned fields as a table: position, column, data_type, kind."""
    rows = [
        (i, f.name, type_name(df, f.name), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return small_table(
        df.sparkSession, rows, "position int, column string, data_type string, kind string"
    )


def sensitive_table(df: DataFrame) -> DataFrame:
    """Name-based flags per column: sensitive term and consent tracking."""
    rows = [(n, sensitive_term(n), tracks_consent(n)) for n in df.columns]
    return small_table(
        df.sparkSession, rows, "column string, sensitive_term string, tracks_consent boolean"
    )

"""Stored baselines: what drift needs of a table, so that later comparisons do not read it again.

A version holds the facts per column and the count of every distinct value, as text, one folder per column. Counts are
exact, and a number's text gives back the same number, so drift against a stored version equals drift against the table,
also where a column has changed between number and text. Moments are written in the session's time zone; compare in the same one.
A row in ``versions`` is written last: a version whose writing broke off is never seen.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import frequencies
from plumbline.operators.facts import column_facts
from plumbline.sources.state import as_local, small_table

_VERSIONS = "version int, folder string, saved timestamp, rows bigint, schema string"
_COUNTS = "column string, value string, count bigint"


@dataclass(frozen=True)
class Baseline:
    """A stored version: ``facts`` per column and ``values`` as (column, value, count) of what is not null."""

    version: int
    rows: int
    schema: T.StructType
    facts: DataFrame
    values: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.facts.sparkSession

    def isEmpty(self) -> bool:  # noqa: N802
        return self.rows == 0

    def counts(self, columns: list[str]) -> DataFrame:
        return self.values.filter(F.col("column").isin(columns))

    def number(self, name: str) -> Column:
        """The values of a numeric or boolean column as double, null in the rows of other columns."""
        kind = self.schema[name].dataType
        value = F.when(F.col("column") == name, F.col("value")).try_cast(kind)
        return (value.cast("int") if isinstance(kind, T.BooleanType) else value).cast("double")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The complete versions under a folder; an empty table if there is none."""
    try:
        return spark.read.schema(_VERSIONS).parquet(f"{folder}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_table(spark, [], _VERSIONS)


def save_baseline(df: DataFrame, folder: str) -> int:
    """Store a new version of a table's baseline and return its number.

    Two writers at once may take the same number; the one whose row in ``versions`` is the latest is read.
    """
    spark = df.sparkSession
    part = f"{folder}/{uuid.uuid4().hex}"
    facts = as_local(column_facts(df, ("range", "moments", "dates")))
    facts.write.parquet(f"{part}/facts")
    frequencies.value_counts(df).write.partitionBy("column").parquet(f"{part}/values")
    number = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    rows = facts.agg(F.max("row_count")).first()[0] or 0
    small_table(spark, [(number, part, dt.datetime.now(), rows, df.schema.json())], _VERSIONS).write.mode("append").parquet(f"{folder}/versions")
    return number


def load_baseline(spark: SparkSession, folder: str, version: int | None = None) -> Baseline:
    """A stored version, by default the latest."""
    found = versions(spark, folder)
    found = found if version is None else found.filter(F.col("version") == version)
    row = found.orderBy(F.desc("version"), F.desc("saved"), "folder").first()
    if row is None:
        raise ValueError(f"no stored baseline{'' if version is None else f' of version {version}'} in {folder}")
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    values = spark.read.schema(_COUNTS).parquet(f"{row['folder']}/values")
    return Baseline(row["version"], row["rows"], schema, as_local(spark.read.parquet(f"{row['folder']}/facts")), values)

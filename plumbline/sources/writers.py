"""Writers: result tables, one JSON report, cleaned tables."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import plumbline
from plumbline.functions.columns import col
from plumbline.operators.scores import side_by_side
from plumbline.params import effective
from plumbline.sources.state import small_table


def write_results(result, folder: str, fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """Every table of a result under ``folder/<table name>``."""
    paths = []
    for name, table in result._asdict().items():
        if isinstance(table, DataFrame):
            path = f"{folder}/{name}"
            table.write.mode(mode).format(fmt).save(path)
            paths.append(path)
    return paths


RECORD = ("operator string, version string, dataset string, table string, path string, started timestamp, seconds double, rows bigint, "
          "nulls map<string,bigint>, parameters map<string,string>, status string, error string")


def write_recorded(result, folder: str, operator: str, dataset: str, params=None, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Every table of a result under ``folder/<table name>``, written in parts, and ``folder/run_record`` beside them.

    The record has a row per table: rows and nulls per column, counted while the table is written (no second scan), with the
    time, the effective parameters and the status. If a table fails, the record of it and of those before it is
    written all the same, then the error goes on.
    """
    tables = {n: t for n, t in result._asdict().items() if isinstance(t, DataFrame)}
    spark = next(iter(tables.values())).sparkSession
    used = effective(params) if params is not None else {}
    rows, failure = [], None
    for name, table in tables.items():
        started, clock, path = dt.datetime.now(), time.perf_counter(), f"{folder}/{name}"
        seen, error = Observation(f"{operator}-{uuid.uuid4().hex}"), None
        nulls = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(table.columns)]
        try:
            table.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode(mode).format(fmt).save(path)
            counts = seen.get
        except Exception as e:  # noqa: BLE001
            failure, error, counts = e, str(e)[:500], {}
        by_column = {c: counts[f"n{i}"] for i, c in enumerate(table.columns)} if counts else None
        rows.append((operator, plumbline.__version__, dataset, name, path, started, time.perf_counter() - clock, counts.get("rows"), by_column,
                     used, "failed" if error else "written", error))
        if error:
            break
    record = small_table(spark, rows, RECORD)
    record.write.mode("append").parquet(f"{folder}/run_record")
    if failure is not None:
        raise failure
    return record


def report_json(result, skip: tuple[str, ...] = ("table",)) -> DataFrame:
    """All report tables of a result as one JSON document in one row.

    Report tables are bounded (columns, rules, listed issues); the cleaned
    table is not part of the report.
    """
    parts = [
        table.agg(F.collect_list(F.struct(*table.columns)).alias(name))
        for name, table in result._asdict().items()
        if name not in skip and isinstance(table, DataFrame)
    ]
    document = side_by_side(parts)
    return document.select(F.to_json(F.struct(*document.columns)).alias("report"))


def write_cleaned(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """One cleaned table per dataset, written in parallel by the executors."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.mode(mode).format(fmt).save(paths[name])
    return paths


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{tempfile.mkdtemp(prefix='plumbline-')}/{name}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

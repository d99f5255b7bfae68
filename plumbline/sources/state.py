"""Cutting lineage with files every executor can read again."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is not None:
        return
    if configured:
        context.setCheckpointDir(configured)
    elif re.fullmatch(r"local(\[.*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Write the table to the checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` names."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        ensure_checkpoint_dir(spark)
        top = spark.sparkContext.getCheckpointDir()
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and go on from the files.

    For loops of joins, in place of ``durable``: a checkpoint keeps the size that was estimated for its plan, and the estimate of a join is
    the product of its sides, so the digits of the estimate would double in every round. Files have the size they have.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """Literal rows as a table that the optimizer knows to be local."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow_schema = to_arrow_schema(struct)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), struct)


def as_local(df: DataFrame) -> DataFrame:
    """A table of O(columns) rows, evaluated once and kept as literal rows.

    Only for tables with one row per column, rule or bucket.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)

"""Nearest-donor fill: the mean of the k nearest rows that have the value.

Distance is Euclidean over the numeric columns that both rows have, scaled up for the missing ones. Exact for any number of
donors and any pattern of nulls, and no pair table is made. Donors are parted into cells by cuts along all columns (a k-d tree
fitted on a bounded sample; rows without a cut's column have a branch of their own), and each cell has the bounding box of all its
donors. A recipient searches its own cell, then the cells whose boxes are nearest, with the radius that is known by then, and last
those whose boxes are still within it. A task holds one block of a cell and one chunk of recipients and returns k rows per recipient.

A recipient whose cells hold fewer than k usable donors searches more cells from round to round, nearest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import kernels
from plumbline.functions.columns import col, columns_of
from plumbline.operators.facts import local_facts, number
from plumbline.sources.state import durable, small_table

BLOCK_ROWS = 20_000
CHUNK_ROWS = 20_000
# Cells of the tree and rows that it is fitted on. Beyond MAX_CELLS * BLOCK_ROWS donors a cell is searched in several blocks.
MAX_CELLS = 16_384
SAMPLE_ROWS = 16 * MAX_CELLS
# Cells that a recipient searches with its first radius, before it takes all that its second radius leaves.
FIRST_CELLS = 4
MORE_CELLS = 8


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)


def _sampled(donors: DataFrame, features: list[str], n_donors: int, sample_rows: int) -> np.ndarray:
    """About ``sample_rows`` donors, the same ones in each run."""
    share = min(1.0, sample_rows / max(1, n_donors))
    chosen = donors.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    table = chosen.select(*features).toArrow().combine_chunks()
    columns = [table.column(f).to_numpy().astype(float) for f in features]
    return np.stack(columns, axis=1) if table.num_rows else np.zeros((0, len(features)))


def _with_cell(df: DataFrame, cells: kernels.Cells, features: list[str]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                home = cells.home(_matrix(batch, features))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, schema)


def _boxes(placed: DataFrame, cells: kernels.Cells, features: list[str]) -> np.ndarray:
    """Set the cells' boxes; returns the number of donors of each. One row per cell comes to the driver."""
    sums = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(f).alias(f"low_{f}") for f in features], *[F.max(f).alias(f"high_{f}") for f in features],
        *[F.count(f).alias(f"known_{f}") for f in features]).toPandas()
    shape = (cells.n_cells, len(features))
    low, high, known, rows = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, np.int64), np.zeros(cells.n_cells, np.int64)
    at = sums["cell"].to_numpy(dtype=int)
    rows[at] = sums["n"]
    for i, f in enumerate(features):
        low[at, i], high[at, i], known[at, i] = sums[f"low_{f}"], sums[f"high_{f}"], sums[f"known_{f}"]
    cells.set_boxes(low, high, known, rows)
    return rows


def _next_cells(df: DataFrame, cells: kernels.Cells, features: list[str], step: int) -> DataFrame:
    """A row for each cell that a recipient searches next. df: id, features, reach, seen."""
    kept = ["id", *features]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("cell", T.IntegerType()), T.StructField("seen", T.LongType())])
    tile = max(64, 1_000_000 // max(1, cells.n_cells))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, tile):
                batch = whole.slice(start, tile)
                radius = batch.column("reach").to_numpy(zero_copy_only=False).astype(float)
                seen = batch.column("seen").to_numpy(zero_copy_only=False).astype(np.int64)
                at, cell, then = cells.following(_matrix(batch, features), radius, seen, FIRST_CELLS, step)
                rows = batch.select(kept).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(then)], names=[*kept, "cell", "seen"])

    return df.mapInArrow(run, schema)


def nearest_donors(
    df: DataFrame, target: str, key: str, k: int = 5, columns: list[str] | None = None,
    block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, max_cells: int = MAX_CELLS, visits: list[DataFrame] | None = None,
) -> DataFrame:
    """(id, distance, donor, value, rank): the k nearest donors per recipient.

    ``visits`` collects the tables of what was searched, one row per recipient and cell.
    """
    names = columns or columns_of(df, "numeric")
    features = [f"f{i}" for i in range(len(names))]
    base = df.select(col(key).alias("id"), number(df, target).alias("value"),
                     *[number(df, n).alias(f) for n, f in zip(names, features)])
    donors = base.filter(F.col("value").isNotNull())
    recipients = base.filter(F.col("value").isNull()).drop("value")
    n_donors = local_facts(df, ("moments",), columns=[target]).first()["non_null_count"]

    wanted = min(max_cells, -(-n_donors // block_rows))
    usable = [i for i, n in enumerate(names) if n != target]
    sample = _sampled(donors, features, n_donors, SAMPLE_ROWS) if wanted > 1 else np.zeros((0, len(names)))
    cells = kernels.Cells(sample, wanted, usable)
    placed = durable(_with_cell(donors, cells, features))
    rows = _boxes(placed, cells, features)
    # One row per cell: the number of blocks that it is searched in.
    parts = F.broadcast(small_table(
        df.sparkSession, [(i, max(1, -(-int(n) // (2 * block_rows)))) for i, n in enumerate(rows)], "cell int, parts int"))
    placed = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")).cast("int")).drop("parts")

    search = kernels.nearest_in_block(k, len(names))
    id_type = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("distance", T.DoubleType()),
        T.StructField("donor", id_type), T.StructField("value", T.DoubleType())])
    order = Window.partitionBy("id").orderBy("distance", "donor")

    def visit(assigned: DataFrame) -> DataFrame:
        if visits is not None:
            visits.append(assigned.select("id", "cell"))
        # One row per cell again.
        chunks = F.broadcast(small_table(
            df.sparkSession, assigned.groupBy("cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")).collect(),
            "cell int, chunks int"))
        left = assigned.join(chunks, "cell").join(parts, "cell").withColumn(
            "chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", *features, "cell", "part", "chunk")
        right = placed.join(chunks, "cell").withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        block = ["cell", "part", "chunk"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(lambda r, d: search(r, d), schema)

    def k_best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    best = k_best(visit(_with_cell(recipients, cells, features)))
    if cells.n_cells == 1:
        return best
    best = durable(best)
    open_, step = recipients.withColumn("seen", F.lit(0).cast("bigint")), FIRST_CELLS
    while True:
        reach = best.groupBy(F.col("id").alias("_id")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
        asked = open_.join(reach, F.col("id") == F.col("_id"), "left").select("id", *features, "reach", "seen")
        following = durable(_next_cells(asked, cells, features, step))
        left = following.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") >= 0).alias("more")).first()
        if not left["n"]:
            return best
        best = durable(k_best(best.drop("rank").unionByName(visit(following.drop("seen")))))
        if not left["more"]:
            return best
        open_ = following.filter(F.col("seen") >= 0).dropDuplicates(["id"]).drop("cell")
        step *= MORE_CELLS


def knn_fill(df: DataFrame, target: str, key: str, k: int = 5, columns: list[str] | None = None, **options) -> DataFrame:
    """Fill nulls of a numeric column; the column mean where no donor is usable. Only rows with a null are shuffled."""
    near = nearest_donors(df, target, key, k, columns, **options)
    fills = near.groupBy(F.col("id").alias("_id")).agg(F.avg("value").alias("_fill"))
    mean = df.agg(F.avg(number(df, target))).first()[0]
    value = number(df, target)
    names = [col(n) for n in df.columns]
    filled = df.filter(value.isNull()).join(fills, col(key) == F.col("_id"), "left").withColumn(
        target, F.coalesce(F.col("_fill"), F.lit(mean).cast("double"))).select(*names)
    return df.filter(value.isNotNull()).withColumn(target, value).select(*names).unionByName(filled)

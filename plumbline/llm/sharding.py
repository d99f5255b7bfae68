"""Sharding by fixed virtual slots.

A row's hash picks one of ``slots`` virtual slots, for good. A small versioned map says which shard holds a slot.
Version 0 deals slots out in turn; each rebalancing edits the map, moves as few slots as it needs, and is stored as the
next version. Rows never move unless their slot does. Only the loads of the slots, at most ``slots`` rows, reach the driver.

Defined cases. A null text has 0 bytes, so size 1. Rows with equal doc_id and text share a slot; their order within it
does not matter, as they are equal. Null ids are spread by their text. An empty table gives an empty result; a single row
larger than a fair share makes its shard that large. Only doc_id and text are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.support import shared_folder

SLOTS = 4096


def rebalanced(shard_of: list[int], loads: list[int], shards: int, tolerance: float = 0.0002) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard while that narrows their gap.

    Each move takes the slot whose load is nearest to half the gap; it stops when the gap is within ``tolerance`` of a fair
    share, or no slot of the fullest shard is smaller than the gap.
    """
    shard_of = list(shard_of)
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append(slot)
    full = [sum(loads[s] for s in own) for own in held]
    fair = sum(loads) / shards
    while True:
        most, least = max(range(shards), key=full.__getitem__), min(range(shards), key=full.__getitem__)
        gap = full[most] - full[least]
        movable = [s for s in held[most] if 0 < loads[s] < gap]
        if gap <= tolerance * fair or not movable:
            return shard_of
        slot = min(movable, key=lambda s: (abs(2 * loads[s] - gap), s))
        held[most].remove(slot)
        held[least].append(slot)
        full[most] -= loads[slot]
        full[least] += loads[slot]
        shard_of[slot] = least


def grown(shard_of: list[int], loads: list[int], shards: int) -> list[int]:
    """The map with one more shard, number ``shards``: slots move only into it, until it has a fair share."""
    shard_of = list(shard_of)
    full = [0] * (shards + 1)
    for slot, shard in enumerate(shard_of):
        full[shard] += loads[slot]
    fair = sum(loads) / (shards + 1)
    for slot in sorted(range(len(loads)), key=lambda s: (-loads[s], s)):
        room = fair - full[shards]
        if 0 < loads[slot] <= min(room, full[shard_of[slot]] - fair):
            full[shard_of[slot]] -= loads[slot]
            full[shards] += loads[slot]
            shard_of[slot] = shards
    return shard_of


class SlotMap:
    """The versions of a slot-to-shard map, stored as Parquet in ``path`` with a folder per version."""

    def __init__(self, spark: SparkSession, shards: int, slots: int = SLOTS, path: str | None = None):
        self.spark, self.shards, self.path = spark, shards, path or shared_folder(spark, "slot-map")
        self.version = -1
        self.store([s % shards for s in range(slots)], shards)

    def store(self, shard_of: list[int], shards: int) -> None:
        self.shard_of, self.shards, self.version = shard_of, shards, self.version + 1
        numbers = F.from_json(F.lit(json.dumps(shard_of)), "array<int>")
        table = self.spark.range(1).select(F.posexplode(numbers).alias("slot", "shard"))
        table.coalesce(1).write.parquet(f"{self.path}/version={self.version}")

    def table(self, version: int | None = None) -> DataFrame:
        at = self.version if version is None else version
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={at}")

    def rebalance(self, loads: list[int]) -> None:
        self.store(rebalanced(self.shard_of, loads, self.shards), self.shards)

    def grow(self, loads: list[int]) -> None:
        self.store(grown(self.shard_of, loads, self.shards), self.shards + 1)


def slot_column(slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Each document with its shard, by nearly equal bytes, and its place in the shard (``slot``, gapless from 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("_slot", slot_column(slots, F.col("doc_id"), F.col("text_crc32")))
    slot_map = SlotMap(docs.sparkSession, shards, slots, path)
    loads = rows.groupBy("_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    loads_path = f"{slot_map.path}/loads"
    loads.coalesce(1).write.parquet(loads_path)
    loads = docs.sparkSession.read.schema("_slot int, bytes bigint, rows bigint").parquet(loads_path)
    by_slot = {r["_slot"]: r["bytes"] for r in loads.collect()}
    slot_map.rebalance([by_slot.get(s, 0) for s in range(slots)])
    # At most one row per virtual slot from here to the broadcast.
    earlier = Window.partitionBy("shard").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.table().withColumnRenamed("slot", "_slot").join(F.broadcast(loads), "_slot").select(
        "_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_place", F.row_number().over(within) - 1).join(F.broadcast(places), "_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + F.col("_place")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Sharding by fixed virtual slots.

A record's id hashes to one of ``SLOTS`` virtual slots, for good. A small table, the slot map, says which shard holds each
slot; it is stored in versions. Rebalancing sums the bytes of each slot and edits the map: a shard keeps its largest slots as
far as they fit into a fair share, and gives up the others, which go one by one, largest first, to the shard with the least
load. Only records in slots that moved change shards. A shard more is the same edit with one more shard.

Everything is DataFrame operations: the map and the sums have one row for each slot, so their size is fixed, and the map is
broadcast. A record's place in its shard is its rank in its slot plus the number of records in the shard's earlier slots, so
no task sees more than a slot.

The law is ``bytes``: shards are near equal in bytes. Equal texts aren't kept together, since a group of copies can hold more than a
shard's share; their ids part them.

Defined cases: a null text has no bytes (size 1, checksum 0); a record without id hashes by its text; repeated rows fall
into one slot and get neighbouring places; ties in load go to the lower shard, in size to the lower slot; an empty
table gives an empty table and an unchanged map; further columns are ignored by ``assign`` unless named.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.window import Window

from . import scratch

SLOTS, SHARDS = 4096, 16
#: Edits of the map before documents are placed.
EDITS = 2


def slot_of(key: str = "doc_id", text: str = "text", slots: int = SLOTS):
    return F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(F.col(text))), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots in turn to the shards."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    slot_map.select("vslot", "shard").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def slot_bytes(records: DataFrame) -> DataFrame:
    """vslot, bytes, n; one row for each slot in use. records: vslot and size."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def rebalance(slot_map: DataFrame, sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The edited map."""
    loads = slot_map.join(F.broadcast(sums), "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    total = loads.agg((F.sum("bytes") / F.lit(shards)).alias("fair"))
    marked = loads.withColumn("upto", F.sum("bytes").over(largest)).crossJoin(F.broadcast(total)).withColumn("stays", (F.col("upto") <= F.col("fair")) | (F.col("bytes") == 0))
    per_shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("all", lambda x: x.stays & (x.shard == s)), F.lit(0).cast("long"), lambda a, x: a + x.bytes))
    # Both arrays have at most one element for each slot.
    one = marked.agg(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "shard", "bytes", "stays")).alias("all"))
    one = one.select(per_shard.alias("loads"), F.array_sort(F.filter("all", lambda x: ~x.stays)).alias("free"))

    def place(state, x):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(F.transform(state["loads"], lambda v, k: F.when(k == least, v + x.bytes).otherwise(v)).alias("loads"), F.concat(state["to"], F.array(least)).alias("to"))

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))
    placed = one.select("free", F.aggregate("free", start, place)["to"].alias("to"))
    moved = placed.select(F.explode(F.arrays_zip("free", "to")).alias("x")).select(F.col("x.free.vslot").alias("vslot"), F.col("x.to").alias("new"))
    return slot_map.join(F.broadcast(moved), "vslot", "left").select("vslot", F.coalesce("new", "shard").alias("shard"))


def assign(records: DataFrame, slot_map: DataFrame, sums: DataFrame, order: list[str]) -> DataFrame:
    """Adds shard and slot (the place in the shard, from 0 without gaps) to records with vslot; order breaks ties of place."""
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    table = slot_map.join(F.broadcast(sums), "vslot", "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0))).select("vslot", "shard", "before")
    ranked = records.withColumn("rank", F.row_number().over(Window.partitionBy("vslot").orderBy(*order)))
    return ranked.join(F.broadcast(table), "vslot").withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).drop("rank", "before")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).cast("long").alias("text_crc32"), slot_of().alias("vslot"))
    path = scratch.new_path(spark, "slot-map")
    save_map(first_map(spark), path, 0)
    sums = scratch.table(slot_bytes(docs.select((F.octet_length(raw) + 1).cast("long").alias("size"), slot_of().alias("vslot"))), "slot-bytes")
    # The first edit places large slots, the second evens out what they left with small ones.
    for version in range(EDITS):
        save_map(rebalance(load_map(spark, path, version), sums), path, version + 1)
    placed = assign(records, load_map(spark, path, EDITS), sums, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))

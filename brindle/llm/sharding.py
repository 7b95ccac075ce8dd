"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of slots (thousands). Bytes are summed per
slot, and a slot map says which shard holds which slot. The map is a small versioned table of
``n_slots`` rows, empty slots included, so that it holds for rows to come: building it places slots,
largest first, on the shard with the fewest bytes; adding a shard edits the map and moves whole slots to the
new shard only. ``save_map`` keeps every version in a folder, ``load_map`` reads the last or a given one, and
``shard_documents`` takes a map that is there. The law is ``bytes``: shard sizes are as near to equal as
whole slots allow. Groups of equal texts are split, as slots follow the id, too: a group may hold a third of
all rows, which no shard could take under this law.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

N_SLOTS = 4096
#: Added to the bytes of each text.
ROW_BYTES = 16


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot for each row. The slot follows id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; at most ``n_slots`` rows, summed before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def build_map(slots: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map: virtual_slot, shard, version, a row for each of ``n_slots``. One fold over the
    slots that hold rows, largest first, with the shards' loads as state; both are of fixed size. Empty
    slots go to the shards in turn."""
    order = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("virtual_slot")))).alias("s"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(acc, slot):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads = F.transform(acc["loads"], lambda v, k: F.when(k == at - 1, v - slot["less"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(at - 1)).alias("to"))

    placed = order.select(F.explode(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.aggregate("s", zero, place)["to"].alias("shard"))).alias("m"))
    every = slots.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    placed = F.broadcast(placed.select("m.virtual_slot", "m.shard"))  # n_slots rows at most
    return every.join(placed, "virtual_slot", "left").select("virtual_slot", F.coalesce("shard", F.col("virtual_slot") % n_shards).alias("shard"), F.lit(1).alias("version"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the folder of a map; a version that is there is not overwritten."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the last if none is given."""
    every = spark.read.parquet(*[path]).select("virtual_slot", "shard", "version")
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version)


def add_shard(slots: DataFrame, slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for one shard more: each shard gives up slots, in the order of
    their ids, as far as their bytes stay within what it has above the new mean. Slots move only
    into the new shard, whose number is ``n_shards``."""
    own = Window.partitionBy("shard")
    rows = slot_map.join(slots, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    rows = rows.withColumns({"load": F.sum("bytes").over(own), "total": F.sum("bytes").over(Window.partitionBy()), "upto": F.sum("bytes").over(own.orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0))})
    moves = (F.col("upto") <= F.col("load") - F.col("total") / F.lit(n_shards + 1)) & (F.col("bytes") > 0)
    return rows.select("virtual_slot", F.when(moves, F.lit(n_shards)).otherwise(F.col("shard")).alias("shard"), (F.col("version") + 1).alias("version"))


def shard_documents(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (the row's place in its
    shard, from 0 without gaps), grown_shard (null under this law), virtual_slot, map_version.

    With ``slot_map``, a map over ``n_slots`` slots that was stored or edited, rows go where it says;
    otherwise one is built from their bytes. Null text has no bytes. Equal texts under different ids are
    spread; rows that agree in id and text share a virtual slot and get different places in it. An empty
    table gives an empty result; other columns are not read.
    """
    rows = store(slotted(docs, n_slots), "slotted")
    slots = slot_bytes(rows)
    slot_map = build_map(slots, n_shards, n_slots) if slot_map is None else slot_map
    version = store(slot_map.join(F.broadcast(slots), "virtual_slot", "left"), "slot-map")
    n = F.coalesce("n", F.lit(0).cast("long"))
    before = F.sum(n).over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)) - n
    starts = F.broadcast(version.select("virtual_slot", "shard", "version", before.alias("start")))  # n_slots rows at most
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("nth", place).join(starts, "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))

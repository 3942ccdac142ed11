"""Sharding by fixed virtual slots.

Every record hashes into one of `SLOTS` virtual slots for good; equal records also by their number among each other, so
any count of copies spreads over all slots. Bytes are added up per slot, and a small versioned table
maps slots to shards. Records never move on their own: rebalancing or growing edits rows of that table and raises its
version. The table has `SLOTS` rows whatever the corpus holds, so the driver edits it and Spark broadcasts it.

Law: `bytes`. A first map deals slots out by falling size, each to the lightest shard. Version 2 of the map is its edit
for one shard more, and tells where each record goes then (`next_shard`).

Edge cases: a null text has no bytes and checksum 0, like an empty one; a null doc_id hashes like any value; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import cut, folder

SLOTS = 4096
SHARDS = 24
RECORD_BYTES = 8
COPIES = 1024  # equal records that one row stands for when copies are spread
MAP_SCHEMA = "vslot int, shard int, version int"

SlotMap = dict[int, int]


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record.

    Equal records fold to a count before they move. The counts are written out again from rows for `COPIES` records each,
    dealt to all tasks, which number the copies.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        "doc_id", F.xxhash64(text).alias("hash"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))
    dealt = counted.select("*", first.alias("from")).repartition("hash", "from")
    copy = F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("n")) - 1))
    return dealt.select("doc_id", "hash", "size", "text_crc32", copy.alias("copy")).select(
        "doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "hash", "copy"), F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and records of each occupied virtual slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def first_map(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """Slots by falling size, each to the lightest shard so far; empty slots follow in turn."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalanced(slot_map: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """An edit of `slot_map` for changed sizes: slots leave the heaviest shard for the lightest while that helps.

    Each move takes the slot nearest to half the gap; the sum of squared loads falls with every move, so it ends.
    """
    out, loads, held = dict(slot_map), [0] * shards, [set() for _ in range(shards)]
    for slot, shard in out.items():
        loads[shard] += sizes.get(slot, 0)
        if sizes.get(slot, 0):
            held[shard].add(slot)
    while True:
        heavy, light = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[heavy] - loads[light]
        fits = [s for s in held[heavy] if sizes[s] < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        held[heavy].remove(slot)
        held[light].add(slot)
        out[slot] = light
        loads[heavy] -= sizes[slot]
        loads[light] += sizes[slot]


def grown(slot_map: SlotMap, sizes: dict[int, int], shards: int) -> SlotMap:
    """One shard more: slots move into it, and only there, until it has its share."""
    out, total = dict(slot_map), sum(sizes.values())
    loads, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in out.items():
        loads[shard] += sizes.get(slot, 0)
        if sizes.get(slot, 0):
            held[shard].append(slot)
    for slots in held:
        slots.sort(key=lambda s: (sizes[s], -s))
    taken, share = 0, total // (shards + 1)
    while taken < share:
        heavy = max(range(shards), key=loads.__getitem__)
        if not held[heavy]:
            break
        slot = held[heavy].pop()
        if taken + sizes[slot] > share:
            loads[heavy] = -1  # its smaller slots stay; others are tried
            continue
        out[slot] = shards
        taken += sizes[slot]
        loads[heavy] -= sizes[slot]
    return out


def stored(spark: SparkSession, slot_map: SlotMap, version: int, table: str) -> DataFrame:
    """Version `version` of the map, written below `table` and read back; older versions stay as they are."""
    rows = [(slot, shard, version) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{table}/version={version}")
    return spark.read.schema(MAP_SCHEMA).parquet(f"{table}/version={version}")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position (`slot`) of every record.

    A position is the records of the shard's earlier virtual slots plus the place within the own slot: the window
    covers one virtual slot of narrow rows, and the running totals cover `SLOTS` rows.
    """
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slot_bytes(records).join(F.broadcast(slot_map), "vslot")
        .select(*slot_map.columns, F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start"))
    )
    return (
        records.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(starts), "vslot")  # SLOTS rows at most
        .withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))
    )


def shard(docs: DataFrame, shards: int = SHARDS, table: str | None = None) -> DataFrame:
    """Every record with its size, checksum, virtual slot, shard, position in the shard, the version of the map, and its
    shard under the next version, which has one shard more."""
    spark = docs.sparkSession
    records = cut(measured(docs))
    sizes = {r["vslot"]: r["bytes"] for r in slot_bytes(records).collect()}  # SLOTS rows at most
    table = table or f"{folder(spark)}/slot-map-{uuid.uuid4().hex}"
    first = first_map(sizes, shards)
    now, more = stored(spark, first, 1, table), stored(spark, grown(first, sizes, shards), 2, table)
    return placed(records, now.join(F.broadcast(more.select("vslot", F.col("shard").alias("next_shard"))), "vslot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"), "next_shard",
    )

"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``SLOTS`` slots. Bytes and rows are summed per slot, and a map
says which shard has which slot. Rebalancing and growing edit the map and leave the hashing alone,
so only records of edited slots move.

A null text has no bytes and checksum 0; a null doc_id hashes like any other value. Repeated rows
are separate records, numbered and dealt over slots each for itself. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkgauge.llm.staging import new_path, stage

SLOTS = 8192
#: Bytes that each record counts besides its text.
OVERHEAD = 16


@dataclass
class SlotMap:
    """shard_of[slot], with the sums it was made for and the number of edits so far."""

    shards: int
    shard_of: list[int]
    size: list[int]
    rows: list[int]
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, size: list[int], rows: list[int], shards: int) -> SlotMap:
        """Largest slot first to the lightest shard."""
        heap, shard_of = [(0, k) for k in range(shards)], [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + size[slot], shard))
        return cls(shards, shard_of, list(size), list(rows))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.size[slot]
        return out

    def grow(self) -> SlotMap:
        """The next version, with one more shard that takes slots from the heaviest ones; no other slot moves."""
        loads, shard_of, moved = [*self.loads(), 0], list(self.shard_of), []
        fair = sum(loads) / (self.shards + 1)
        by_shard: dict[int, list[int]] = {}
        for slot in sorted(range(len(shard_of)), key=lambda s: (self.size[s], s)):
            by_shard.setdefault(shard_of[slot], []).append(slot)
        while True:
            giver = max(range(self.shards), key=lambda k: (loads[k], -k))
            fits = [s for s in by_shard.get(giver, []) if self.size[s] and loads[-1] + self.size[s] <= fair]
            if not fits or loads[giver] <= fair:
                break
            slot = fits[-1]
            by_shard[giver].remove(slot)
            shard_of[slot] = self.shards
            loads[giver] -= self.size[slot]
            loads[-1] += self.size[slot]
            moved.append(slot)
        return SlotMap(self.shards + 1, shard_of, self.size, self.rows, self.version + 1, moved)

    def rebalance(self, size: list[int], rows: list[int], slack: float = 0.02) -> SlotMap:
        """The next version for new sums: slots leave shards above (1+slack) of the mean, largest that fits first."""
        new = SlotMap(self.shards, list(self.shard_of), list(size), list(rows), self.version + 1)
        loads = new.loads()
        limit = sum(loads) / self.shards * (1 + slack)
        for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
            giver = new.shard_of[slot]
            taker = min(range(self.shards), key=lambda k: (loads[k], k))
            if size[slot] and loads[giver] > limit and loads[taker] + size[slot] < loads[giver]:
                loads[giver] -= size[slot]
                loads[taker] += size[slot]
                new.shard_of[slot] = taker
                new.moved.append(slot)
        return new

def write_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Store the map's version: one row per slot, under ``path``/map_version=<version>; older versions stay."""
    rows = list(zip(range(len(slot_map.shard_of)), slot_map.shard_of, slot_map.size, slot_map.rows))
    table = spark.createDataFrame(rows, "vslot int, shard int, size long, rows long").withColumn("shards", F.lit(slot_map.shards)).withColumn("map_version", F.lit(slot_map.version))
    table.coalesce(1).write.mode("append").partitionBy("map_version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored map, the latest unless a version is named; one row per slot comes to the driver."""
    table = spark.read.schema("vslot int, shard int, size long, rows long, shards int, map_version int").parquet(path)
    if version is None:
        version = table.agg(F.max("map_version")).first()[0]
    rows = table.where(F.col("map_version") == version).orderBy("vslot").collect()
    return SlotMap(rows[0]["shards"], *([r[c] for r in rows] for c in ("shard", "size", "rows")), version)


def grow_map(spark: SparkSession, path: str) -> SlotMap:
    """Store and give the next version of the latest map, with one more shard."""
    new = read_map(spark, path).grow()
    write_map(spark, path, new)
    return new


def rebalance_map(records: DataFrame, path: str, slack: float = 0.02) -> SlotMap:
    """Store and give the next version of the latest map, edited for the sums of ``records``."""
    spark = records.sparkSession
    old = read_map(spark, path)
    new = old.rebalance(*slot_sums(records, len(old.shard_of)), slack)
    write_map(spark, path, new)
    return new


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, nth and vslot of every record, staged.

    nth numbers records of the same doc_id, size and checksum. They are counted where they are read
    and made again from the counts, so however many there are they meet in no task, their slots
    depend on nothing but the records, and they are spread over all slots.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_AT_ONCE).cast("long")))
    each = F.explode(F.sequence("begin", F.least(F.col("begin") + _AT_ONCE, F.col("n")) - 1))
    made = counted.withColumn("begin", begins).withColumn("nth", each).select("doc_id", "size", "text_crc32", "nth")
    return stage(made.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "nth"), F.lit(slots)).cast("int")), "records")


#: Equal records that are numbered at once.
_AT_ONCE = 1 << 16


def slot_sums(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows by slot; the driver gets one row per slot."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r["vslot"]], rows[r["vslot"]] = r["size"], r["n"]
    return size, rows


def place(records: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Each record's shard by the stored map, and its place there, gapless from 0 where the map's sums are those of ``records``."""
    spark = records.sparkSession
    if version is None:
        version = read_map(spark, path).version
    shards = spark.read.schema("vslot int, shard int, rows long, map_version int").parquet(path).where(F.col("map_version") == version)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("vslot", "shard", "map_version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "nth")
    return (
        records.withColumn("rank", F.row_number().over(order) - 1)
        .join(F.broadcast(shards), "vslot")  # one row per slot
        .withColumn("slot", (F.col("first") + F.col("rank")).cast("long"))
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version of every record.

    The law is ``bytes``: shards have nearly equal sizes. slot is the record's place in its shard.
    The first version of the map is stored at ``path`` (a new one in the shared folder if there is
    none), and records are placed by what is read from there. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    records, path = slotted(docs, slots), path or new_path(spark, "slot-map")
    write_map(spark, path, SlotMap.build(*slot_sums(records, slots), shards))
    return place(records, path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )

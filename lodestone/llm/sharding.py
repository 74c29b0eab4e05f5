"""Sharding by fixed virtual slots: records are hashed into slots, slots are mapped to shards.

Every record falls into one of ``n_slots`` virtual slots by a hash of its
text (in a hot group of equal texts, of its id and text), for good. Bytes are summed per slot, and a versioned map sends
slots to shards so that the shards' bytes are near equal (the largest slot
first, to the shard with the fewest bytes). Rebalancing edits that map: it
moves as few slots as it can and gives the map the next version. Versions are
stored side by side in a folder, each with what every slot was mapped to before.

Whether a group of equal texts is hot is asked only for slots that are: a group
never has more bytes than its slot, so where no slot is above the bound (as a
rule) the sums per slot are all that is counted.

Only the sums per slot (``n_slots`` rows, a fixed number) reach the driver,
and only the map is broadcast. Positions in a shard are the slot's offset plus
the position in the slot, so no task sees more than a slot.

Defined results
- Null and empty texts have size 16; a null id is hashed like any value.
- Rows that repeat id and text fall into one slot and get positions of their own; ties of position go by id, crc32 and size.
- An empty table gives an empty result. Extra columns are left out.
- The law is ``bytes``: sizes of shards are near equal, as far as single records allow.
- Equal texts share a slot, and so a shard, unless they hold over 1/320 of all bytes (an eighth of one of 40 shards).
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import shared_dir

N_SLOTS = 8192
OVERHEAD = 16
#: A group of equal texts with more than one part in so many of all bytes is dealt over the slots.
HOT_GROUPS = 320


@dataclass
class SlotMap:
    """Slot to shard, with the history of its edits: (version, slot, old shard, new shard)."""

    version: int
    n_shards: int
    shard_of: list[int]
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A row a slot; ``before`` is its shard in the version before (null in the first)."""
        before = dict(enumerate(self.shard_of)) if self.version > 1 else {}
        before |= {slot: old for version, slot, old, _ in self.edits if version == self.version}
        rows = [(self.version, self.n_shards, slot, shard, before.get(slot)) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, n_shards int, slot int, shard int, before int")

    @staticmethod
    def from_df(df: DataFrame) -> SlotMap:
        """The map of one version, with the edits that led to it."""
        rows = sorted((r["slot"], r["shard"], r["version"], r["n_shards"], r["before"]) for r in df.collect())
        if [r[0] for r in rows] != list(range(len(rows))) or len({r[2:4] for r in rows}) != 1:
            raise ValueError("a map has one row for each slot, of one version")
        version, n_shards = rows[0][2:4]
        edits = [(version, slot, old, shard) for slot, shard, _, _, old in rows if old is not None and old != shard]
        return SlotMap(version, n_shards, [r[1] for r in rows], edits)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Store this version beside the others in ``folder``; one that is there already is an error."""
        self.to_df(spark).coalesce(1).write.mode("error").parquet(f"{folder}/version-{self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        return SlotMap.from_df(spark.read.parquet(f"{folder}/version-{version}"))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """id, size, crc, slot of each record: equal texts share a slot, but those of a hot group are dealt by their ids."""
    return sized_slots(docs, id_col, text_col, n_slots)[0]


def sized_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """As ``with_slots``, with the (bytes, rows) of every slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("_text"))
    slotted = rows.withColumn("vslot", F.pmod("_text", F.lit(n_slots)).cast("int"))
    sizes = slot_sizes(slotted, n_slots)
    bound = sum(b for b, _ in sizes) / HOT_GROUPS
    wide = [slot for slot, (b, _) in enumerate(sizes) if b > bound]
    # at most HOT_GROUPS slots, and as many groups, have such a share of the bytes
    hot = [r["_text"] for r in slotted.filter(F.col("vslot").isin(wide)).groupBy("_text").agg(F.sum("size").alias("b")).filter(F.col("b") > bound).collect()] if wide else []
    if not hot:
        return slotted.drop("_text"), sizes
    own = F.when(F.col("_text").isin(hot), F.pmod(F.xxhash64("id", "_text"), F.lit(n_slots)).cast("int"))
    slotted = slotted.withColumn("vslot", F.coalesce(own, "vslot")).drop("_text")
    return slotted, slot_sizes(slotted, n_slots)


def slot_sizes(slotted: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot; n_slots entries whatever the input."""
    sizes = [(0, 0)] * n_slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["vslot"]] = (r["b"], r["n"])
    return sizes


def build_map(sizes: list[tuple[int, int]], n_shards: int) -> SlotMap:
    """Version 1: the largest slot first, each to the lightest shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s][0], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + sizes[slot][0], shard))
    return SlotMap(1, n_shards, shard_of)


def rebalance(old: SlotMap, sizes: list[tuple[int, int]], n_shards: int, slack: float = 0.02) -> SlotMap:
    """The next version: slots leave removed shards and shards above the mean by ``slack``, the largest that fit first."""
    load = [0] * max(n_shards, old.n_shards)
    slots: list[list[int]] = [[] for _ in load]
    for slot, shard in enumerate(old.shard_of):
        load[shard] += sizes[slot][0]
        slots[shard].append(slot)
    limit = sum(load) / n_shards * (1 + slack)
    moving: list[int] = []
    for shard, own in enumerate(slots):
        for slot in sorted(own, key=lambda s: (-sizes[s][0], s)):
            b = sizes[slot][0]
            if shard >= n_shards or (b and load[shard] > limit and load[shard] - b >= limit / (1 + slack) * (1 - slack)):
                load[shard] -= b
                moving.append(slot)
    heap = [(load[s], s) for s in range(n_shards)]
    heapq.heapify(heap)
    new = SlotMap(old.version + 1, n_shards, list(old.shard_of), list(old.edits))
    for slot in sorted(moving, key=lambda s: (-sizes[s][0], s)):
        b, shard = heapq.heappop(heap)
        heapq.heappush(heap, (b + sizes[slot][0], shard))
        if shard != old.shard_of[slot]:
            new.edits.append((new.version, slot, old.shard_of[slot], shard))
        new.shard_of[slot] = shard
    return new


def assign(slotted: DataFrame, sizes: list[tuple[int, int]], slot_map: SlotMap, later: SlotMap | None = None) -> DataFrame:
    """id, size, crc, vslot, shard and the position in the shard (gapless from 0); next_shard by a later version of the map."""
    spark = slotted.sparkSession
    at, rows = [0] * slot_map.n_shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        rows.append((slot, shard, at[shard], slot_map.version, later.shard_of[slot] if later else None))
        at[shard] += sizes[slot][1]
    known = spark.createDataFrame(rows, "vslot int, shard int, start long, map_version int, next_shard int")
    order = Window.partitionBy("vslot").orderBy("id", "crc", "size")
    numbered = slotted.withColumn("n", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(known), "vslot").withColumn("position", F.col("start") + F.col("n"))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, grown: int | None = None, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with their places, and the map; with ``grown``, also by the map edited for so many shards.

    The versions are stored in ``folder``, or in a new one of the shared folder, and read again from there.
    """
    spark = docs.sparkSession
    slotted, sizes = sized_slots(docs, id_col, text_col, n_slots)
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    build_map(sizes, n_shards).save(spark, folder)
    slot_map, later = SlotMap.load(spark, folder, 1), None
    if grown:
        rebalance(slot_map, sizes, grown).save(spark, folder)
        later = SlotMap.load(spark, folder, 2)
    return assign(slotted, sizes, slot_map, later), slot_map

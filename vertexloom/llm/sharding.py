"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record is hashed into one of thousands of slots, for good. Bytes are summed
per slot, and a small map from slots to shards, kept in numbered versions,
decides where a slot lives. Rebalancing edits the map: slots leave shards that
hold too much and go to those that hold least, then slots are moved and
swapped until no exchange brings shards closer, so that the shards' bytes come
out nearly equal (law ``bytes``). A shard that one unsplittable slot fills
beyond the others stays as it is, and the rest are levelled among themselves.

A record is hashed by its id and its text's size and checksum; rows that are
equal in all three are told apart by their number among each other. So rows
without id, and any number of copies of a row, spread over all slots.

Defined cases: a null text has 0 bytes and the checksum 0; null is an id like
any other; an empty table gives an empty result; a map path without versions
starts with the first map.

The main path is DataFrame code; only the map, whose length is the fixed
number of slots, is edited on the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions.shared import exists, materialize, scratch_path
from vertexloom.llm.ordinals import with_ordinal

SLOTS = 4096
#: Shards that differ by no more than this share of the mean are level.
LEVEL = 1e-4


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of a map: ``shard_of[slot]`` is in 0 to ``shards - 1``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, slot_bytes: Sequence[int], shards: int | None = None) -> SlotMap:
        """The next version, with few slots moved so that bytes per shard are nearly equal.

        A shard above the mean gives up the largest slots that its excess still
        holds; these, and the slots of shards that are no more, go from the
        largest on to the shard that holds least. What is left is levelled.
        """
        shards = shards or self.shards
        mean = sum(slot_bytes) / shards
        held = [0] * shards
        own: list[list[int]] = [[] for _ in range(shards)]
        moving = []
        for slot, shard in enumerate(self.shard_of):
            if shard < shards:
                held[shard] += slot_bytes[slot]
                own[shard].append(slot)
            else:
                moving.append(slot)
        for shard in range(shards):
            for slot in sorted(own[shard], key=lambda s: -slot_bytes[s]):
                if 0 < slot_bytes[slot] <= held[shard] - mean:
                    held[shard] -= slot_bytes[slot]
                    moving.append(slot)
        shard_of = list(self.shard_of)
        for slot in sorted(moving, key=lambda s: (-slot_bytes[s], s)):
            least = min(range(shards), key=lambda s: (held[s], s))
            shard_of[slot] = least
            held[least] += slot_bytes[slot]
        level(shard_of, slot_bytes, shards)
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def shard(self, slot: Column) -> Column:
        """The shard of a slot, looked up in a literal of fixed length."""
        return lookup(self.shard_of, slot, "int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones; an existing version is not overwritten."""
        spark.range(len(self.shard_of)).select(
            F.col("id").cast("int").alias("slot"), self.shard(F.col("id")).alias("shard"), F.lit(self.shards).alias("shards")
        ).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default. The table has one row per slot and version, so its rows are few."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == version).orderBy("slot").collect()
        return cls(version, found[0]["shards"], tuple(r["shard"] for r in found))


def level(shard_of: list[int], slot_bytes: Sequence[int], shards: int) -> None:
    """Move and swap slots, in place, until no exchange with the fullest shard brings it closer to another.

    A shard that has none left is put aside, and the others go on. Each
    exchange lessens the sum of squares, so the work ends.
    """
    held = [0] * shards
    # A slot of no bytes stands for none: exchanged for it, a slot is moved.
    own: list[list[tuple[int, int]]] = [[(0, -1)] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard] += slot_bytes[slot]
        if slot_bytes[slot]:
            insort(own[shard], (slot_bytes[slot], slot))
    slack = LEVEL * sum(held) / shards
    active = sorted(range(shards), key=lambda s: held[s])
    while len(active) > 1:
        full = active[-1]
        if held[full] - held[active[0]] <= slack:
            break
        for low in active[:-1]:
            found = _exchange(own[full], own[low], held[full] - held[low])
            if found:
                give, take = found
                for item, source, target in ((give, full, low), (take, low, full)):
                    if item[1] >= 0:
                        own[source].remove(item)
                        insort(own[target], item)
                        shard_of[item[1]] = target
                        held[source] -= item[0]
                        held[target] += item[0]
                active.sort(key=lambda s: held[s])
                break
        else:
            active.pop()


def _exchange(full: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """A slot of each, whose difference is closest to half the gap, if their exchange narrows it."""
    best, found = gap, None
    for give in full[1:]:
        at = bisect_left(low, (give[0] - gap // 2, -1))
        for take in low[max(0, at - 1) : at + 1]:
            off = abs(gap - 2 * (give[0] - take[0]))
            if off < best:
                best, found = off, (give, take)
    return found


def lookup(values: Sequence[int], index: Column, kind: str) -> Column:
    """``values[index]`` through a constant that the optimizer folds to an array."""
    table = F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    return F.element_at(table, (index + 1).cast("int"))


def virtual_slot(key: list[Column], slots: int = SLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_totals(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot; the driver gets ``slots`` rows at most."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["rows"]
    return size, count


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, virtual_slot, shard, slot, grown_shard, map_version.

    ``slot`` is the row's place in its shard, gapless from 0: the places of a
    virtual slot follow those of the slots before it, so no task ever orders a
    whole shard. ``grown_shard`` is null, as the law is ``bytes``. The map is
    read from ``map_path`` if it has versions, else it is the first map, and
    the edited map is stored there.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit(""))
    read = materialize(
        docs.select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data.cast("binary")).alias("text_crc32")), "shard-rows"
    )
    key = ["doc_id", "size", "text_crc32"]
    rows = with_ordinal(read, key).withColumn("virtual_slot", virtual_slot([F.col(c) for c in (*key, "ordinal")], slots))
    size, count = slot_totals(rows, slots)
    if map_path is None:
        map_path = scratch_path(spark, "slot-map")
    if not exists(spark, map_path):
        SlotMap.first(slots, shards).save(spark, map_path)
    new = SlotMap.load(spark, map_path).rebalanced(size, shards)
    new.save(spark, map_path)
    start, filled = [0] * slots, [0] * shards
    for slot, shard in enumerate(new.shard_of):
        start[slot] = filled[shard]
        filled[shard] += count[slot]
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "virtual_slot",
        new.shard(F.col("virtual_slot")).alias("shard"),
        (lookup(start, F.col("virtual_slot"), "bigint") + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(new.version).alias("map_version"),
    )

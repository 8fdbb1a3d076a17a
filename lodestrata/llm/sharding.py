"""Sharding by fixed virtual slots.

A record's digest (its id and text) decides its slot for good: a hash into `slots` virtual
slots. A versioned map assigns slots to shards. Version 1 gives each shard a run of slots;
`rebalanced` aggregates the bytes of each slot and edits the map (a new version; old ones stay
readable) until the shards' sizes are near equal, moving few slots. Only the map changes, never
a record's slot, and both the map and the bytes per slot have a fixed number of rows.

Versions are rows of a stored table (version, parent, slot, shard). `shard_documents` given such
a table starts from its last version, adds the edited one and reads it back for the join.

Defined results: a null text has no bytes; rows with one id and different texts lie in slots of
their own; of rows that are equal the copies are dealt over the slots by their place in the
table, so that a third of all rows being one record fills no slot more than others (equal rows
have no identity, only their number counts); a null id or text hashes as a null; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_dir, stored

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """slot -> shard, with a version and the versions it came from."""

    shards: int
    owner: tuple[int, ...]
    version: int = 1
    parent: SlotMap | None = None

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, tuple(s * shards // slots for s in range(slots)))

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """Edit the map so that the shards' bytes are near equal: each shard above the mean gives
        its smallest slots until it is not, the released slots go, largest first, to the shard
        with the fewest bytes, and single moves and swaps follow while they lower the spread."""
        load = [0] * self.shards
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            load[shard] += sizes.get(slot, 0)
            own[shard].append(slot)
        mean = sum(load) / self.shards
        owner, freed = list(self.owner), []
        for shard in range(self.shards):
            for slot in sorted(own[shard], key=lambda s: (sizes.get(s, 0), s)):
                if load[shard] <= mean:
                    break
                if sizes.get(slot, 0):
                    freed.append(slot)
                    load[shard] -= sizes[slot]
        heap = [(b, i) for i, b in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(freed, key=lambda s: (-sizes[s], s)):
            b, i = heapq.heappop(heap)
            owner[slot] = i
            heapq.heappush(heap, (b + sizes[slot], i))
        self._refine(owner, sizes)
        return SlotMap(self.shards, tuple(owner), self.version + 1, self)

    def grown(self) -> SlotMap:
        """One shard more, which takes slots from the others and from nowhere else."""
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.owner):
            own[shard].append(slot)
        owner = list(self.owner)
        for slots in own:
            for slot in slots[:: self.shards + 1]:
                owner[slot] = self.shards
        return SlotMap(self.shards + 1, tuple(owner), self.version + 1, self)

    def _refine(self, owner: list[int], sizes: dict[int, int], rounds: int = 400) -> None:
        """Between the largest and the smallest shard, move the slot or swap the two slots that
        leaves them closest; stop when nothing brings them closer."""
        load = [0] * self.shards
        own: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            load[shard] += sizes.get(slot, 0)
            if sizes.get(slot):
                own[shard].add(slot)
        for _ in range(rounds):
            top, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[top] - load[low]
            if gap <= 1:
                return
            high = sorted((sizes[s], s) for s in own[top])
            small = [(0, -1), *sorted((sizes[s], s) for s in own[low])]
            best, j = (gap, -1, -1), 0
            for size, slot in high:
                while j + 1 < len(small) and abs(gap - 2 * (size - small[j + 1][0])) <= abs(gap - 2 * (size - small[j][0])):
                    j += 1
                after = abs(gap - 2 * (size - small[j][0]))
                if after < best[0]:
                    best = (after, slot, small[j][1])
            after, slot, other = best
            if slot < 0:
                return
            for s, a, b in ((slot, top, low), (other, low, top)):
                if s >= 0:
                    own[a].remove(s)
                    own[b].add(s)
                    owner[s] = b
                    load[a] -= sizes[s]
                    load[b] += sizes[s]

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, parent, slot, shard); `slots` rows."""
        parent = self.parent.version if self.parent else None
        return spark.createDataFrame([(self.version, parent, i, s) for i, s in enumerate(self.owner)], MAP)

    def save(self, spark: SparkSession, path: str) -> SlotMap:
        """Add this version to the table at `path`."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A stored version with its parents, the last by default; None if there is none."""
        rows = spark.read.schema(MAP).parquet(path)
        known = {r["version"]: r["parent"] for r in rows.select("version", "parent").distinct().collect()}
        if not known:
            return None
        line, v = [], max(known) if version is None else version
        while v is not None:
            line.append(v)
            v = known[v]
        out = None
        for v in reversed(line):
            owner = [r["shard"] for r in rows.where(F.col("version") == v).orderBy("slot").collect()]  # `slots` rows
            out = cls(max(owner) + 1, tuple(owner), v, out)
        return out


MAP = "version int, parent int, slot int, shard int"


def slot_of(*key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def digests(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), stored. The texts are read once; what is kept is
    a few numbers a row."""
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit("record"), F.col(doc_id), F.lit("text"), F.col(text)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = stored(own, "digests")
    twice = stored(own.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("again")), "copies")
    copy = F.when(F.col("again"), F.col("row"))
    return stored(own.join(twice, "digest", "left").select("doc_id", "size", "text_crc32", "row", slot_of("digest", copy, slots=slots).alias("virtual_slot")), "slotted")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", maps: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) and the map.

    `maps` is the path of a table of versions, which goes on from its last one; without it the
    versions go to a table of their own in the shared folder. `slot` is a row's place in its
    shard, counted over the shard's virtual slots in order: rows before it in earlier slots (a
    fixed number of sums) plus its place in its own slot, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    digest = digests(docs, slots, doc_id, text)
    sums = stored(digest.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slots")
    path = maps or new_dir(spark, "slot_maps")
    now = SlotMap.load(spark, path) if maps and _exists(spark, path) else None
    if now is None:
        now = SlotMap.first(shards, slots).save(spark, path)
    if len(now.owner) != slots or now.shards > shards:
        raise ValueError(f"the stored map has {len(now.owner)} slots on {now.shards} shards")
    while now.shards < shards:
        now = now.grown().save(spark, path)
    now = now.rebalanced({r["virtual_slot"]: r["bytes"] for r in sums.collect()}).save(spark, path)  # at most `slots` rows
    owner = spark.read.schema(MAP).parquet(path).where(F.col("version") == now.version).select(F.col("slot").alias("virtual_slot"), "shard", "version")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.join(owner, "virtual_slot").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One row for each slot: its size is fixed by the number of slots, not by the data.
    places = F.broadcast(places.select("virtual_slot", "shard", "version", "before"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row")
    out = digest.withColumn("at", F.row_number().over(within)).join(places, "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"), "virtual_slot", F.col("version").alias("map_version")), now


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def op8_virtual_slot_sharding(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` in 24 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = shard_documents(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")

"""Sharding through a fixed number of virtual slots and a versioned map from slots to shards.

A record hashes to one of a few thousand slots, once and for all.  Which shard holds a slot is written in a small
table of versions: a version holds only the slots whose shard changed, and the shard of a slot is what its
latest version says.  To rebalance means to sum up the bytes of each slot and to edit the map; no other
slot moves.  Only the sums of the slots go to the driver, as many rows as there are slots.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import query, shared_folder, stored, table

SLOTS = 4096
SHARDS = 24
OVERHEAD = 8
MAP = "slot int, shard int"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest, nth) of every row, written once.

    A null text has no bytes and the checksum 0.  ``digest`` is of the id and the text; ``nth`` is any number that
    tells rows apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")
    digest = F.xxhash64(F.col(id_col), text)
    return stored(
        docs.select(
            F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("digest"), F.monotonically_increasing_id().alias("nth")
        )
    )


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records`` with the virtual slot of each.

    A record that repeats until its copies hold more bytes than an average slot is dealt over as many slots as
    it fills: equal rows can't be told apart, so no row loses its place by it.  Fewer than ``slots`` digests can be that
    heavy, which bounds the broadcast; they are looked for in slots of twice the average alone.
    """
    hashed = rows.withColumn("slot", F.pmod("digest", F.lit(slots)).cast("int"))
    bytes_of = {s: b for s, b in hashed.groupBy("slot").agg(F.sum("size")).collect()}
    fair = max(1, sum(bytes_of.values()) // slots)
    crowded = [s for s, b in bytes_of.items() if b > 2 * fair]
    if not crowded:
        return hashed
    spark = rows.sparkSession
    watched = F.broadcast(spark.createDataFrame([(s,) for s in crowded], "slot int"))
    heavy = hashed.join(watched, "slot", "left_semi").groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    heavy = heavy.filter((F.col("n") > 1) & (F.col("bytes") > fair))
    heavy = stored(heavy.select("digest", F.least("n", F.ceil(F.col("bytes") / F.lit(fair))).alias("parts")))
    dealt = hashed.join(F.broadcast(heavy), "digest", "left")
    share = F.pmod(F.xxhash64("nth"), F.col("parts"))
    own = F.pmod(F.xxhash64("digest", share), F.lit(slots)).cast("int")
    return dealt.withColumn("slot", F.when(F.col("parts").isNull(), F.col("slot")).otherwise(own)).drop("parts")


def slot_loads(placed: DataFrame) -> DataFrame:
    """(slot, bytes, n) of the slots that have rows."""
    return placed.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _best(weights: np.ndarray, others: np.ndarray, gap: int) -> tuple[int, int | None, int]:
    """Which entry of ``weights`` to give, for which of ``others`` or None, so that the gap shrinks most; and what it leaves."""
    best: tuple[int, int | None, int] = (-1, None, gap)
    if len(weights) == 0:
        return best
    left = np.where(weights > 0, np.abs(gap - 2 * weights), gap)
    i = int(np.argmin(left))
    if left[i] < best[2]:
        best = (i, None, int(left[i]))
    if len(others):
        order = np.argsort(others, kind="stable")
        ranked = others[order]
        # a partner whose weight is nearest to weights - gap / 2, from below and from above
        at = np.searchsorted(ranked, weights - gap // 2)
        for shift in (-1, 0):
            pick = np.clip(at + shift, 0, len(ranked) - 1)
            left = np.abs(gap - 2 * (weights - ranked[pick]))
            i = int(np.argmin(left))
            if left[i] < best[2]:
                best = (i, int(order[pick[i]]), int(left[i]))
    return best


def rebalance(shard_of: np.ndarray, load: np.ndarray, shards: int, only_into: int | None = None) -> np.ndarray:
    """The map edited until no slot given, or swapped for another, brings two shards nearer to each other.

    The fullest shard deals with the emptiest one first, then with the next.  Each edit lowers the sum of the squared loads, so it
    ends.  Empty slots stay where they are.  ``only_into`` names a shard that may take slots and give none, while all others may
    only give to it: that is how a shard is added.
    """
    shard_of = shard_of.copy()
    total = np.bincount(shard_of, weights=load, minlength=shards).astype(np.int64)
    while True:
        order = np.argsort(total, kind="stable")
        for hi, lo in ((h, w) for h in order[::-1] for w in order if total[h] > total[w] and (only_into is None or w == only_into)):
            gap = int(total[hi] - total[lo])
            mine, theirs = np.flatnonzero((shard_of == hi) & (load > 0)), np.flatnonzero((shard_of == lo) & (load > 0))
            i, j, left = _best(load[mine], load[theirs] if only_into is None else load[:0], gap)
            if i >= 0 and left < gap:
                break
        else:
            return shard_of
        given = mine[i]
        shard_of[given] = lo
        moved = int(load[given])
        if j is not None:
            shard_of[theirs[j]] = hi
            moved -= int(load[theirs[j]])
        total[hi] -= moved
        total[lo] += moved


def grow(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map for one shard more: slots move into the new shard ``shards`` and nowhere else."""
    return rebalance(shard_of, load, shards + 1, only_into=shards)


class SlotMap:
    """The versions of a map under one folder: a Parquet table of (version, slot, shard), an edit a version."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0 deals the slots out in turn."""
        made = cls(spark, path, slots)
        made._write(0, {s: s % shards for s in range(slots)})
        return made

    def _write(self, version: int, edit: Mapping[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(edit.items()), MAP).coalesce(1)
        rows.write.mode("error").parquet(f"{self.path}/version={version}")

    def edits(self) -> DataFrame:
        """(slot, shard, version) of all versions."""
        return self.spark.read.schema(f"{MAP}, version int").parquet(self.path)

    def version(self) -> int:
        return self.edits().agg(F.max("version")).first()[0]

    def at(self, version: int | None = None) -> DataFrame:
        """(slot, shard, version): for each slot what the latest edit up to ``version`` says."""
        rows = self.edits() if version is None else self.edits().filter(F.col("version") <= version)
        last = rows.groupBy("slot").agg(F.max(F.struct("version", "shard")).alias("last"))
        return last.select("slot", "last.shard", "last.version")

    def array(self, version: int | None = None) -> np.ndarray:
        out = np.zeros(self.slots, np.int64)
        for slot, shard, _ in self.at(version).collect():
            out[slot] = shard
        return out

    def edit(self, shard_of: np.ndarray) -> int:
        """Writes the slots whose shard differs as the next version; without a difference the version stays."""
        now = self.array()
        changed = np.flatnonzero(now != shard_of)
        version = self.version()
        if len(changed) == 0:
            return version
        self._write(version + 1, {int(s): int(shard_of[s]) for s in changed})
        return version + 1


def numbered(placed: DataFrame, shard_of: np.ndarray, rows_of: np.ndarray) -> DataFrame:
    """Adds shard and the gapless place of each row in its shard (``slot``; the virtual slot becomes ``hash_slot``).

    A shard's rows follow each other by virtual slot, and within one by digest.  The first place of each virtual slot comes from the
    counts, so a window holds the rows of one virtual slot and never those of a shard.
    """
    spark = placed.sparkSession
    first = np.zeros(len(shard_of), np.int64)
    for shard in np.unique(shard_of):
        own = np.flatnonzero(shard_of == shard)
        first[own] = np.cumsum(rows_of[own]) - rows_of[own]
    # one row for each virtual slot: a proven bound
    places = spark.createDataFrame([(s, int(shard_of[s]), int(first[s])) for s in range(len(shard_of))], "hash_slot int, shard int, first long")
    within = F.expr("row_number() OVER (PARTITION BY hash_slot ORDER BY digest, doc_id, size, text_crc32) - 1")
    ranked = placed.withColumnRenamed("slot", "hash_slot").withColumn("within", within)
    return ranked.join(F.broadcast(places), "hash_slot").withColumn("slot", F.col("first") + F.col("within")).drop("first", "within")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hash_slot, map_version) of every row of ``docs``.

    ``path`` is the folder of the map; without one, a new map is made in the shared folder.  The bytes of the slots
    are summed up, the map is edited where the shards differ, and the rows go by the edited map: the shards are as near
    in bytes as slots can bring them.  One row is never cut, so a shard can't be smaller than its largest row.
    Null ids and texts, empty texts and repeated rows are rows like any other; no rows give no rows; further columns are not
    looked at.
    """
    spark = docs.sparkSession
    placed = slotted(records(docs.select("doc_id", "text")), slots)
    load, rows_of = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for slot, size, n in slot_loads(placed).collect():
        load[slot], rows_of[slot] = size, n
    if path is None:
        path = os.path.join(shared_folder(spark), f"slot-map-{uuid.uuid4().hex}")
        slot_map = SlotMap.create(spark, path, shards, slots)
    else:
        slot_map = SlotMap(spark, path, slots)
    shard_of = rebalance(slot_map.array(), load, shards)
    version = slot_map.edit(shard_of)
    return numbered(placed, shard_of, rows_of).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hash_slot", F.lit(version).alias("map_version")
    )


@query("op11_virtual_slots")
def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))

"""Sharding by best-fit decreasing over a balanced tree.

Rows of one group stay together. Groups sorted by size enter the bin with the least room that still holds them,
found in a balanced search tree of the bins' remaining room. ``pack`` opens as few bins of a fixed capacity as that
gives; ``balance`` looks for the smallest capacity that needs no more than a given number of bins.

Scale: group sizes are summed with a map-side combine. Only groups of at least total / (shards * HEAVY) bytes are packed one
by one: there are at most shards * HEAVY of them. All lighter ones are dealt by their hash to COARSE + FINE buckets, and the buckets
are packed, so the driver holds a bounded table at any input size, and both maps are broadcast within that bound.
A group above a fair share gets a shard of its own.

Defined results: a null text counts as empty; equal texts are one group whatever their other columns; rows may repeat; an
empty table gives no rows. Slots number the rows of a shard without gaps in hash order of the id.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.runtime import settle

HEAVY = 512  # groups of 1 / HEAVY of a shard and more are packed one by one
COARSE, FINE, FINE_SHARE = 2048, 2048, 0.1  # hash buckets of the lighter ones; the fine ones, a tenth together, level the rest
SLOT_BUCKETS = 1024  # of a shard's rows, when numbering them


class RoomTree:
    """A treap of (room, bin): insert, and remove the entry with the least room of at least ``size``."""

    def __init__(self, seed: int = 42):
        self.root, self.random = None, random.Random(seed)

    def insert(self, room: int, bin: int) -> None:
        low, high = self._split(self.root, (room, bin))
        self.root = self._merge(self._merge(low, [(room, bin), self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self.root, (size, -1))
        node, above = high, None
        while node and node[2]:
            above, node = node, node[2]
        if node:
            if above:
                above[2] = node[3]
            else:
                high = node[3]
        self.root = self._merge(low, high)
        return node[0] if node else None

    def _split(self, node, key):
        if not node:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if not a or not b:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def pack(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size by best-fit decreasing; None once more than ``most`` bins are needed.
    A size above the capacity takes a bin of its own."""
    tree, bins, place = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if most is not None and bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        place[i] = found[1]
        tree.insert(found[0] - sizes[i], found[1])
    return place


def balance(sizes: Sequence[int], shards: int) -> list[int]:
    """Best-fit decreasing into ``shards`` bins of the smallest capacity found that holds all."""
    place, left, free = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), shards
    rest = sum(sizes)
    while free > 1 and left and sizes[left[0]] * free > rest:  # above a fair share: alone
        rest -= sizes[left[0]]
        free -= 1
        place[left.pop(0)] = free
    own = [sizes[i] for i in left]
    low = max([-(-rest // free), *own[:1]])
    high = low
    while (best := pack(own, high, free)) is None:
        high += max(1, low // 64)
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        tried = pack(own, middle, free)
        low, high, best = (low, middle, tried) if tried else (middle, high, best)
    for i, bin in zip(left, best):
        place[i] = bin
    return place


def _bucket(key: str) -> Column:
    """Hash bucket of a light group: COARSE large ones, then FINE small ones."""
    u = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    coarse = F.floor(u / (1 - FINE_SHARE) * COARSE)
    fine = COARSE + F.floor((u - (1 - FINE_SHARE)) / FINE_SHARE * FINE)
    return F.when(u < 1 - FINE_SHARE, F.least(coarse, F.lit(COARSE - 1))).otherwise(
        F.greatest(F.least(fine, F.lit(COARSE + FINE - 1)), F.lit(COARSE))).cast("int")


def shard(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row: equal texts together, bytes near equal."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = settle(docs.select(
        F.col(id).alias("id"), (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * HEAVY))
    heavy = groups.where(F.col("size") >= least).orderBy(F.desc("size"), "key").collect()
    light = groups.where(F.col("size") < least).groupBy(_bucket("key").alias("bucket")).agg(F.sum("size").alias("size")).orderBy("bucket").collect()
    place = balance([r["size"] for r in heavy] + [r["size"] for r in light], shards)
    by_key = spark.createDataFrame([(r["key"], p) for r, p in zip(heavy, place)], "key binary, own int")
    by_bucket = spark.createDataFrame([(r["bucket"], p) for r, p in zip(light, place[len(heavy):])], "bucket int, dealt int")
    placed = rows.join(F.broadcast(by_key), "key", "left").withColumn("bucket", _bucket("key")).join(F.broadcast(by_bucket), "bucket", "left").select(
        "id", "size", "text_crc32", F.coalesce("own", "dealt").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(SLOT_BUCKETS)).cast("int").alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"))

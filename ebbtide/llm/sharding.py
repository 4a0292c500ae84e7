"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts are one group and stay together. Groups larger than a crate are crates of their own; the others are packed
into crates by best-fit decreasing inside many tasks, each over its own share of the groups. The few thousand crates,
whose number follows the crate size and not the table, are then packed into shards by best-fit decreasing, with the
smallest shard capacity that needs no more than the wanted number of shards. So shards differ by about a crate, unless a
single group is larger than a fair share. Both packings look up the tightest bin in a balanced tree.

A null text has no bytes and is a copy of the empty text. Repeated rows are copies. Null doc_ids are numbered like the
others. Columns beyond doc_id and text are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ebbtide.llm.workspace import Workspace, partitions

#: Groups that one task packs, about; its memory is bounded by this.
GROUPS_A_TASK = 200_000


class Tree:
    """A treap of (room, bin): the tightest bin with enough room in logarithmic time."""

    def __init__(self, seed: int = 1):
        self.root = None
        self.draw = random.Random(seed).random

    # A node is [key, priority, left, right].
    def _split(self, node, key):
        """(smaller than key, the rest)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, name: int) -> None:
        left, right = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(left, [(room, name), self.draw(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) with the least room that holds size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        parent, node = None, right
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of every size, sizes given from large to small; None if it takes more than `most` bins.

    A size beyond the capacity gets a bin of its own.
    """
    tree, bins, count = Tree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if most is not None and (count == most or size > capacity):
                return None
            found = (capacity, count)
            count += 1
        bins.append(found[1])
        if found[0] > size:
            tree.add(found[0] - size, found[1])
    return bins


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """The shard of every size (large to small), at the smallest capacity for which best fit needs `shards` at most."""
    low = max([-(-sum(sizes) // shards), *sizes[:1]])
    high, found = low, best_fit(sizes, low, shards)
    while found is None:
        low, high = high + 1, high + max(1, high // 64)
        found = best_fit(sizes, high, shards)
    while low < high:
        middle = (low + high) // 2
        trial = best_fit(sizes, middle, shards)
        if trial is None:
            low = middle + 1
        else:
            high, found = middle, trial
    return found


def crates(groups: DataFrame, capacity: int) -> DataFrame:
    """(key, bytes, crate) of the groups (key, bytes) of at most `capacity` bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        rows.sort(key=lambda r: (-r[1], r[0]))
        place = TaskContext.get().partitionId() << 32
        bins = best_fit([r[1] for r in rows], capacity)
        for start in range(0, len(rows), 10_000):
            part = rows[start : start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.string()),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array([place + b for b in bins[start : start + 10_000]], pa.int64()),
                ],
                names=["key", "bytes", "crate"],
            )

    return groups.select("key", "bytes").mapInArrow(task, "key string, bytes bigint, crate bigint")


def shard(docs: DataFrame, shards: int = 8, grain: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs (doc_id, text).

    size: UTF-8 bytes of the text plus 1. slot: 0, 1, ... within the shard. A crate holds 1/grain of a shard.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = work.keep(
        docs.select(
            F.col("doc_id").cast("bigint"),
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        )
    )
    groups = work.keep(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity = max(1, -(-total // (shards * grain)))
    tasks = max(1, n // GROUPS_A_TASK + 1)
    small = groups.where(F.col("bytes") <= capacity).repartition(tasks, "key")
    packed = crates(small, capacity)
    # A large group is a crate of its own, numbered below zero; there are at most shards * grain of them.
    large = groups.where(F.col("bytes") > capacity).withColumn("crate", F.row_number().over(Window.orderBy("key")) * F.lit(-1))
    packed = work.keep(packed.union(large.select("key", "bytes", F.col("crate").cast("bigint"))))
    sums = packed.groupBy("crate").agg(F.sum("bytes").alias("bytes"))
    listed = sorted(((r["bytes"], r["crate"]) for r in sums.collect()), key=lambda r: (-r[0], r[1]))
    place = fewest_capacity([r[0] for r in listed], shards) if listed else []
    found = spark.createDataFrame([(c, s) for (_, c), s in zip(listed, place)], "crate bigint, shard int")
    home = packed.join(found, "crate").select("key", "shard")
    # Slots are counted in buckets of rows, so that a shard or a group of any size is shared by many tasks.
    buckets = partitions(spark) * 4
    placed = work.keep(
        rows.join(home, "key").select(
            "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
        )
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("before")).cast("bigint").alias("slot")
    )

"""Joins within buckets: rows that share a bucket are compared, each pair once.

`members` has (bucket, id), both long. `payload` has (id, weight, data...), one row per id. The links come back as
counts per id and as star edges, never as all pairs, so a group of n alike rows costs n rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.workspace import partitions


def without_repeats(members: DataFrame) -> DataFrame:
    """Drop buckets of one member, and all but one of the buckets with the same members.

    Same members means equal counts and equal 128 bits of order-free hashes. Neither cut can lose a pair.
    """
    h, g = F.xxhash64("id"), F.xxhash64(F.lit(1), "id")
    signature = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(h).alias("a"), F.sum(F.shiftright(g, 20)).alias("b")
    )
    chosen = signature.where("n > 1").groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return members.join(chosen, "bucket")


def block_pairs(members: DataFrame, limit: int) -> DataFrame:
    """Each member of a bucket of n gets to the pairs of blocks that its own block is in; n may be any number."""
    blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "id")


def _met_before(lists: list[np.ndarray], bucket: int, other: list[np.ndarray]) -> np.ndarray:
    """Whether two rows already share a smaller bucket."""
    every = [x[x < bucket] for x in (*lists, *other)]
    names, at = np.unique(np.concatenate(every), return_inverse=True)
    there = np.zeros((len(every), len(names)), dtype=np.float32)
    there[np.repeat(np.arange(len(every)), [len(x) for x in every]), at] = 1
    return there[: len(lists)] @ there[len(lists) :].T > 0


def _labels(found: np.ndarray, square: bool) -> np.ndarray:
    """The smallest row that each row reaches by the links found; the columns come after the rows unless square."""
    n, m = found.shape
    label = np.arange(n if square else n + m)
    rows, cols = np.nonzero(found)
    cols = cols if square else cols + n
    while True:
        low = np.minimum(label[rows], label[cols])
        after = label.copy()
        np.minimum.at(after, rows, low)
        np.minimum.at(after, cols, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def in_blocks(rows: DataFrame, data: list[str], handle: Callable, schema: str) -> DataFrame:
    """Rows (bucket, left, right, own, id, data...) by pair of blocks: handle(bucket, a, b) yields tuples of the schema.

    a and b are lists of (id, data...); b is a where a block meets itself. Pairs of blocks without a pair are left out.
    """
    keys = ["bucket", "left", "right"]
    columns = [*keys, "own", "id", *data]
    rows = rows.select(*columns).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "own", "id")
    kinds = pa.schema([(f.split(" ")[0], pa.int64()) for f in schema.split(", ")])

    def pairs(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        a = [r[1:] for r in group if r[0] == key[1]]
        b = a if key[1] == key[2] else [r[1:] for r in group if r[0] == key[2]]
        if a and b and (a is not b or len(a) > 1):
            yield from handle(key[0], a, b)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            fixed = zip(*(batch.column(i).to_pylist() for i in range(5)))
            values = [_cells(batch.column(i)) for i in range(5, len(columns))]
            for i, (bucket, left, right, own, who) in enumerate(fixed):
                if (bucket, left, right) != key:
                    if key is not None:
                        out += pairs(key, group)
                    key, group = (bucket, left, right), []
                # A repeated input row has the same id; one is enough.
                if not group or group[-1][:2] != (own, who):
                    group.append((own, who, *(v(i) for v in values)))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kinds)
                out = []
        if key is not None:
            out += pairs(key, group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kinds)

    return rows.mapInArrow(task, schema)


def _cells(column: pa.Array) -> Callable:
    """A function from a place to its value: an array for lists, a string for texts."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        return lambda i: flat[at[i] : at[i + 1]]
    return lambda i: column[i].as_py()


def plausible(
    members: DataFrame, payload: DataFrame, data: list[str], alike: Callable, limit: int = 512, keep: Callable = lambda df: df
) -> DataFrame:
    """The members that alike() pairs with another one of the same bucket, by a cheaper look than link's.

    Buckets beyond the limit aren't looked at: all their members stay, so they cost one row a member. keep: writes a table
    that is read twice, see Workspace.
    """
    members = keep(without_repeats(members))

    def handle(bucket: int, a: list[tuple], b: list[tuple]) -> Iterator[tuple]:
        found = alike(a, b)
        if a is b:
            np.fill_diagonal(found, False)
        for i in np.flatnonzero(found.any(axis=1)):
            yield bucket, a[i][0]
        for i in np.flatnonzero(found.any(axis=0)) if a is not b else ():
            yield bucket, b[i][0]

    rows = block_pairs(members.where(F.col("n") <= limit), limit).join(payload, "id")
    looked = in_blocks(rows, data, handle, "bucket bigint, id bigint").distinct()
    return looked.union(members.where(F.col("n") > limit).select("bucket", "id"))


def link(
    members: DataFrame, payload: DataFrame, data: list[str], alike: Callable, limit: int = 512, keep: Callable = lambda df: df
) -> DataFrame:
    """(id, n, root): n is the weight linked to id in one pair of blocks, root an id linked to it.

    alike(a, b) gets lists of (id, buckets, weight, data...) and returns a boolean matrix. A pair is counted in the smallest
    bucket that both are in, so no pair counts twice. Sum n per id for its links; (id, root) are the edges. keep: as in plausible.
    """
    members = keep(without_repeats(members))
    lists = members.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    rows = block_pairs(members, limit).join(payload.join(lists, "id"), "id")

    def handle(bucket: int, a: list[tuple], b: list[tuple]) -> Iterator[tuple]:
        found = alike(a, b)
        if a is b:
            np.fill_diagonal(found, False)
        if found.any():
            found &= ~_met_before([r[1] for r in a], bucket, [r[1] for r in b])
        if not found.any():
            return
        every = a if a is b else [*a, *b]
        label = _labels(found, a is b)
        counts = found @ np.array([r[2] for r in b])
        if a is not b:
            counts = np.concatenate((counts, found.T @ np.array([r[2] for r in a])))
        for i in np.flatnonzero(counts):
            yield every[i][0], int(counts[i]), every[label[i]][0]

    return in_blocks(rows, ["buckets", "weight", *data], handle, "id bigint, n bigint, root bigint")

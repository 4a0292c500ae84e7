"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.workspace import Workspace


def _digest(edges: DataFrame) -> tuple:
    """The edges of a table as a number; two equal tables have the same."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, root) of every vertex of `edges` (u, v) but the roots; root: the smallest reachable id.

    Each step moves edges to the smallest known neighbour, until all are stars. The sums and joins run on the
    edge table, whose hot vertices Spark merges on the map side or splits in the join. Loops and repeated edges
    don't matter; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = work.write(edges)
    state = None
    while True:
        edges = work.spark.read.parquet(path)
        now = _digest(edges)
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Written, as the next step reads it twice: in one plan its tasks would run, and report to the driver, four times.
        halfway = work.write(large.where("u <> v").distinct())
        large = work.spark.read.parquet(halfway)
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        moved = F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("v", "u"))))
        small = joined.select(moved.alias("edge")).select("edge.u", "edge.v")
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = work.write(small)
        work.drop(path)
        work.drop(halfway)
        path = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))

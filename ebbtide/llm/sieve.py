"""Telling by a bitmap of bounded size which rows can match a set of hashes, so that the others cross no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Sixteen bits for a hash within these bounds: at most 2 MB, 262,144 words of 64 bits.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 24


def sieved(df: DataFrame, key: Column, hashes: DataFrame, into: str) -> DataFrame:
    """Add `into`: false where the hash `key` (bigint) is surely none of ``hashes`` (one bigint column; a written table).

    True says nothing for certain: an exact join has to follow. A table with more hashes than the bitmap can tell apart only
    lets more rows through. What is broadcast is the bitmap's words, bounded by MOST_BITS whatever the tables are.
    """
    (name,) = hashes.columns
    size, n = LEAST_BITS, hashes.count()
    while size < min(16 * n, MOST_BITS):
        size *= 2

    def word(hash_: Column) -> Column:
        return F.shiftright(hash_.bitwiseAND(size - 1), 6)

    def bit(hash_: Column) -> Column:
        one = F.lit(1).cast("bigint")
        return F.call_function("shiftleft", one, hash_.bitwiseAND(63).cast("int"))

    words = hashes.groupBy(word(F.col(name)).alias("__word")).agg(F.bit_or(bit(F.col(name))).alias("__bits"))
    tested = df.withColumn("__key", key).withColumn("__word", word(F.col("__key")))
    tested = tested.join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit(F.col("__key"))) != 0, F.lit(False))
    return tested.withColumn(into, hit).drop("__word", "__bits", "__key")

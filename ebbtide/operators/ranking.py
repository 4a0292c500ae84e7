"""Exact running counts and quantiles over a whole table, without a single-task window.

Rows are first counted per distinct value (copies collapse map-side), so a value
shared by a third of the table is one row from then on. The distinct values are
cut at approximate quantiles into ranges of similar size. A running sum inside
each range plus the totals of the ranges before it gives the exact global count,
whatever the cuts are; they only decide how even the tasks are.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.shared import stored

# A range holds about this many distinct values; there are never more than MAX_RANGES.
RANGE_ROWS = 500_000
MAX_RANGES = 2048
# Small tables need no even cuts; any cut will do.
ANY_CUT = [0.0]


def _cuts(tied: DataFrame, value: str, ranges: int | None) -> list[float]:
    """Approximate quantiles of the distinct values that cut them into ranges.

    At most MAX_RANGES - 1 numbers come to the driver.
    """
    if ranges is None:
        ranges = min(MAX_RANGES, -(-tied.count() // RANGE_ROWS))
    if ranges < 2:
        return ANY_CUT
    shares = [i / ranges for i in range(1, ranges)]
    found = tied.agg(F.percentile_approx(value, shares, 10 * ranges)).first()[0]
    return sorted({cut for cut in found or [] if math.isfinite(cut)}) or ANY_CUT


def running_counts(
    df: DataFrame,
    value: str,
    counts: dict[str, Column],
    groups: list[str] | None = None,
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per (group, distinct value) with each count and its running sum.

    ``counts`` maps a name to what is summed per row. For each name the result
    has ``name`` (sum at this value), ``name_before`` (sum over all values that
    sort earlier) and ``name_total`` (sum over the group). Null values are left out.
    """
    groups = list(groups or [])
    # Read three times below, and one row per distinct value: computed once and kept.
    tied = stored(
        df.groupBy(*groups, value).agg(*[F.sum(amount).alias(name) for name, amount in counts.items()])
    ).filter(F.col(value).isNotNull())
    splits = [-math.inf, *_cuts(tied, value, ranges), math.inf]
    # NaN sorts last in Spark and is kept in a range of its own after the last one.
    ranged = Bucketizer(
        splits=splits, inputCol=value, outputCol="_range", handleInvalid="keep"
    ).transform(tied)

    def sort_key(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    # At most MAX_RANGES rows per group, so these windows are small whatever the table is.
    whole_group = Window.partitionBy(*groups)
    earlier_ranges = whole_group.orderBy(sort_key("_range")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        ranged.groupBy(*groups, "_range")
        .agg(*[F.sum(name).alias(name) for name in counts])
        .select(
            *groups,
            "_range",
            *[
                F.coalesce(F.sum(name).over(earlier_ranges), F.lit(0)).alias(f"_{name}_ranges")
                for name in counts
            ],
            *[F.sum(name).over(whole_group).alias(f"{name}_total") for name in counts],
        )
    )
    earlier_values = (
        Window.partitionBy(*groups, "_range")
        .orderBy(sort_key(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = ranged.select(
        *groups,
        "_range",
        value,
        *counts,
        *[(F.sum(name).over(earlier_values) - F.col(name)).alias(f"_{name}_inside") for name in counts],
    )
    return inside.join(totals, [*groups, "_range"]).select(
        *groups,
        value,
        *counts,
        *[(F.col(f"_{n}_ranges") + F.col(f"_{n}_inside")).alias(f"{n}_before") for n in counts],
        *[f"{name}_total" for name in counts],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: list[float], groups: list[str] | None = None
) -> DataFrame:
    """One row per group with ``n`` and ``quantiles``, the interpolated exact quantiles.

    Quantile p lies at position p * (n - 1) of the sorted values, interpolated
    linearly between its two neighbours.
    """
    groups = list(groups or [])
    ranked = running_counts(df, value, {"n": F.lit(1)}, groups)

    def at(position: Column) -> Column:
        first, last = F.col("n_before"), F.col("n_before") + F.col("n")
        return F.max(F.when((position >= first) & (position < last), F.col(value).cast("double")))

    parts = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        parts += [
            at(F.floor(place)).alias(f"_low_{i}"),
            at(F.ceil(place)).alias(f"_high_{i}"),
        ]
    found = ranked.groupBy(*groups).agg(F.max("n_total").alias("n"), *parts)

    def interpolated(i: int, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        return low + (high - low) * (place - F.floor(place))

    return found.select(
        *groups,
        "n",
        F.array(*[interpolated(i, p) for i, p in enumerate(probabilities)]).alias("quantiles"),
    )

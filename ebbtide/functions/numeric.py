"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, places: int = 2) -> Column:
    """Round half to even on the scaled double (``rint(x * 10^n) / 10^n``)."""
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def known(value: Column) -> Column:
    """NaN read as null; Spark orders NaN above every number, so it would pass as a large one."""
    return F.nanvl(value.cast("double"), F.lit(None))


def safe_divide(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """``numerator / denominator``; ``default`` where the denominator is 0 or null."""
    fallback = F.lit(default).cast("double")
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator != 0, quotient).otherwise(fallback)


def half_even_sql(value: str, places: int) -> str:
    """SQL text of ``half_even``."""
    scale = f"{float(10**places)!r}D"
    return f"(rint(({value}) * {scale}) / {scale})"


def clamp_sql(value: str, low: float, high: float) -> str:
    """SQL text of ``clamp``."""
    return f"CASE WHEN {value} IS NOT NULL THEN greatest({low!r}D, least({high!r}D, {value})) END"


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to the inclusive range; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def bin_label(
    value: Column, edges: list[float], labels: list[str], outside: str | None = "nan"
) -> Column:
    """Label of the right-closed bin ``(a, b]`` that holds ``value``.

    Values in no bin, nulls included, get ``outside``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("bins need one more edge than labels")
    # Each row takes the first upper edge that holds it, so lower edges need no test.
    chain = F.when(value <= edges[0], outside)
    for high, label in zip(edges[1:], labels):
        # NaN compares greater than infinity in Spark: no bin holds it.
        chain = chain.when(value <= high, label)
    return chain.otherwise(F.lit(outside))


def uniform_sql(key: str, field: str) -> str:
    """SQL text of a uniform in [0, 1) that depends on key and field only.

    ``key`` is SQL text too. The value does not depend on partitioning or row order.
    """
    digest = f"md5(concat(cast({key} as string), ':{field}'))"
    return f"(cast(conv(substr({digest}, 1, 8), 16, 10) as bigint) / 4294967296.0D)"


def uniform(key: str, field: str) -> Column:
    return F.expr(uniform_sql(key, field))


def equal_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based index among ``bins`` equal bins of [low, high]; the top edge is in the last bin."""
    width = (high - low) / F.lit(float(bins))
    index = F.when(width > 0, F.floor((value - low) / width)).otherwise(F.lit(0).cast("bigint"))
    return F.least(index, F.lit(bins - 1).cast("bigint")).cast("int")

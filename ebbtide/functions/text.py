"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point that counts as white space; `trim` alone removes only U+0020.
WHITESPACE = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())

# Fixed value: what counts as a number in a text column.
NUMBER_PATTERN = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"


def strip(value: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def to_number(value: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The pattern keeps out Java spellings such as ``1.0d`` that a cast accepts.
    """
    return F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double"))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def answered_sql(df: DataFrame, name: str, word: str, number: int | None = None) -> str:
    """SQL text: whether ``name`` holds ``word`` (text column) or ``number`` (numeric column).

    Never null: an absent column, a null or any other value is false.
    """
    if name not in df.columns:
        return "false"
    if is_text(df, name):
        return f"(`{name}` <=> '{word}')"
    return "false" if number is None else f"(`{name}` <=> {number})"


def answered(df: DataFrame, name: str, word: str, number: int | None = None) -> Column:
    return F.expr(answered_sql(df, name, word, number))


def yes(df: DataFrame, name: str) -> Column:
    return answered(df, name, "Yes", 1)


def no(df: DataFrame, name: str) -> Column:
    return answered(df, name, "No", 0)


def holds(condition: Column) -> Column:
    """The condition with null read as False."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(condition, 1).otherwise(0)

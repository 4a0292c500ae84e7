"""Cleaning, typing, validation and profiling of subscriber rows.

Everything but ``drop_copies`` is a narrow projection or one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import schema as S
from ebbtide.functions.numeric import known
from ebbtide.functions.text import flag, holds, is_text, strip, to_number


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_text(df: DataFrame) -> DataFrame:
    """Strip Unicode white space from every text column."""
    return df.withColumns({name: strip(F.col(name)) for name in text_columns(df)})


def parse_total_charges(df: DataFrame) -> DataFrame:
    """TotalCharges as double; what is not a number becomes null."""
    if "TotalCharges" not in df.columns:
        return df
    raw = F.col("TotalCharges")
    value = to_number(raw) if is_text(df, "TotalCharges") else F.nanvl(raw.cast("double"), F.lit(None))
    return df.withColumn("TotalCharges", value)


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN in MonthlyCharges becomes null, as in TotalCharges."""
    kinds = dict(df.dtypes)
    if kinds.get("MonthlyCharges") not in ("double", "float"):
        return df
    return df.withColumn("MonthlyCharges", known(F.col("MonthlyCharges")))


def impute_total_charges(df: DataFrame) -> DataFrame:
    """Fill missing TotalCharges with tenure x MonthlyCharges, unrounded."""
    if "TotalCharges" not in df.columns:
        return df
    estimate = F.col("tenure") * F.col("MonthlyCharges")
    return df.withColumn("TotalCharges", F.coalesce("TotalCharges", estimate))


def drop_copies(df: DataFrame) -> DataFrame:
    """Drop exact copies over all columns.

    The map-side aggregate leaves at most one copy per task, so a row that is
    copied many times does not pile up behind one shuffle key.
    """
    return df.dropDuplicates()


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col(S.TARGET).isNotNull()) if S.TARGET in df.columns else df


def clean_data(df: DataFrame, dedupe: bool = True, drop_null_target: bool = True) -> DataFrame:
    """Strip, parse and impute; drop copies and unlabelled rows unless told not to.

    Scoring sets both flags to False: it must keep every row.
    """
    df = df.transform(strip_text).transform(blank_nan).transform(parse_total_charges).transform(impute_total_charges)
    # Filtering first is equal (copies share their label) and shuffles fewer rows.
    if drop_null_target:
        df = drop_unlabelled(df)
    return drop_copies(df) if dedupe else df


def _yes_no(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    if not is_text(df, name):
        return value
    return F.when(value == "Yes", 1).when(value == "No", 0).otherwise(value.try_cast("int"))


def convert_types(df: DataFrame) -> DataFrame:
    """gender to 0/1 (male is 1) and the Yes/No columns to 1/0.

    Columns that already are numeric stay as they are. Other text becomes null
    here; ``reject_reasons`` names such rows.
    """
    columns: dict[str, Column] = {}
    if "gender" in df.columns and is_text(df, "gender"):
        columns["gender"] = flag(F.lower("gender") == "male")
    for name in S.YES_NO_COLUMNS:
        if name in df.columns:
            columns[name] = _yes_no(df, name)
    return df.withColumns(columns) if columns else df


def with_label(df: DataFrame) -> DataFrame:
    """The target as an int column ``label`` in place of ``Churn``."""
    return df.withColumn(S.LABEL, _yes_no(df, S.TARGET).cast("int")).drop(S.TARGET)


def validate_columns(df: DataFrame, required: list[str], context: str = "") -> None:
    """Raise ``ValueError`` with the sorted names of missing columns; reads no data."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{context or 'table'} lacks the columns {', '.join(missing)}")


def _rules(df: DataFrame) -> dict[str, tuple[str, Column]]:
    """Input rules as name -> (message, condition of a violation)."""
    rules = {}
    if "tenure" in df.columns:
        rules["negative_tenure"] = ("a negative tenure", F.col("tenure") < 0)
    if "MonthlyCharges" in df.columns:
        rules["non_positive_charge"] = (
            "a monthly charge of zero or less",
            F.col("MonthlyCharges") <= 0,
        )
    return rules


def validation_summary(df: DataFrame) -> DataFrame:
    """(rule, violations) with one row per rule, from one aggregate; nulls pass."""
    missing = [name for name in S.SCORING_REQUIRED if name not in df.columns]
    counts = [F.lit(len(missing)).cast("bigint").alias("missing_columns")]
    for name, (_, violated) in _rules(df).items():
        counts.append(F.coalesce(F.sum(flag(violated)), F.lit(0)).cast("bigint").alias(name))
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *counts).drop("_rows")
    return totals.unpivot([], totals.columns, "rule", "violations")


def validate_input(df: DataFrame) -> tuple[bool, list[str]]:
    """(is_valid, messages): required columns, no negative tenure, positive charges."""
    errors = [
        f"no column {name}, which scoring needs"
        for name in S.SCORING_REQUIRED
        if name not in df.columns
    ]
    rules = _rules(df)
    if rules:
        counted = {row["rule"]: row["violations"] for row in validation_summary(df).collect()}
        errors += [message for name, (message, _) in rules.items() if counted[name] > 0]
    return not errors, errors


def reject_reasons(df: DataFrame) -> DataFrame:
    """Add ``reasons``: array of the rules that a row breaks, empty for good rows."""
    checks = {name: violated for name, (_, violated) in _rules(df).items()}
    for name in S.SCORING_REQUIRED:
        if name in df.columns and name != "TotalCharges":
            checks[f"missing_{name}"] = F.col(name).isNull()
    for name in S.YES_NO_COLUMNS:
        if name in df.columns and is_text(df, name):
            known = strip(F.col(name)).isin("Yes", "No", "1", "0")
            checks[f"unknown_{name}"] = F.col(name).isNotNull() & ~known
    reasons = [F.when(holds(broken), F.lit(name)) for name, broken in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected rows keep their ``reasons``."""
    checked = reject_reasons(df)
    broken = F.size("reasons") > 0
    return checked.filter(~broken).drop("reasons"), checked.filter(broken)


def describe_dataframe(df: DataFrame) -> DataFrame:
    """(column_name, data_type, row_count, null_count) per column, from one aggregate."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(f"`{name}`").isNull()).alias("null_count"),
        )
        for name, kind in types.items()
    ]
    return df.agg(F.array(*nulls).alias("_columns")).select(F.inline("_columns"))


def null_profile(df: DataFrame) -> DataFrame:
    """The columns that contain nulls, with their null counts."""
    return describe_dataframe(df).filter("null_count > 0").select("column_name", "null_count")


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """Number of columns per data type; reads no data."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return counts

"""Train/test split, folds and class weights.

All draws are hashes of the row id, so they do not depend on partitioning and
a lost task recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import safe_divide, uniform
from ebbtide.functions.text import holds


def hash_split(
    df: DataFrame, test_size: float = 0.2, seed: int = S.SEED, key: str = S.ID
) -> DataFrame:
    """Add ``is_test``; each row is in the test split with probability ``test_size``.

    No shuffle and no pass over the data; strata hold in expectation.
    """
    return df.withColumn("is_test", uniform(key, f"split{seed}") < test_size)


def stratified_split(
    df: DataFrame,
    test_size: float = 0.2,
    seed: int = S.SEED,
    key: str = S.ID,
    label: str = S.LABEL,
    slots: int = 65536,
) -> DataFrame:
    """Add ``is_test`` with an exact count per label: the rows with the smallest draws.

    A histogram of the draws finds, per label, the slot in which the last test
    row lies; only the rows of that slot (1 / slots of the label) are then ranked.
    What comes to the driver is one row per label. ``key`` must be unique.
    """
    draw = uniform(key, f"split{seed}")
    slot = F.floor(draw * slots)
    # At most `slots` rows per label.
    upto = Window.partitionBy(label).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(label)
    borders = (
        df.groupBy(F.col(label), slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("through", F.sum("n").over(upto))
        .withColumn("wanted", F.round(F.sum("n").over(everything) * test_size).cast("bigint"))
        .filter((F.col("through") >= F.col("wanted")) & (F.col("through") - F.col("n") < F.col("wanted")))
        .select(label, "slot", (F.col("wanted") - F.col("through") + F.col("n")).alias("missing"))
        .collect()
    )
    at_border = df.select(label, key, draw.alias("_draw"), slot.alias("_slot")).filter(
        _any([(F.col(label) == b[label]) & (F.col("_slot") == b["slot"]) for b in borders])
    )
    missing = _choose({b[label]: b["missing"] for b in borders}, label, "bigint")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw", key))
    last = {
        row[label]: row["last"]
        for row in at_border.withColumn("_rank", rank)
        .filter(F.col("_rank") == missing)
        .select(label, F.struct("_draw", F.col(key).alias("_key")).alias("last"))
        .collect()
    }
    inside = [
        (F.col(label) == value)
        & ((draw < row["_draw"]) | ((draw == row["_draw"]) & (F.col(key) <= row["_key"])))
        for value, row in last.items()
    ]
    return df.withColumn("is_test", holds(_any(inside)))


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def _choose(values: dict, name: str, kind: str) -> Column:
    chosen = F.lit(None).cast(kind)
    for key, value in values.items():
        chosen = F.when(F.col(name) == key, F.lit(value).cast(kind)).otherwise(chosen)
    return chosen


def split_data(
    df: DataFrame, test_size: float = 0.2, seed: int = S.SEED, key: str = S.ID, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(train, test), stratified by label."""
    chosen = (stratified_split if exact else hash_split)(df, test_size, seed, key)
    return (
        chosen.filter(~F.col("is_test")).drop("is_test"),
        chosen.filter("is_test").drop("is_test"),
    )


def split_counts(df: DataFrame) -> DataFrame:
    """(is_test, n, churn_rate) of a split table."""
    return df.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.LABEL).alias("churn_rate")
    )


def assign_folds(
    df: DataFrame,
    folds: int = 5,
    seed: int = S.SEED,
    key: str = S.ID,
    label: str = S.LABEL,
    slots: int = 65536,
) -> DataFrame:
    """Add ``fold`` in 0..folds-1, stratified: per label the folds differ by one row at most.

    The rows of a label are dealt to the folds in the order of their draws. A row's rank is its
    rank within a slot of the draws plus the rows of the slots before; a slot holds 1 / slots of
    a label, so no task ranks a whole label. The broadcast table has one row per label and slot.
    """
    draw = uniform(key, f"fold{seed}")
    drawn = df.withColumn("_draw", draw).withColumn("_slot", F.floor(draw * slots).cast("int"))
    before = Window.partitionBy("_label").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        drawn.groupBy(F.col(label).alias("_label"), F.col("_slot").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_label", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_draw", key)) - 1
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slot") == F.col("_at"))
    dealt = drawn.withColumn("_rank", rank).join(F.broadcast(starts), same)
    return dealt.withColumn("fold", ((F.col("_start") + F.col("_rank")) % folds).cast("int")).select(*df.columns, "fold")


def class_weights(df: DataFrame) -> DataFrame:
    """(label, n, weight): weight n / (classes * n of the class)."""
    counts = df.groupBy(S.LABEL).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: a window over it is tiny.
    sizes = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return (
        counts.withColumn("_all", sizes)
        .withColumn("weight", safe_divide(F.col("_all.rows"), F.col("_all.classes") * F.col("n")))
        .drop("_all")
    )


def add_class_weights(df: DataFrame, positive_weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """Add the weight columns that the model grids choose from.

    ``weight_none``, ``weight_balanced`` and ``weight_pos_<w>``; a single 1-row
    aggregate feeds the balanced weights.
    """
    sizes = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(S.LABEL) == 1).alias("churned")
        )
    ).scalar()
    rows, churned = F.col("_sizes.rows"), F.col("_sizes.churned")
    of_class = F.when(F.col(S.LABEL) == 1, churned).otherwise(rows - churned)
    columns = {
        "weight_none": F.lit(1.0),
        "weight_balanced": safe_divide(rows, 2 * of_class),
    }
    for weight in positive_weights:
        columns[f"weight_pos_{weight}"] = F.when(F.col(S.LABEL) == 1, float(weight)).otherwise(1.0)
    return df.withColumn("_sizes", sizes).withColumns(columns).drop("_sizes")

"""Synthetic customers, generated where the rows are: no driver loop, no shared state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import half_even, uniform, uniform_sql
from ebbtide.operators.score import rule_score, sigmoid
from ebbtide.shared import shuffle_partitions
from ebbtide.sources.subscribers import CONTRACT_CUTS, draw_attributes, pick_sql, subscriber_id

# Ranges of the parts of the monthly charge.
BASE_CHARGE = (18.0, 30.0)
PHONE_CHARGE = (8.0, 12.0)
INTERNET_CHARGE = {"Fiber optic": (35.0, 50.0), "DSL": (18.0, 30.0)}
ADD_ON_CHARGE = {
    "OnlineSecurity": (3.0, 7.0),
    "OnlineBackup": (3.0, 7.0),
    "DeviceProtection": (3.0, 7.0),
    "TechSupport": (3.0, 7.0),
    "StreamingTV": (5.0, 8.0),
    "StreamingMovies": (5.0, 8.0),
}
MAX_TENURE = 72
BLANK_TOTALS = 11
DEFAULT_ROWS = 7043


def _between(key: str, field: str, limits: tuple[float, float]) -> Column:
    low, high = limits
    return F.lit(low) + F.lit(high - low) * uniform(key, field)


def _normal(key: str, field: str) -> Column:
    """A standard normal from two uniforms (Box and Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(key, f"{field}1")))
    return radius * F.cos(2.0 * math.pi * uniform(key, f"{field}2"))


def _blank_limit(keys: DataFrame, key: str, blanks: int) -> Column:
    """The ``blanks``-th smallest draw; a top-k, one number comes out."""
    draws = keys.select(uniform(key, "blank").alias("draw")).orderBy("draw").limit(blanks)
    return draws.agg(F.max("draw")).scalar()


def generate_from_keys(
    keys: DataFrame, key: str = "id", blanks: int = BLANK_TOTALS, seed: int = S.SEED
) -> DataFrame:
    """One synthetic customer per key, with the 21 raw columns.

    Every draw is a hash of seed, key and field, so the same key always gives the
    same customer. ``blanks`` customers have a blank TotalCharges. Keys must be unique.
    """
    # Keys alone are few bytes, so a large table of them is few tasks, but a customer is some fifty hashes.
    keys = keys.select(key).repartition(shuffle_partitions(keys.sparkSession), key)
    keys = keys.select(F.col(key).alias("_key"), F.concat_ws(":", F.lit(seed), F.col(key)).alias("_draw"))
    draw = "_draw"
    df = draw_attributes(keys, draw).withColumns(
        {
            "customerID": subscriber_id("_key"),
            "tenure": F.floor(uniform(draw, "tenure") * (MAX_TENURE + 1)).cast("int"),
            "Contract": F.expr(pick_sql(uniform_sql(draw, "contract"), CONTRACT_CUTS)),
        }
    )
    charge = _between(draw, "base", BASE_CHARGE)
    charge += F.when(F.col("PhoneService") == "Yes", _between(draw, "phone_add", PHONE_CHARGE)).otherwise(0.0)
    internet = F.lit(0.0)
    for name, limits in INTERNET_CHARGE.items():
        added = _between(draw, "internet_add", limits)
        internet = F.when(F.col("InternetService") == name, added).otherwise(internet)
    charge += internet
    for name, limits in ADD_ON_CHARGE.items():
        charge += F.when(F.col(name) == "Yes", _between(draw, f"{name}_add", limits)).otherwise(0.0)
    df = df.withColumn("MonthlyCharges", half_even(charge))

    total = (
        F.col("MonthlyCharges")
        * F.greatest(F.col("tenure"), F.lit(1))
        * _between(draw, "total", (0.95, 1.05))
    )
    df = df.withColumn("_blank_limit", _blank_limit(keys, draw, blanks)).withColumn(
        "TotalCharges",
        F.when(uniform(draw, "blank") <= F.col("_blank_limit"), " ").otherwise(
            half_even(total).cast("string")
        ),
    )
    score = rule_score(df) + S.RULE_WEIGHTS["noise"] * _normal(draw, "noise")
    churned = uniform(draw, "churn") < sigmoid(score)
    return df.withColumn("Churn", F.when(churned, "Yes").otherwise("No")).select(*S.RAW_COLUMNS)


def generate_customers(spark: SparkSession, n_rows: int = DEFAULT_ROWS, seed: int = S.SEED) -> DataFrame:
    """``n_rows`` synthetic customers with the ids 1..n_rows."""
    return generate_from_keys(spark.range(1, n_rows + 1), "id", seed=seed)

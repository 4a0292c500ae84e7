"""The subscriber table as a view over the driver's customer and orders tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import half_even, uniform, uniform_sql
from ebbtide.operators.score import rule_score, sigmoid
from ebbtide.shared import shuffle_partitions

# Share of each answer in the generated attributes.
SENIOR_SHARE = 0.16
YES_SHARES = {
    "Partner": ("partner", 0.48),
    "Dependents": ("dependents", 0.30),
    "PhoneService": ("phone", 0.90),
    "PaperlessBilling": ("paperless", 0.59),
}
ADD_ON_SHARES = {
    "OnlineSecurity": ("security", 0.30),
    "OnlineBackup": ("backup", 0.34),
    "DeviceProtection": ("device", 0.34),
    "TechSupport": ("techsupport", 0.30),
    "StreamingTV": ("tv", 0.38),
    "StreamingMovies": ("movies", 0.39),
}
MULTIPLE_LINES_SHARE = 0.42
GENDER_CUTS = [("Male", 0.5), ("Female", None)]
INTERNET_CUTS = [("DSL", 0.34), ("Fiber optic", 0.78), ("No", None)]
PAYMENT_CUTS = [
    ("Electronic check", 0.34),
    ("Mailed check", 0.57),
    ("Bank transfer (automatic)", 0.79),
    ("Credit card (automatic)", None),
]
CONTRACT_CUTS = [("Month-to-month", 0.55), ("One year", 0.76), ("Two year", None)]


def pick_sql(draw: str, cuts: list[tuple[str, float | None]]) -> str:
    """SQL text: the first answer whose cumulative share exceeds the draw."""
    cases = " ".join(f"WHEN {draw} < {cut}D THEN '{answer}'" for answer, cut in cuts[:-1])
    return f"CASE {cases} ELSE '{cuts[-1][0]}' END"


def yes_sql(key: str, field: str, share: float) -> str:
    return pick_sql(uniform_sql(key, field), [("Yes", share), ("No", None)])


def subscriber_id(key: str) -> Column:
    """CUST- and the key with at least six digits; longer keys are kept whole."""
    digits = f"cast({key} as string)"
    return F.expr(f"concat('CUST-', lpad({digits}, greatest(6, length({digits})), '0'))")


def draw_attributes(df: DataFrame, key: str) -> DataFrame:
    """Demographics and services, each drawn from its own uniform of the key (SQL text)."""
    df = df.selectExpr(
        "*",
        f"{pick_sql(uniform_sql(key, 'gender'), GENDER_CUTS)} AS gender",
        f"int({uniform_sql(key, 'senior')} >= {1 - SENIOR_SHARE}D) AS SeniorCitizen",
        *[f"{yes_sql(key, *drawn)} AS {name}" for name, drawn in YES_SHARES.items()],
        f"{pick_sql(uniform_sql(key, 'internet'), INTERNET_CUTS)} AS InternetService",
        f"{pick_sql(uniform_sql(key, 'pay'), PAYMENT_CUTS)} AS PaymentMethod",
    )
    return df.selectExpr(
        "*",
        f"CASE WHEN PhoneService = 'No' THEN 'No phone service' "
        f"ELSE {yes_sql(key, 'lines', MULTIPLE_LINES_SHARE)} END AS MultipleLines",
        *[
            f"CASE WHEN InternetService = 'No' THEN 'No internet service' "
            f"ELSE {yes_sql(key, *drawn)} END AS {name}"
            for name, drawn in ADD_ON_SHARES.items()
        ],
    )


def as_of(key: str) -> Column:
    """Observation date of a subscriber, staggered over 67 months."""
    return F.expr(f"add_months(date'1995-07-01', int({key} * 37 % 67))")


def first_orders(orders: DataFrame) -> DataFrame:
    """(c_custkey, first_order): first order before the observation date.

    The date depends on the key alone, so rows are filtered before the shuffle
    and the map-side aggregate leaves one row per customer and task.
    """
    return (
        orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("_day"))
        .filter(F.col("_day") < as_of("o_custkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("_day").alias("first_order"))
    )


def subscribers_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: c_custkey and the 21 raw columns."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = "c_custkey"

    # A customer is few bytes to read, so a large table is few tasks, but some thirty hashes to draw.
    base = (
        customer.select("c_custkey", "c_acctbal", "c_mktsegment")
        .repartition(shuffle_partitions(spark), key)
        .join(first_orders(orders), "c_custkey", "left")
    )
    seen = as_of(key)
    months = (F.year(seen) - F.year("first_order")) * 12 + F.month(seen) - F.month("first_order")
    df = draw_attributes(base, key).withColumns(
        {
            "customerID": subscriber_id(key),
            "tenure": F.coalesce(months, F.lit(0)),
            "Contract": F.when(F.col("c_mktsegment") == "FURNITURE", "One year")
            .when(F.col("c_mktsegment") == "MACHINERY", "Two year")
            .otherwise("Month-to-month"),
            "MonthlyCharges": half_even(18.0 + 102.0 * (F.col("c_acctbal") + 1000.0) / 11000.0),
        }
    )
    total = (
        F.col("MonthlyCharges")
        * F.greatest(F.col("tenure"), F.lit(1))
        * (0.95 + 0.1 * uniform(key, "total"))
    )
    df = df.withColumn(
        "TotalCharges",
        F.when(F.col("first_order").isNull(), " ").otherwise(half_even(total).cast("string")),
    )
    churned = uniform(key, "churn") < sigmoid(rule_score(df))
    df = df.withColumn("Churn", F.when(churned, "Yes").otherwise("No"))
    return df.select("c_custkey", *S.RAW_COLUMNS)


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw subscriber table: one row per customer, 21 columns."""
    return subscribers_with_key(spark, sf_dir).select(*S.RAW_COLUMNS)

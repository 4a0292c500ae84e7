"""Business features. Each function adds columns in one narrow projection."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import bin_label, half_even
from ebbtide.functions.text import answered, flag, no, yes

# Fixed value: the label of a value that no bin holds.
OUTSIDE = "nan"

SUPPORT_SERVICES = ["TechSupport", "OnlineSecurity", "DeviceProtection"]
STREAMING_SERVICES = ["StreamingTV", "StreamingMovies"]


def add_tenure_group(df: DataFrame, outside: str = OUTSIDE) -> DataFrame:
    return df.withColumn("TenureGroup", bin_label(F.col("tenure"), *S.TENURE_BINS, outside))


def add_spend_category(df: DataFrame, outside: str = OUTSIDE) -> DataFrame:
    label = bin_label(F.col("MonthlyCharges"), *S.SPEND_BINS, outside)
    return df.withColumn("SpendCategory", label)


def add_monthly_charge_bucket(df: DataFrame, outside: str = OUTSIDE) -> DataFrame:
    label = bin_label(F.col("MonthlyCharges"), *S.CHARGE_BINS, outside)
    return df.withColumn("MonthlyChargeBucket", label)


def add_avg_monthly_spend(df: DataFrame) -> DataFrame:
    """Total per month of tenure; the monthly charge for customers in month 0."""
    spend = F.when(F.col("tenure") > 0, F.col("TotalCharges") / F.col("tenure"))
    return df.withColumn("AvgMonthlySpend", half_even(spend.otherwise(F.col("MonthlyCharges"))))


def add_high_value_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("HighValueCustomer", flag(F.col("MonthlyCharges") >= S.HIGH_VALUE_CHARGE))


def add_contract_length(df: DataFrame) -> DataFrame:
    """Months of the contract; an unknown contract counts as one month."""
    months = F.lit(1)
    for name, length in S.CONTRACT_MONTHS.items():
        months = F.when(F.col("Contract") == name, length).otherwise(months)
    return df.withColumn("ContractLength", months)


def add_customer_lifetime_estimate(df: DataFrame) -> DataFrame:
    length = F.col("ContractLength")
    factor = F.when(length > 1, S.MULTI_MONTH_FACTOR).otherwise(1.0)
    estimate = half_even(F.col("AvgMonthlySpend") * length * factor)
    return df.withColumn("CustomerLifetimeEstimate", estimate)


def _count(conditions: list[Column]) -> Column:
    return reduce(add, [flag(condition) for condition in conditions])


def _count_yes(df: DataFrame, names: list[str]) -> Column:
    return _count([yes(df, name) for name in names])


def add_support_usage_score(df: DataFrame) -> DataFrame:
    return df.withColumn("SupportUsageScore", _count_yes(df, SUPPORT_SERVICES))


def add_streaming_usage_score(df: DataFrame) -> DataFrame:
    return df.withColumn("StreamingUsageScore", _count_yes(df, STREAMING_SERVICES))


def add_internet_service_category(df: DataFrame) -> DataFrame:
    """Tier of the internet service; the text "None" when there is none."""
    tier = F.lit("None")
    for name, label in S.INTERNET_TIERS.items():
        tier = F.when(F.col("InternetService") == name, label).otherwise(tier)
    return df.withColumn("InternetServiceCategory", tier)


def add_family_customer_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("FamilyCustomer", flag(yes(df, "Partner") & yes(df, "Dependents")))


def add_retention_risk_bucket(df: DataFrame) -> DataFrame:
    """Count of six risk signs (0-6) and its bucket."""
    signs = [
        answered(df, "Contract", "Month-to-month"),
        no(df, "TechSupport"),
        no(df, "OnlineSecurity"),
        F.col("tenure") < S.NEW_TENURE,
        F.col("MonthlyCharges") > S.HIGH_CHARGE,
        yes(df, "PaperlessBilling"),
    ]
    df = df.withColumn("RetentionRiskScore", _count(signs))
    bucket = bin_label(F.col("RetentionRiskScore"), *S.RETENTION_BINS, OUTSIDE)
    return df.withColumn("RetentionRiskBucket", bucket)


def add_interaction_features(df: DataFrame) -> DataFrame:
    """Pairs of signs; needs SupportUsageScore."""
    charge, tenure = F.col("MonthlyCharges"), F.col("tenure")
    return df.withColumns(
        {
            "HighCharge_MTM": flag(
                (charge > S.HIGH_CHARGE) & answered(df, "Contract", "Month-to-month")
            ),
            "NewNoSupport": flag((tenure < S.NEW_TENURE) & (F.col("SupportUsageScore") == 0)),
            "FiberNoSecurity": flag(
                answered(df, "InternetService", "Fiber optic") & no(df, "OnlineSecurity")
            ),
            "ChargeXTenure": half_even(charge * tenure),
        }
    )


def engineer_features(df: DataFrame) -> DataFrame:
    """All features, in the order in which they build on one another."""
    return (
        df.transform(add_tenure_group)
        .transform(add_spend_category)
        .transform(add_monthly_charge_bucket)
        .transform(add_avg_monthly_spend)
        .transform(add_high_value_flag)
        .transform(add_contract_length)
        .transform(add_customer_lifetime_estimate)
        .transform(add_support_usage_score)
        .transform(add_streaming_usage_score)
        .transform(add_internet_service_category)
        .transform(add_family_customer_flag)
        .transform(add_retention_risk_bucket)
        .transform(add_interaction_features)
    )

"""Columns, types, roles and fixed business values of the subscriber table."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "customerID"
TARGET = "Churn"
LABEL = "label"
PROBABILITY = "churn_probability"
SEED = 42

RAW_SCHEMA = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("SeniorCitizen", T.IntegerType()),
        T.StructField("Partner", T.StringType()),
        T.StructField("Dependents", T.StringType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("PhoneService", T.StringType()),
        T.StructField("MultipleLines", T.StringType()),
        T.StructField("InternetService", T.StringType()),
        T.StructField("OnlineSecurity", T.StringType()),
        T.StructField("OnlineBackup", T.StringType()),
        T.StructField("DeviceProtection", T.StringType()),
        T.StructField("TechSupport", T.StringType()),
        T.StructField("StreamingTV", T.StringType()),
        T.StructField("StreamingMovies", T.StringType()),
        T.StructField("Contract", T.StringType()),
        T.StructField("PaperlessBilling", T.StringType()),
        T.StructField("PaymentMethod", T.StringType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.StringType()),
        T.StructField("Churn", T.StringType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()

# Column roles.
YES_NO_COLUMNS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"]
CATEGORICAL_COLUMNS = [
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaymentMethod",
    "TenureGroup",
    "SpendCategory",
    "MonthlyChargeBucket",
    "InternetServiceCategory",
    "RetentionRiskBucket",
]
NUMERIC_COLUMNS = [
    "tenure",
    "MonthlyCharges",
    "TotalCharges",
    "AvgMonthlySpend",
    "CustomerLifetimeEstimate",
    "SupportUsageScore",
    "StreamingUsageScore",
]
SCORING_REQUIRED = ["tenure", "MonthlyCharges", "TotalCharges", "Contract", "InternetService"]

# Text that a CSV reader of the original data treats as missing.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Right-closed bins (edges, labels). The last edge is open-ended.
INF = float("inf")
TENURE_BINS = ([0, 12, 24, 48, 60, INF], ["New", "Growing", "Established", "Loyal", "Champion"])
SPEND_BINS = ([0, 35, 65, 85, INF], ["Budget", "Standard", "Premium", "Enterprise"])
CHARGE_BINS = ([0, 25, 55, 80, 100, INF], ["Q1", "Q2", "Q3", "Q4", "Q5"])
RETENTION_BINS = ([-1, 1, 2, 3, 4, 6], ["Minimal", "Low", "Moderate", "High", "Critical"])
TENURE_BANDS = (
    [0, 12, 24, 48, 60, 73],
    ["0-12 mo", "13-24 mo", "25-48 mo", "49-60 mo", "60+ mo"],
)

# Business thresholds.
HIGH_VALUE_CHARGE = 70.0
HIGH_CHARGE = 80.0
NEW_TENURE = 12
LOYAL_TENURE = 24
MULTI_MONTH_FACTOR = 1.5
CONTRACT_MONTHS = {"Month-to-month": 1, "One year": 12, "Two year": 24}
INTERNET_TIERS = {"Fiber optic": "High-Speed", "DSL": "Standard"}
DEFAULT_THRESHOLD = 0.5
OFFER_DISCOUNT = 0.15
SAVED_SHARE = 0.8

# Risk tiers as (label, exclusive upper bound, colour).
RISK_TIERS = [
    ("Low Risk", 0.25, "#00C48C"),
    ("Medium Risk", 0.50, "#FFB300"),
    ("High Risk", 0.75, "#FF6B35"),
    ("Very High Risk", 1.01, "#E53E3E"),
]
UNKNOWN_TIER_COLOUR = "#718096"

# Weights of the additive churn score.
RULE_WEIGHTS = {
    "month_to_month": 0.35,
    "one_year": 0.08,
    "tenure_scale": 72.0,
    "tenure_cap": 0.30,
    "fiber": 0.15,
    "no_security": 0.08,
    "no_tech_support": 0.07,
    "charge_start": 70.0,
    "charge_scale": 100.0,
    "charge_cap": 0.12,
    "senior": 0.05,
    "partner": 0.05,
    "dependents": 0.04,
    "steepness": 4.0,
    "noise": 0.08,
}

# Hyper-parameter grids of the three model families.
FOREST_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [None, 10, 20, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
    "class_weight": ["balanced", None],
}
BOOSTED_A_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.85, 1.0],
    "colsample_bytree": [0.7, 0.85, 1.0],
    "scale_pos_weight": [1, 2, 3],
}
BOOSTED_B_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [-1, 10, 20],
    "learning_rate": [0.01, 0.05, 0.1],
    "num_leaves": [31, 63, 127],
    "subsample": [0.7, 0.85, 1.0],
    "class_weight": ["balanced", None],
}

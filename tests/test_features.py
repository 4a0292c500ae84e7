import pytest
from conftest import rows
from pyspark.sql import functions as F

from ebbtide.operators import features as E

BASE = """tenure int, MonthlyCharges double, TotalCharges double, Partner string, Dependents string,
Contract string, InternetService string, OnlineSecurity string, DeviceProtection string,
TechSupport string, StreamingTV string, StreamingMovies string, PaperlessBilling string"""
NONE = "No internet service"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(
        [
            (2, 30.0, 61.0, "Yes", "No", "Month-to-month", "DSL", "No", "No", "No", "No", "Yes", "Yes"),
            (24, 62.5, 1480.0, "Yes", "Yes", "One year", "Fiber optic", "Yes", "No", "Yes", "No", "No", "No"),
            (40, 84.0, 3400.0, "No", "Yes", "Month-to-month", "Fiber optic", "No", "No", "No", "Yes", "Yes", "Yes"),
            (70, 19.5, 1365.0, "No", "No", "Two year", "No", NONE, NONE, NONE, NONE, NONE, "No"),
        ],
        BASE,
    )


@pytest.fixture(scope="module")
def done(base):
    """tenure -> row with all features."""
    return {row["tenure"]: row.asDict() for row in E.engineer_features(base).collect()}


def column(done, name):
    return [done[t][name] for t in (2, 24, 40, 70)]


def test_every_feature_of_the_base_rows(done):
    expected = {
        "TenureGroup": ["New", "Growing", "Established", "Champion"],
        "SpendCategory": ["Budget", "Standard", "Premium", "Budget"],
        "MonthlyChargeBucket": ["Q2", "Q3", "Q4", "Q1"],
        "AvgMonthlySpend": [30.5, 61.67, 85.0, 19.5],
        "HighValueCustomer": [0, 0, 1, 0],
        "ContractLength": [1, 12, 1, 24],
        "CustomerLifetimeEstimate": [30.5, 1110.06, 85.0, 702.0],
        "SupportUsageScore": [0, 2, 0, 0],
        "StreamingUsageScore": [1, 0, 2, 0],
        "InternetServiceCategory": ["Standard", "High-Speed", "High-Speed", "None"],
        "FamilyCustomer": [0, 1, 0, 0],
        "RetentionRiskScore": [5, 0, 5, 0],
        "RetentionRiskBucket": ["Critical", "Minimal", "Critical", "Minimal"],
        "HighCharge_MTM": [0, 0, 1, 0],
        "NewNoSupport": [1, 0, 0, 0],
        "FiberNoSecurity": [0, 0, 1, 0],
        "ChargeXTenure": [60.0, 1500.0, 3360.0, 1365.0],
    }
    assert {name: column(done, name) for name in expected} == expected


def test_no_nulls_and_more_columns(base, done):
    assert all(value is not None for row in done.values() for value in row.values())
    assert len(done[2]) == len(base.columns) + 17


def test_month_zero_falls_back_to_the_charge(spark):
    df = spark.createDataFrame([(0, 0.0, 55.0)], "tenure int, TotalCharges double, MonthlyCharges double")
    assert E.add_avg_monthly_spend(df).first()["AvgMonthlySpend"] == 55.0


def labels(spark, step, source, target, values, kind="double"):
    df = spark.createDataFrame([(v,) for v in values], f"{source} {kind}")
    return [row[target] for row in step(df).collect()]


def test_tenure_edges(spark):
    found = labels(
        spark,
        E.add_tenure_group,
        "tenure",
        "TenureGroup",
        [0.0, 0.5, 12.0, 12.01, 24.0, 48.0, 60.0, 60.5, 1000.0, -1.0, None],
    )
    assert found == [
        "nan", "New", "New", "Growing", "Growing", "Established", "Loyal", "Champion", "Champion", "nan", "nan",
    ]


def test_charge_edges(spark):
    values = [0.0, 35.0, 35.01, 65.0, 85.0, 85.01, None, float("nan")]
    found = labels(spark, E.add_spend_category, "MonthlyCharges", "SpendCategory", values)
    assert found == ["nan", "Budget", "Standard", "Standard", "Premium", "Enterprise", "nan", "nan"]
    found = labels(spark, E.add_monthly_charge_bucket, "MonthlyCharges", "MonthlyChargeBucket", [25.0, 55.0, 80.0, 100.0, 100.5])
    assert found == ["Q1", "Q2", "Q3", "Q4", "Q5"]
    assert labels(spark, E.add_high_value_flag, "MonthlyCharges", "HighValueCustomer", [70.0, 69.99, None]) == [1, 0, 0]


def test_unknown_contract_and_internet(spark):
    df = spark.createDataFrame([("Weekly", "Satellite"), (None, None)], "Contract string, InternetService string")
    done = df.transform(E.add_contract_length).transform(E.add_internet_service_category)
    assert rows(done, "ContractLength", "InternetServiceCategory") == [(1, "None"), (1, "None")]


def test_typed_columns_score_like_text(spark, base):
    typed = base.withColumns(
        {n: (F.col(n) == "Yes").cast("int") for n in ("Partner", "Dependents", "PaperlessBilling")}
    )
    names = ["tenure", "FamilyCustomer", "RetentionRiskScore", "RetentionRiskBucket"]
    assert rows(E.engineer_features(typed), *names) == rows(E.engineer_features(base), *names)


def test_absent_service_columns_count_zero(base):
    partial = base.drop("TechSupport", "DeviceProtection", "StreamingTV")
    done = partial.transform(E.add_support_usage_score).transform(E.add_streaming_usage_score)
    assert rows(done, "tenure", "SupportUsageScore", "StreamingUsageScore") == [
        (2, 0, 1), (24, 1, 0), (40, 0, 1), (70, 0, 0),
    ]


def test_risk_buckets_over_the_whole_range(spark):
    columns = "Contract string, TechSupport string, OnlineSecurity string, tenure int, MonthlyCharges double, PaperlessBilling int"
    worst = ("Month-to-month", "No", "No", 1, 90.0, 1)
    best = ("Two year", "Yes", NONE, 30, 50.0, 0)
    cases = [worst[:k] + best[k:] for k in range(7)]
    done = E.add_retention_risk_bucket(spark.createDataFrame(cases, columns))
    assert rows(done, "RetentionRiskScore", "RetentionRiskBucket") == [
        (0, "Minimal"), (1, "Minimal"), (2, "Low"), (3, "Moderate"), (4, "High"), (5, "Critical"), (6, "Critical"),
    ]


def test_generated_code_of_the_features_is_short_enough_to_be_compiled(spark, tmp_path):
    """The JVM never compiles methods above 8,000 bytes, and a large projection becomes one method."""
    import re

    from ebbtide.plans.preprocessing import prepare_scoring
    from ebbtide.sources.generator import generate_customers

    path = str(tmp_path / "raw")
    generate_customers(spark, 10).write.parquet(path)
    plan = prepare_scoring(spark.read.parquet(path))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) <= 8000

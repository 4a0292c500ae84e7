import pytest
from conftest import RAW_ROWS, rows
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import clamp, half_even, safe_divide
from ebbtide.operators import clean


def by_id(df, name):
    return dict(df.select(S.ID, name).collect())


def test_blank_total_is_filled_with_tenure_times_charge(raw):
    total = by_id(clean.clean_data(raw), "TotalCharges")
    assert total == {"C001": 351.0, "C002": 17 * 41.6, "C003": 1120.5}
    assert dict(clean.clean_data(raw).dtypes)["TotalCharges"] == "double"


def test_copies_are_dropped_only_for_training(spark, raw):
    doubled = raw.union(raw.limit(1))
    assert clean.clean_data(doubled).count() == 3
    assert clean.clean_data(doubled, dedupe=False, drop_null_target=False).count() == 4


def test_rows_without_label_are_dropped_only_for_training(raw):
    unlabelled = raw.withColumn("Churn", F.when(F.col(S.ID) != "C001", F.col("Churn")))
    assert clean.clean_data(unlabelled).count() == 2
    assert clean.clean_data(unlabelled, drop_null_target=False).count() == 3


def test_all_unicode_white_space_is_stripped(spark):
    df = spark.createDataFrame(
        [("  a b  ",), ("\t\n a b\r",), ("  a b　",), ("\x1ca b\x85",), (None,)], "v string"
    )
    assert {r[0] for r in clean.strip_text(df).collect()} == {"a b", None}


def test_numbers_in_text(spark):
    cases = {
        " 12.5 ": 12.5,
        "1e2": 100.0,
        "-3": -3.0,
        ".5": 0.5,
        "7.": 7.0,
        "abc": None,
        "NaN": None,
        "1.0d": None,
        "1,200": None,
        "": None,
        "inf": float("inf"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "TotalCharges string").withColumn(
        "key", F.col("TotalCharges")
    )
    parsed = df.withColumn("TotalCharges", F.trim("TotalCharges")).transform(clean.parse_total_charges)
    assert {r["key"]: r["TotalCharges"] for r in parsed.collect()} == cases


def test_numeric_total_with_nan_is_imputed(spark):
    df = spark.createDataFrame(
        [(2, 10.0, float("nan")), (2, 10.0, 5.0)], "tenure int, MonthlyCharges double, TotalCharges double"
    )
    done = df.transform(clean.parse_total_charges).transform(clean.impute_total_charges)
    assert rows(done, "TotalCharges") == [(5.0,), (20.0,)]


def test_conversion_to_zero_and_one(raw):
    once = clean.convert_types(clean.clean_data(raw))
    for name in [*S.YES_NO_COLUMNS, "gender"]:
        assert {r[0] for r in once.select(name).collect()} <= {0, 1}
    assert by_id(once, "gender") == {"C001": 1, "C002": 0, "C003": 1}
    # 0/1 input stays as it is.
    assert rows(clean.convert_types(once)) == rows(once)


def test_gender_null_and_unknown_answers(spark):
    df = spark.createDataFrame([(None, "maybe"), ("MALE", "1")], "gender string, Partner string")
    assert [tuple(r) for r in clean.convert_types(df).collect()] == [(0, None), (1, 1)]


def test_required_columns(raw):
    clean.validate_columns(raw, ["tenure"], "test")
    with pytest.raises(ValueError, match="test lacks the columns a, b"):
        clean.validate_columns(raw, ["b", "tenure", "a"], "test")


def test_input_validation(examples):
    assert clean.validate_input(examples) == (True, [])
    ok, errors = clean.validate_input(examples.drop("tenure"))
    assert not ok and any("tenure" in e for e in errors)
    assert not clean.validate_input(examples.withColumn("tenure", F.lit(-5)))[0]
    assert not clean.validate_input(examples.withColumn("MonthlyCharges", F.lit(0.0)))[0]
    assert clean.validate_input(examples.withColumn("tenure", F.lit(None).cast("int")))[0]


def test_validation_of_an_empty_table(examples):
    assert clean.validate_input(examples.limit(0)) == (True, [])


def test_rejects_carry_their_reasons(raw):
    bad = raw.withColumn("tenure", F.when(F.col(S.ID) == "C001", -1).otherwise(F.col("tenure"))).withColumn(
        "Partner", F.when(F.col(S.ID) == "C001", "maybe").otherwise(F.col("Partner"))
    )
    accepted, rejected = clean.split_rejects(bad)
    assert rows(accepted, S.ID) == [("C002",), ("C003",)]
    assert [(r[S.ID], r["reasons"]) for r in rejected.collect()] == [
        ("C001", ["negative_tenure", "unknown_Partner"])
    ]


def test_profile(spark, raw):
    assert clean.null_profile(raw).count() == 0
    holed = raw.withColumn("Contract", F.lit(None).cast("string"))
    assert rows(clean.null_profile(holed)) == [("Contract", 3)]
    described = clean.describe_dataframe(raw)
    assert described.count() == 21 and described.filter("row_count = 3").count() == 21
    assert clean.dtype_counts(raw) == {"string": 18, "int": 2, "double": 1}


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_safe_divide(spark):
    assert value(spark, safe_divide(F.lit(10), F.lit(2))) == 5.0
    assert value(spark, safe_divide(F.lit(10), F.lit(0))) == 0.0
    assert value(spark, safe_divide(F.lit(10), F.lit(0), -1.0)) == -1.0


def test_clamp(spark):
    limits = [(0.5, 0.5), (-0.1, 0.0), (1.5, 1.0), (0.0, 0.0), (1.0, 1.0)]
    for given, expected in limits:
        assert value(spark, clamp(F.lit(given), 0.0, 1.0)) == expected
    assert value(spark, clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_half_even(spark):
    for given, places, expected in [(1.015, 2, 1.01), (0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0)]:
        assert value(spark, half_even(F.lit(given), places)) == expected


def test_raw_rows_match_schema():
    assert all(len(row) == len(S.RAW_COLUMNS) for row in RAW_ROWS)

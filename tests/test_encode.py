import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.catalog.queries import prepared
from ebbtide.operators import encode
from ebbtide.plans.preprocessing import prepare_training, preprocess_input, run_preprocessing


@pytest.fixture(scope="module")
def table(spark, sf):
    return prepared(spark, sf).persist()


@pytest.fixture(scope="module")
def encoding(table):
    return encode.fit_encoding(table)


def test_small_table_has_no_nulls_and_the_expected_shape(raw):
    encoded, encoding = run_preprocessing(raw)
    done = encoded.collect()
    assert len(done) == 3
    assert encoded.columns == [S.ID, S.LABEL, *encoding.feature_columns]
    assert all(value is not None for row in done for value in row)


def test_columns_come_in_order(encoding):
    assert encoding.passthrough[:6] == [
        "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "PaperlessBilling",
    ]
    assert len(encoding.passthrough) == 14
    assert encoding.feature_columns[14:21] == S.NUMERIC_COLUMNS
    assert all(levels == sorted(levels) for levels in encoding.levels.values())
    assert encoding.feature_columns[21:24] == [
        "MultipleLines_No", "MultipleLines_No phone service", "MultipleLines_Yes",
    ]


def test_refit_free_encoding_has_the_same_columns(table, encoding):
    again, same = encode.encode_and_scale(table, encoding)
    assert same is encoding and again.columns == encoding.feature_columns


def test_scaled_columns_have_mean_zero_and_sigma_one(table, encoding):
    encoded = encode.apply_encoding(table, encoding)
    for name in S.NUMERIC_COLUMNS:
        mean, sigma = encoded.agg(F.avg(name), F.stddev_pop(name)).first()
        assert abs(mean) < 1e-9 and abs(sigma - 1) < 1e-9


def test_known_levels_sum_to_one_and_unseen_to_zero(table, encoding):
    names = [f"`Contract_{level}`" for level in encoding.levels["Contract"]]
    total = sum((F.col(name) for name in names), F.lit(0.0))
    seen = encode.apply_encoding(table, encoding).select(total.alias("t"))
    assert {r["t"] for r in seen.collect()} == {1.0}
    unseen = table.withColumn("Contract", F.lit("Weekly"))
    assert {r["t"] for r in encode.apply_encoding(unseen, encoding).select(total.alias("t")).collect()} == {0.0}


def test_constant_column_is_divided_by_one(spark):
    df = spark.createDataFrame([(5, 1.0), (5, 3.0)], "tenure int, MonthlyCharges double")
    encoding = encode.fit_encoding(df)
    later = spark.createDataFrame([(8, 2.0)], df.schema)
    assert tuple(encode.apply_encoding(later, encoding).first()) == (3.0, 0.0)


def test_null_category_is_the_level_unknown(spark):
    df = spark.createDataFrame([("DSL",), (None,)], "InternetService string")
    encoding = encode.fit_encoding(df)
    assert encoding.feature_columns == ["InternetService_DSL", "InternetService_Unknown"]
    assert sorted(tuple(r) for r in encode.apply_encoding(df, encoding).collect()) == [(0.0, 1.0), (1.0, 0.0)]


def test_any_number_of_levels(spark):
    df = spark.range(1500).select(F.col("id").cast("string").alias("Contract"))
    assert len(encode.fit_encoding(df).feature_columns) == 1500


def test_absent_pass_through_column_is_zero(spark):
    df = spark.createDataFrame([(1, "DSL")], "gender int, InternetService string")
    encoding = encode.fit_encoding(df)
    assert tuple(encode.apply_encoding(df.drop("gender"), encoding).first()) == (0.0, 1.0)


def test_alignment(spark):
    df = spark.createDataFrame([("x", 1, 2)], "customerID string, a int, b int")
    aligned = encode.align_columns(df, ["b", "c"], ["customerID"])
    assert aligned.columns == ["customerID", "b", "c"] and tuple(aligned.first()) == ("x", 2.0, 0.0)


def test_encoding_survives_json(encoding):
    assert encode.Encoding.from_json(encoding.to_json()) == encoding


def test_ml_stages_agree_with_named_columns(table, encoding):
    model = PipelineModel(encode.ml_stages(encoding))
    mixed = table.withColumn("Contract", F.when(F.col("tenure") < 10, "Weekly").otherwise(F.col("Contract")))
    vectors = model.transform(mixed).select(S.ID, vector_to_array("features").alias("v"))
    named = encode.apply_encoding(mixed, encoding, [S.ID])
    expected = {row[0]: list(row[1:]) for row in named.collect()}
    for row in vectors.collect():
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(row["v"], expected[row[S.ID]], strict=True))


def test_scoring_keeps_every_row(spark, raw, encoding):
    doubled = raw.drop(S.TARGET).union(raw.drop(S.TARGET))
    aligned = preprocess_input(doubled, encoding)
    assert aligned.count() == 6 and aligned.columns == [S.ID, *encoding.feature_columns]


def test_training_preparation_labels_rows(raw):
    assert dict(prepare_training(raw).select(S.ID, S.LABEL).collect()) == {"C001": 1, "C002": 0, "C003": 0}

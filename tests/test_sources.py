import pytest
from conftest import rows
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.operators import evaluate
from ebbtide.operators.score import predict_batch, rule_scorer
from ebbtide.sources import customers, reports
from ebbtide.sources.generator import generate_customers, generate_from_keys
from ebbtide.sources.subscribers import subscribers


def test_csv_round_trip_and_fallback(spark, raw, tmp_path):
    path = str(tmp_path / "raw")
    customers.write_csv(raw, path)
    loaded = customers.load_raw_data(spark, str(tmp_path / "absent"), path)
    assert loaded.schema.simpleString() == raw.schema.simpleString()
    # The blank total survives.
    assert rows(loaded) == rows(raw)
    with pytest.raises(FileNotFoundError, match="absent"):
        customers.load_raw_data(spark, str(tmp_path / "absent"), str(tmp_path / "also-absent"))


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "upload.csv"
    path.write_text(
        "tenure,MonthlyCharges,customerID,Extra,TotalCharges\n"
        '12.0,50.5,"a ""quoted"" id",x, \nbad,NA,C2,null,7\n'
    )
    found = customers.read_csv(spark, str(path))
    assert dict(found.dtypes) == {
        "tenure": "int", "MonthlyCharges": "double", "customerID": "string", "Extra": "string", "TotalCharges": "string",
    }
    assert [tuple(r) for r in found.collect()] == [
        (12, 50.5, 'a "quoted" id', "x", " "), (None, None, "C2", None, "7"),
    ]


def test_null_tokens(spark):
    df = spark.createDataFrame([(t,) for t in [*S.NULL_TOKENS, " ", "no", "none"]], "v string")
    kept = [r[0] for r in customers.null_tokens(df).collect() if r[0] is not None]
    assert kept == [" ", "no", "none"]


def test_processed_prefers_parquet(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 0.0)], "customerID string, `Contract_One year` double, `b (x)` double")
    folder = str(tmp_path / "processed")
    customers.save_processed(df, folder)
    assert rows(customers.load_processed(spark, folder)) == rows(df)
    (tmp_path / "only").mkdir()
    customers.write_csv(df, str(tmp_path / "only" / "processed.csv"))
    again = customers.load_processed(spark, str(tmp_path / "only"))
    assert rows(again) == rows(df) and again.columns == df.columns


def test_batch_export_leaves_out_colour_and_advice(spark, examples, tmp_path):
    batch = predict_batch(examples, rule_scorer)
    customers.export_batch(batch, str(tmp_path / "batch"))
    found = customers.read_csv(spark, str(tmp_path / "batch"))
    assert found.count() == 3 and not {"RiskColor", "Recommendation"} & set(found.columns)


def test_reports(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4)], f"{S.LABEL} int, {S.PROBABILITY} double")
    metrics = evaluate.compute_metrics(scored).withColumn("model", F.lit("m"))
    reports.save_metrics(metrics, str(tmp_path / "metrics"))
    loaded = reports.load_model_metrics(spark, str(tmp_path / "metrics"))
    assert rows(reports.test_kpis(loaded), "metric", "value") == [
        ("accuracy", 0.6667), ("f1_score", 0.6667), ("precision", 1.0), ("recall", 0.5), ("roc_auc", 1.0),
    ]
    reports.save_report(evaluate.classification_report(scored), str(tmp_path / "report"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0].startswith("===") and any("weighted avg" in line for line in lines)
    importance = spark.createDataFrame([("a b", 0.7), ("c", 0.3)], "feature string, importance double")
    reports.save_importance(importance, str(tmp_path / "importance"))
    assert rows(reports.load_feature_importance(spark, str(tmp_path / "importance"))) == rows(importance)


def test_generated_customers(spark):
    table = generate_customers(spark, 2000).persist()
    assert table.columns == S.RAW_COLUMNS and table.count() == 2000
    assert table.select(S.ID).distinct().count() == 2000
    assert table.filter("TotalCharges = ' '").count() == 11
    assert table.filter("PhoneService = 'No' AND MultipleLines <> 'No phone service'").count() == 0
    assert table.filter("InternetService = 'No' AND TechSupport <> 'No internet service'").count() == 0
    assert table.filter("InternetService <> 'No' AND StreamingTV = 'No internet service'").count() == 0
    low, high = table.agg(F.min("MonthlyCharges"), F.max("MonthlyCharges")).first()
    assert low >= 18 and high <= 30 + 12 + 50 + 4 * 7 + 2 * 8
    assert abs(table.filter("Contract = 'Month-to-month'").count() / 2000 - 0.55) < 0.05
    rate = {r[0]: r[1] for r in table.groupBy("Contract").agg(F.avg((F.col("Churn") == "Yes").cast("int"))).collect()}
    assert rate["Month-to-month"] > rate["Two year"]


def test_generated_rows_depend_on_the_key_only(spark):
    keys = spark.range(1, 101)
    assert rows(generate_from_keys(keys)) == rows(generate_from_keys(keys.repartition(7)))
    assert rows(generate_from_keys(keys, seed=1)) != rows(generate_from_keys(keys))


def test_subscriber_view(spark, sf):
    table = subscribers(spark, sf)
    assert table.columns == S.RAW_COLUMNS and table.count() == 150
    blank = table.filter("TotalCharges = ' '")
    assert blank.count() == table.filter("tenure = 0").count()


def test_few_files_of_keys_are_dealt_to_many_tasks(spark, sf):
    """The hashes of a customer are drawn in as many tasks as there are shuffle partitions, however few files the keys come in."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = spark.range(1, 2001, numPartitions=1)
    assert generate_from_keys(keys).rdd.getNumPartitions() == parts
    assert subscribers(spark, sf).rdd.getNumPartitions() == parts

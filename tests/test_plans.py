"""What the physical plans may and may not contain."""

import pytest
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.catalog.queries import rule_scored
from ebbtide.operators import clean, evaluate, insights, score
from ebbtide.operators.features import engineer_features
from ebbtide.operators.score import rule_scorer
from ebbtide.plans import training
from ebbtide.plans.preprocessing import prepare_scoring
from ebbtide.sources.subscribers import subscribers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "subscribers")
    subscribers(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_row_by_row_work_does_not_shuffle(table):
    for df in (
        prepare_scoring(table),
        engineer_features(clean.convert_types(clean.clean_data(table, False, False))),
        score.predict_batch(table, rule_scorer, validate=False),
        score.whatif_sweep(table, rule_scorer),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_aggregates_read_only_their_columns(table):
    text = plan(insights.churn_by_contract(table))
    assert "ReadSchema: struct<Contract:string,Churn:string>" in text
    text = plan(insights.churn_by_contract(table.filter(F.col("Contract") == "One year")))
    assert "EqualTo(Contract,One year)" in text


def test_one_pass_aggregates_send_one_row_per_task(table):
    for df in (
        clean.validation_summary(table),
        clean.describe_dataframe(table),
        insights.segment_lift(table),
        insights.correlation(insights.correlation_inputs(table)),
    ):
        text = plan(df)
        assert text.count("Exchange") == 1 and "Exchange SinglePartition" in text


def test_history_keeps_its_top_rows_before_the_shuffle(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id")
    text = plan(score.last_predictions(events, "user_id", ["ts", "event_id"]))
    assert text.count("Partial") >= 2 and "WindowGroupLimit" in text


def test_order_rows_are_filtered_and_merged_before_their_shuffle(spark, sf):
    text = plan(subscribers(spark, sf))
    assert "partial_min" in text


def test_areas_have_no_window_over_all_rows(spark, sf):
    """Windows without a partition see the totals of the ranges only."""
    text = plan(evaluate.score_counts(rule_scored(spark, sf)))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert any("_range" in line.split("], [")[1] for line in windows)


def test_copies_collapse_before_their_shuffle(spark, table):
    """A row that makes up most of the table leaves one copy per task."""
    many = table.limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("i")
    copied = many.union(table)
    lean = clean.drop_copies(copied)
    text = plan(lean)
    assert text.count("HashAggregate") == 2 and text.count("hashpartitioning") == 1
    assert lean.count() == table.count()


def test_passes_over_few_rows_take_few_tasks(spark):
    """With 400 shuffle partitions each of the hundreds of jobs of a fit had 400 tasks."""
    rows = spark.range(300).selectExpr(f"string(id) AS {S.ID}").repartition(400)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        found = training.for_passes(rows)
        assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism < 400 and found.count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fits_of_many_rows_do_not_run_side_by_side():
    """Every fit keeps its rows: twelve at a time of millions of rows would be read from disk at every pass."""
    assert training.side_by_side(12_000, 3) == (3, 4)
    assert training.side_by_side(700_000, 3) == (2, 1)
    assert training.side_by_side(4_000_000, 3) == (1, 1)
    assert training.side_by_side(0, 1) == (1, 4)

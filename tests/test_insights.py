import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ebbtide.operators import insights
from ebbtide.operators.clean import convert_types
from ebbtide.operators.score import predict_batch, rule_scorer
from ebbtide.sources.subscribers import subscribers


@pytest.fixture(scope="module")
def table(spark, sf):
    return subscribers(spark, sf).persist()


def test_kpis(table):
    kpi = insights.dataset_kpis(table).first()
    assert (kpi["customers"], kpi["n_columns"], kpi["missing_cells"]) == (150, 21, 0)
    numeric = insights.dataset_kpis(convert_types(table)).first()
    assert numeric["churn_rate"] == pytest.approx(kpi["churn_rate"])
    assert insights.dataset_kpis(table.drop("Churn")).first()["churn_rate"] is None


def test_text_and_numeric_labels_give_the_same_charts(table):
    typed = convert_types(table)
    for chart in (
        insights.churn_share, insights.tenure_histogram, insights.contract_churn, insights.churn_by_contract,
        insights.churn_by_tenure, insights.segment_lift, insights.target_segments,
    ):
        assert rows(chart(table)) == rows(chart(typed))


def test_shares_add_up(table):
    shares = insights.internet_share(table).collect()
    assert sum(r["n"] for r in shares) == 150
    assert sum(r["pct"] for r in shares) == pytest.approx(100, abs=0.001)


def test_charts_without_a_label(table):
    plain = table.drop("Churn")
    assert insights.contract_churn(plain).columns == ["Contract", "n"]
    assert {r["label_name"] for r in insights.tenure_histogram(plain).collect()} == {"All"}
    assert insights.monthly_charges_box(plain).first()["n"] == 150


def test_box_is_exact_and_the_sketch_is_close(table):
    exact = {r["label_name"]: r for r in insights.monthly_charges_box(table).collect()}
    for name, answer in (("Churn", "Yes"), ("No Churn", "No")):
        values = [r[0] for r in table.filter(F.col("Churn") == answer).select("MonthlyCharges").collect()]
        row = exact[name]
        assert [row["q1"], row["median"], row["q3"]] == pytest.approx(np.percentile(values, [25, 50, 75]), abs=1e-6)
        assert (row["minimum"], row["maximum"]) == (min(values), max(values))
    rough = {r["label_name"]: r["median"] for r in insights.monthly_charges_box(table, approximate=True).collect()}
    assert all(abs(rough[name] - exact[name]["median"]) < 5 for name in rough)


def test_histogram_of_equal_tenures(spark):
    df = spark.createDataFrame([(5, "Yes"), (5, "No")], "tenure int, Churn string")
    assert rows(insights.tenure_histogram(df)) == [("Churn", 0, 1), ("No Churn", 0, 1)]


def test_risk_distribution_shows_empty_tiers(examples):
    batch = predict_batch(examples, rule_scorer)
    found = insights.risk_distribution(batch).collect()
    assert [r["RiskLabel"] for r in found] == ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
    assert sum(r["n"] for r in found) == 3
    empty = insights.risk_distribution(batch.limit(0)).collect()
    assert [r["n"] for r in empty] == [0, 0, 0, 0]
    assert insights.preview_batch(batch).columns[0] == "customerID"


def test_correlation_is_pairwise_complete(spark):
    data = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 9.0, 5.0)]
    found = {(r["x"], r["y"]): r["corr"] for r in insights.correlation(spark.createDataFrame(data, "a double, b double, c double")).collect()}
    assert found["a", "a"] == 1.0
    assert found["a", "b"] == found["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1], abs=1e-6)
    assert found["a", "c"] is None


def test_correlation_keeps_the_widest_columns(spark):
    wide = spark.range(50).select(*[(F.rand(i) * i).alias(f"c{i}") for i in range(1, 21)])
    found = insights.correlation(wide, insights.most_varied(wide, 4))
    assert {r["x"] for r in found.collect()} == {"c17", "c18", "c19", "c20"} and found.count() == 16


def test_bands_leave_out_month_zero(spark):
    df = spark.createDataFrame([(0, "Yes"), (12, "Yes"), (13, "No"), (73, "No"), (74, "No")], "tenure int, Churn string")
    assert rows(insights.churn_by_tenure(df)) == [("0-12 mo", 100.0), ("13-24 mo", 0.0), ("60+ mo", 0.0)]

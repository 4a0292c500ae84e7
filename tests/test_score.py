import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions import risk
from ebbtide.operators import score
from ebbtide.operators.score import rule_scorer


def with_p(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "p double")


def test_tiers_at_their_borders(spark):
    cases = {
        0.0: "Low Risk", 0.1: "Low Risk", 0.25: "Medium Risk", 0.35: "Medium Risk", 0.5: "High Risk",
        0.65: "High Risk", 0.75: "Very High Risk", 0.9: "Very High Risk", 1.0: "Very High Risk",
    }
    df = with_p(spark, *cases).select("p", risk.risk_label(F.col("p")))
    assert dict(df.collect()) == cases
    odd = with_p(spark, float("nan"), None).select(risk.risk_label(F.col("p")).alias("l"))
    assert [r["l"] for r in odd.collect()] == ["Very High Risk"] * 2


def test_colours(spark):
    df = spark.createDataFrame([("Low Risk",), ("Unknown Risk",), (None,)], "l string")
    found = [r[0] for r in df.select(risk.risk_color(F.col("l"))).collect()]
    assert found == ["#00C48C", S.UNKNOWN_TIER_COLOUR, S.UNKNOWN_TIER_COLOUR]


def advice(spark, p, **row):
    df = spark.createDataFrame([(p, *row.values())], ["p", *row])
    return df.select(
        risk.recommendation(df, F.col("p")).alias("text"), risk.action_codes(df, F.col("p")).alias("codes")
    ).first()


def test_advice_by_tier(spark):
    assert "loyalty" in advice(spark, 0.1)["text"].lower()
    assert "critical" in advice(spark, 0.9)["text"].lower()
    assert advice(spark, 0.3)["codes"] == ["WATCH"]


def test_tips(spark):
    assert "contract" in advice(spark, 0.6, Contract="Month-to-month")["text"].lower()
    assert "support" in advice(spark, 0.55, TechSupport="No")["text"].lower()
    found = advice(spark, 0.6, Contract="Month-to-month", TechSupport="No", OnlineSecurity="No")
    assert found["codes"] == ["CONTACT", "UPGRADE_CONTRACT", "ADD_TECH_SUPPORT", "ADD_SECURITY"]
    assert len(found["text"].split("  \n")) == 4
    assert advice(spark, 0.6, Contract="One year", TechSupport="Yes")["codes"] == ["CONTACT"]
    assert advice(spark, 0.6, TechSupport=0)["codes"] == ["CONTACT", "ADD_TECH_SUPPORT"]


def test_rule_of_the_examples(examples):
    found = {r[S.ID]: r[S.PROBABILITY] for r in rule_scorer(examples).collect()}
    high = 0.35 - 5 / 72 + 0.15 + 0.08 + 0.07 + 0.12
    assert math.isclose(found["EX-001"], 1 / (1 + math.exp(-4 * high)), rel_tol=1e-9)
    assert found["EX-001"] > 0.9 and found["EX-002"] < 0.25


def test_batch_keeps_rows_and_columns(examples):
    doubled = examples.union(examples)
    batch = score.predict_batch(doubled, rule_scorer)
    assert batch.count() == 6
    assert batch.columns == [
        *examples.columns, "ChurnProbability", "ChurnPrediction", "ChurnPrediction_Label",
        "RiskLabel", "RiskColor", "Recommendation",
    ]
    first = batch.filter("customerID = 'EX-001'").first()
    assert (first["ChurnPrediction"], first["ChurnPrediction_Label"], first["RiskLabel"]) == (
        1, "Churn", "Very High Risk",
    )
    assert score.batch_churn_rate(batch).first()["rows"] == 6


def test_threshold_is_inclusive_and_a_parameter(spark, examples):
    def at(p):
        return lambda df: df.withColumn(S.PROBABILITY, F.lit(p))

    assert {r["prediction"] for r in score.predict(examples, at(0.5)).collect()} == {1}
    assert {r["prediction"] for r in score.predict(examples, at(0.5), threshold=0.51).collect()} == {0}


def test_invalid_input_is_refused(examples):
    with pytest.raises(ValueError, match="negative"):
        score.predict_batch(examples.withColumn("tenure", F.lit(-1)), rule_scorer)
    with pytest.raises(ValueError, match="Contract"):
        score.predict_probability(examples.drop("Contract"), rule_scorer)


def test_single_card(examples):
    card = score.predict_single(examples, rule_scorer).filter("customerID = 'EX-001'").first()
    assert card["avg_tenure_remaining_months"] == 19
    assert card["retention_impact_usd"] == 1767.0
    assert card["estimated_savings_usd"] == 1413.6
    assert card["churn_binary"] == 1 and card["probability_pct"] == pytest.approx(card["probability"] * 100, abs=0.01)


def test_business_impact(spark):
    df = spark.createDataFrame(
        [(0.5, 100.0, 4), (0.5, 100.0, 30), (0.5, 0.0, 4)],
        "churn_probability double, MonthlyCharges double, tenure int",
    )
    names = ["revenue_at_risk", "retention_cost", "estimated_savings", "roi_pct", "avg_remaining_tenure_months"]
    assert [tuple(r) for r in score.with_business_impact(df).select(*names).collect()] == [
        (1000.0, 180.0, 820.0, 455.6, 20),
        (0.0, 180.0, -180.0, -100.0, 0),
        (0.0, 0.0, 0.0, 0.0, 20),
    ]


def test_whatif(examples):
    points = score.charge_points()
    assert len(points) == 20 and points[0] == 18.0 and points[-1] == 120.0
    swept = score.whatif_sweep(examples, rule_scorer)
    assert swept.count() == 60
    curve = score.whatif_curve(examples, rule_scorer).orderBy("point").collect()
    means = [r["mean_probability_pct"] for r in curve]
    assert means == sorted(means) and means[0] < means[-1]


def test_a_point_that_cannot_be_scored_counts_zero(examples):
    swept = score.whatif_sweep(examples, lambda df: df.withColumn(S.PROBABILITY, F.lit(None).cast("double")))
    assert {r[S.PROBABILITY] for r in swept.collect()} == {0.0}


def test_history_of_a_busy_session(spark):
    """One session holds most of the log; the last rows of every session are exact."""
    log = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "busy").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("session"),
        ((F.col("id") * 7919) % 1009).alias("ts"),
        "id",
    )
    found = {}
    for r in score.last_predictions(log, "session", ["ts", "id"]).collect():
        found.setdefault(r["session"], []).append((r["position"], r["ts"], r["id"]))
    everything = {}
    for r in log.collect():
        everything.setdefault(r["session"], []).append((r["ts"], r["id"]))
    assert found.keys() == everything.keys()
    for session, entries in everything.items():
        expected = sorted(entries, reverse=True)[:50]
        assert [(ts, i) for _, ts, i in sorted(found[session])] == expected


def test_rule_ties_are_exact(spark, sf):
    """Equal sums tie although they are added up from different terms."""
    from ebbtide.sources.subscribers import subscribers

    scored = rule_scorer(subscribers(spark, sf))
    exact, rounded = scored.agg(
        F.count_distinct(S.PROBABILITY), F.count_distinct(F.round(S.PROBABILITY, 10))
    ).first()
    assert exact == rounded


def test_ids_keep_all_digits(spark):
    from ebbtide.sources.subscribers import subscriber_id

    df = spark.createDataFrame([(7,), (123456,), (1234567,)], "k bigint").select(subscriber_id("k").alias("i"))
    assert rows(df) == [("CUST-000007",), ("CUST-123456",), ("CUST-1234567",)]

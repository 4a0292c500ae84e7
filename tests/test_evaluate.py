import random

import pytest
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.operators import evaluate
from ebbtide.operators.ranking import exact_quantiles, running_counts


def pairs_auc(rows):
    pos = [p for label, p in rows if label == 1]
    neg = [p for label, p in rows if label == 0]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return won / len(pos) / len(neg)


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, f"{S.LABEL} int, {S.PROBABILITY} double")


@pytest.fixture(scope="module")
def rows():
    """600 rows, a third of them at one probability, with ties elsewhere."""
    rng = random.Random(7)
    found = [(int(rng.random() < 0.4), 0.5) for _ in range(200)]
    for _ in range(400):
        p = round(rng.random(), 2)
        found.append((int(rng.random() < p), p))
    return found


@pytest.fixture(scope="module")
def scored(spark, rows):
    return scored_frame(spark, rows).persist()


def test_area_equals_all_pairs(scored, rows):
    assert evaluate.roc_auc(scored).first()[0] == pytest.approx(pairs_auc(rows), abs=1e-12)


def test_area_per_group(spark, rows):
    grouped = [(i % 3, *row) for i, row in enumerate(rows)]
    df = spark.createDataFrame(grouped, f"g int, {S.LABEL} int, {S.PROBABILITY} double")
    for r in evaluate.roc_auc(df, ["g"]).collect():
        own = [row[1:] for row in grouped if row[0] == r["g"]]
        assert r["roc_auc"] == pytest.approx(pairs_auc(own), abs=1e-12)


def test_area_is_null_without_both_classes(spark):
    assert evaluate.roc_auc(scored_frame(spark, [(1, 0.2), (1, 0.4)])).first()[0] is None


def test_running_counts_whatever_the_ranges(scored, rows):
    for ranges in (2, 5, 64):
        found = running_counts(scored, S.PROBABILITY, {"n": F.lit(1)}, ranges=ranges).collect()
        for r in found:
            assert r["n"] == sum(p == r[S.PROBABILITY] for _, p in rows)
            assert r["n_before"] == sum(p < r[S.PROBABILITY] for _, p in rows)
            assert r["n_total"] == len(rows)


def test_quantiles_interpolate(spark):
    values = [1.0, 2.0, 2.0, 2.0, 10.0, 20.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0)], "g string, v double")
    found = {r["g"]: (r["n"], r["quantiles"]) for r in exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0], ["g"]).collect()}
    assert found["a"] == (6, [1.0, 2.0, 15.0, 20.0])
    assert found["b"] == (1, [4.0] * 4)


def test_confusion_matrix_always_has_four_cells(spark, scored, rows):
    found = {(r["label"], r["prediction"]): r["n"] for r in evaluate.confusion_matrix(scored).collect()}
    for label in (0, 1):
        for prediction in (0, 1):
            expected = sum(y == label and (p >= 0.5) == bool(prediction) for y, p in rows)
            assert found[label, prediction] == expected
    assert evaluate.confusion_matrix(scored_frame(spark, [(1, 0.9)])).count() == 4


def test_metrics(scored, rows):
    found = {r["metric"]: r["value"] for r in evaluate.compute_metrics(scored).collect()}
    assert {"accuracy", "precision", "recall", "f1_score", "roc_auc", "n_samples"} <= found.keys()
    assert 0 <= found["roc_auc"] <= 1 and 0 <= found["accuracy"] <= 1
    tp = sum(y == 1 and p >= 0.5 for y, p in rows)
    assert found["precision"] == round(tp / sum(p >= 0.5 for _, p in rows), 4)
    assert found["recall"] == round(tp / sum(y for y, _ in rows), 4)
    assert found["n_samples"] == 600


def test_zero_division_gives_zero(spark):
    found = evaluate.metrics_table(scored_frame(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (found["precision"], found["recall"], found["f1_score"]) == (0.0, 0.0, 0.0)


def test_curves(scored, rows):
    roc = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(scored).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(roc, roc[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    summary = evaluate.curve_summary(scored).first()
    assert summary["roc_auc"] == pytest.approx(area) == pytest.approx(pairs_auc(rows))

    pr = [(r["threshold"], r["recall"], r["precision"]) for r in evaluate.pr_points(scored).collect()]
    pr = [point[1:] for point in sorted(pr, reverse=True)]
    assert pr[0] == (0.0, 1.0) and pr[-1][0] == 1.0
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pr, pr[1:]))
    assert summary["pr_auc"] == pytest.approx(area)
    assert summary["base_rate"] == sum(y for y, _ in rows) / len(rows)


def test_threshold_table(scored, rows):
    found = evaluate.threshold_sensitivity(scored).collect()
    assert [r["threshold"] for r in found] == [t / 100 for t in range(10, 91, 5)]
    for r in found:
        right = sum((p >= r["threshold"]) == bool(y) for y, p in rows)
        assert r["accuracy"] == pytest.approx(right / len(rows))


def test_report_text(scored):
    text = evaluate.format_report(evaluate.classification_report(scored))
    assert [line.split()[0] for line in text.splitlines()] == ["precision", "0", "1", "accuracy", "macro", "weighted"]
    assert text.splitlines()[-1].split()[-1] == "600"


def test_empty_and_one_valued_tables(spark, scored):
    assert evaluate.roc_auc(scored.limit(0)).first()[0] is None
    assert evaluate.roc_auc(scored_frame(spark, [(1, 0.0), (0, 0.0)])).first()[0] == 0.5
    assert evaluate.roc_points(scored.limit(0)).count() == 1


def test_rows_without_a_probability_are_counted_as_not_flagged(spark):
    rows = [(1, 0.9), (0, 0.2), (1, None), (0, None)]
    scored = spark.createDataFrame(rows, f"{S.LABEL} int, {S.PROBABILITY} double")
    counts = evaluate.confusion_counts(scored).first()
    assert (counts["tp"], counts["fp"], counts["fn"], counts["tn"]) == (1, 0, 1, 2)
    assert evaluate.metrics_table(scored).first()["n_samples"] == 4.0


def test_nan_probabilities_are_counted_as_not_flagged(spark):
    rows = [(0, 0.2), (0, float("nan")), (1, 0.9), (1, None), (0, 0.4), (1, 0.7)]
    scored = spark.createDataFrame(rows, "label int, churn_probability double")
    counts = evaluate.confusion_counts(scored).first()
    assert tuple(counts) == (2, 0, 1, 3)
    metrics = evaluate.metrics_table(scored).first()
    assert metrics["n_samples"] == 6 and metrics["precision"] == 1.0
    assert metrics["roc_auc"] == round((6 + 0.5) / 9, 4)
    half = evaluate.threshold_sensitivity(scored, [0.5]).first()
    assert half["accuracy"] == metrics["accuracy"] or round(half["accuracy"], 4) == metrics["accuracy"]

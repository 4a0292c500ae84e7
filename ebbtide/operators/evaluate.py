"""Evaluation of a scored table (columns ``label`` and ``churn_probability``).

All exact, all tie-aware, and all from counts per distinct probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import half_even, safe_divide
from ebbtide.operators.ranking import running_counts
from ebbtide.shared import stored

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]

# Fixed value: thresholds of the sensitivity table, 0.10 to 0.90 in steps of 0.05.
THRESHOLDS = [percent / 100 for percent in range(10, 91, 5)]


def _hits() -> dict[str, Column]:
    return {
        "pos": (F.col(S.LABEL) == 1).cast("bigint"),
        "neg": (F.col(S.LABEL) == 0).cast("bigint"),
    }


def score_counts(scored: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives at and above every distinct probability.

    A row without a probability (null or NaN) ranks below all others, at -1, so it is never flagged and always counted.
    """
    scored = scored.withColumn(S.PROBABILITY, F.coalesce(F.nanvl(F.col(S.PROBABILITY), F.lit(-1.0)), F.lit(-1.0)))
    return running_counts(scored, S.PROBABILITY, _hits(), groups, descending=True)


def confusion_counts(
    scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, groups: list[str] | None = None
) -> DataFrame:
    """tp, fp, fn, tn per group, from one aggregate; always all four.

    A row without a probability (null or NaN) isn't flagged.
    """
    p = F.col(S.PROBABILITY)
    churn, flagged = F.col(S.LABEL) == 1, F.coalesce((p >= threshold) & ~F.isnan(p), F.lit(False))
    stay = F.col(S.LABEL) == 0
    return scored.groupBy(*(groups or [])).agg(
        F.count_if(churn & flagged).alias("tp"),
        F.count_if(stay & flagged).alias("fp"),
        F.count_if(churn & ~flagged).alias("fn"),
        F.count_if(stay & ~flagged).alias("tn"),
    )


def confusion_matrix(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """(label, prediction, n): four rows, zeros included."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = [
        F.struct(
            F.lit(label).alias("label"), F.lit(prediction).alias("prediction"), F.col(name).alias("n")
        )
        for name, label, prediction in cells
    ]
    return confusion_counts(scored, threshold).select(F.inline(F.array(*rows)))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return {
        "accuracy": safe_divide(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1_score": safe_divide(2 * tp, 2 * tp + fp + fn),
    }




def roc_auc(scored: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, roc_auc): exact rank-sum area, null when a class is absent."""
    sizes = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return score_counts(scored, groups).groupBy(*(groups or [])).agg(
        safe_divide(_rank_sum(), sizes, None).alias("roc_auc")
    )


def _rank_sum() -> Column:
    """Pairs of a negative and a higher positive, ties counting half."""
    return F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))


def metrics_table(
    scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, groups: list[str] | None = None
) -> DataFrame:
    """One row per group: the five metrics, 4 decimals, size, base rate and threshold."""
    return metrics_from_counts(score_counts(scored, groups), threshold, groups)


def metrics_from_counts(
    counts: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, groups: list[str] | None = None
) -> DataFrame:
    """``metrics_table`` read off the ``score_counts`` in one aggregate."""
    groups = list(groups or [])
    flagged = F.col(S.PROBABILITY) >= threshold
    counted = counts.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, F.col("neg"))), F.lit(0)).alias("fp"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        _rank_sum().alias("area"),
    )
    tp, fp, p, n = (F.col(name) for name in ("tp", "fp", "p", "n"))
    rates = _rates(tp, fp, p - tp, n - fp)
    auc = safe_divide(F.col("area"), p.cast("double") * n.cast("double"), None)
    return counted.select(
        *groups,
        *[half_even(rate, 4).alias(name) for name, rate in rates.items()],
        half_even(auc, 4).alias("roc_auc"),
        (p + n).cast("double").alias("n_samples"),
        half_even(safe_divide(p, p + n), 4).alias("churn_rate"),
        F.lit(float(threshold)).alias("threshold"),
    )


def compute_metrics(
    scored: DataFrame,
    threshold: float = S.DEFAULT_THRESHOLD,
    split_name: str = "test",
    groups: list[str] | None = None,
) -> DataFrame:
    """``metrics_table`` in long form: (groups, split, metric, value)."""
    return _long_metrics(metrics_table(scored, threshold, groups), split_name, groups)


def _long_metrics(wide: DataFrame, split_name: str, groups: list[str] | None = None) -> DataFrame:
    groups = list(groups or [])
    names = [name for name in wide.columns if name not in groups]
    return wide.withColumn("split", F.lit(split_name)).unpivot(
        [*groups, "split"], names, "metric", "value"
    )


def classification_report(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> DataFrame:
    """(row, metric, value): per class, accuracy, macro and weighted averages."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    classes = {
        "0": (_rates(tn, fn, fp, tp), tn + fp),
        "1": (_rates(tp, fp, fn, tn), tp + fn),
    }
    names = ["precision", "recall", "f1_score"]
    cells = [("accuracy", "accuracy", safe_divide(tp + tn, total)), ("accuracy", "support", total)]
    for row, (rates, support) in classes.items():
        cells += [(row, name, rates[name]) for name in names] + [(row, "support", support)]
    for name in names:
        per_class = [(rates[name], support) for rates, support in classes.values()]
        cells.append(("macro avg", name, sum(rate for rate, _ in per_class) / 2))
        weighted = sum(rate * support for rate, support in per_class)
        cells.append(("weighted avg", name, safe_divide(weighted, total)))
    cells += [(row, "support", total) for row in ("macro avg", "weighted avg")]
    rows = [
        F.struct(
            F.lit(row).alias("row"),
            F.lit(metric).alias("metric"),
            half_even(value.cast("double"), 4).alias("value"),
        )
        for row, metric, value in cells
    ]
    return confusion_counts(scored, threshold).select(F.inline(F.array(*rows)))


def format_report(report: DataFrame) -> str:
    """The report as text; at most five rows by four metrics are fetched."""
    values = {(r["row"], r["metric"]): r["value"] for r in report.collect()}
    lines = [f"{'':>14}{'precision':>10}{'recall':>10}{'f1-score':>10}{'support':>10}"]
    for row in ("0", "1", "accuracy", "macro avg", "weighted avg"):
        if row == "accuracy":
            rates = f"{'':>20}{values[row, 'accuracy']:>10.2f}"
        else:
            rates = "".join(f"{values[row, m]:>10.2f}" for m in ("precision", "recall", "f1_score"))
        lines.append(f"{row:>14}{rates}{int(values[row, 'support']):>10}")
    return "\n".join(lines) + "\n"


def roc_points(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct probability, plus the origin."""
    points = (counts or score_counts(scored)).select(
        F.col(S.PROBABILITY).alias("threshold"),
        safe_divide(F.col("neg_before") + F.col("neg"), F.col("neg_total")).alias("fpr"),
        safe_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("tpr"),
    )
    origin = _one_row(scored.sparkSession, threshold=S.INF, fpr=0.0, tpr=0.0)
    return points.unionByName(origin)


def pr_points(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall) at every distinct probability, plus recall 0."""
    flagged = F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")
    points = (counts or score_counts(scored)).select(
        F.col(S.PROBABILITY).alias("threshold"),
        safe_divide(F.col("pos_before") + F.col("pos"), flagged).alias("precision"),
        safe_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total")).alias("recall"),
    )
    anchor = _one_row(scored.sparkSession, threshold=S.INF, precision=1.0, recall=0.0)
    return points.unionByName(anchor)


def _one_row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])


def curve_summary(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(roc_auc, pr_auc, base_rate): trapezoid areas of both curves and the base line."""
    pos_at, neg_at = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_above, neg_above = F.col("pos_before").cast("double"), F.col("neg_before").cast("double")
    here = safe_divide(pos_above + pos_at, pos_above + pos_at + neg_above + neg_at)
    # The curve starts at recall 0 with precision 1.
    before = safe_divide(pos_above, pos_above + neg_above, 1.0)
    totals = (counts or score_counts(scored)).agg(
        F.sum(pos_at).alias("p"),
        F.sum(neg_at).alias("n"),
        F.sum(neg_at * (pos_above + pos_at / 2)).alias("roc"),
        F.sum(pos_at * (here + before) / 2).alias("pr"),
    )
    p, n = F.col("p"), F.col("n")
    return totals.select(
        safe_divide(F.col("roc"), p * n, None).alias("roc_auc"),
        safe_divide(F.col("pr"), p, None).alias("pr_auc"),
        safe_divide(p, p + n).alias("base_rate"),
    )


def threshold_sensitivity(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, accuracy, precision, recall, f1) for each threshold.

    One aggregate counts all thresholds at once: each task sends a single row.
    """
    thresholds = THRESHOLDS if thresholds is None else thresholds
    # A probability that is null or NaN is below every threshold.
    churn, p = F.col(S.LABEL) == 1, F.coalesce(F.nanvl(F.col(S.PROBABILITY), F.lit(-1.0)), F.lit(-1.0))
    stay = F.col(S.LABEL) == 0
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(churn & (p >= t)).alias("tp"),
            F.count_if(stay & (p >= t)).alias("fp"),
            F.count_if(churn & ~(p >= t)).alias("fn"),
            F.count_if(stay & ~(p >= t)).alias("tn"),
        )
        for t in thresholds
    ]
    counts = scored.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
    rates = _rates(*(F.col(name) for name in ("tp", "fp", "fn", "tn")))
    return counts.select(
        "threshold", *[rate.alias("f1" if name == "f1_score" else name) for name, rate in rates.items()]
    )


def evaluate_scored(scored: DataFrame, threshold: float = S.DEFAULT_THRESHOLD) -> dict[str, DataFrame]:
    """Every evaluation table of one scored DataFrame; the probabilities are ranked once."""
    counts = stored(score_counts(scored))
    return {
        "metrics": _long_metrics(metrics_from_counts(counts, threshold), "test"),
        "confusion_matrix": confusion_matrix(scored, threshold),
        "classification_report": classification_report(scored, threshold),
        "roc_points": roc_points(scored, counts),
        "pr_points": pr_points(scored, counts),
        "curve_summary": curve_summary(scored, counts),
        "threshold_sensitivity": threshold_sensitivity(scored),
    }

"""The tables behind the dashboard charts."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import schema as S
from ebbtide.functions.numeric import bin_label, equal_bin, half_even, known, safe_divide
from ebbtide.functions.text import answered, flag, holds, is_text, no, to_number, yes
from ebbtide.operators.ranking import exact_quantiles

# Fixed value: names of the two label values in charts.
LABEL_NAMES = {"Yes": "Churn", "No": "No Churn", 1: "Churn", 0: "No Churn"}


def churned(df: DataFrame) -> Column:
    """1 where the customer churned, for a text or a 0/1 target."""
    return flag(yes(df, S.TARGET))


def label_name(df: DataFrame) -> Column:
    """Chart name of the label; any other value has none."""
    kind = str if is_text(df, S.TARGET) else int
    chain = F.lit(None).cast("string")
    for value, name in LABEL_NAMES.items():
        if isinstance(value, kind):
            chain = F.when(F.col(S.TARGET) == value, name).otherwise(chain)
    return chain


def dataset_kpis(df: DataFrame) -> DataFrame:
    """(customers, churn_rate, n_columns, missing_cells) from one aggregate."""
    cells = [F.count_if(F.col(f"`{name}`").isNull()) for name in df.columns]
    rows = F.count(F.lit(1))
    if S.TARGET not in df.columns:
        rate = F.lit(None).cast("double")
    elif is_text(df, S.TARGET):
        rate = safe_divide(F.sum(churned(df)), rows, None)
    else:
        rate = F.avg(S.TARGET)
    return df.agg(
        rows.alias("customers"),
        rate.alias("churn_rate"),
        F.lit(len(df.columns)).alias("n_columns"),
        sum(cells[1:], cells[0]).alias("missing_cells"),
    )


def shares(df: DataFrame, value: Column, name: str) -> DataFrame:
    """(name, n, pct) per distinct value; nulls are left out."""
    counts = (
        df.select(value.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("_total", total).select(
        name, "n", half_even(safe_divide(100 * F.col("n"), F.col("_total")), 4).alias("pct")
    )


def churn_share(df: DataFrame) -> DataFrame:
    return shares(df, label_name(df), "label_name")


def internet_share(df: DataFrame) -> DataFrame:
    return shares(df, F.col("InternetService"), "InternetService")


def _range_of(df: DataFrame, name: str) -> Column:
    return df.agg(
        F.struct(
            F.min(name).cast("double").alias("low"), F.max(name).cast("double").alias("high")
        )
    ).scalar()


def tenure_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """(label_name, bin, n) over equal bins between the smallest and largest tenure."""
    grouped = S.TARGET in df.columns
    name = label_name(df) if grouped else F.lit("All")
    counts = (
        df.select(name.alias("label_name"), "tenure")
        .filter(F.col("label_name").isNotNull() & F.col("tenure").isNotNull())
        .groupBy("label_name", "tenure")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bin_of = equal_bin(F.col("tenure").cast("double"), F.col("_span.low"), F.col("_span.high"), bins)
    return (
        counts.withColumn("_span", _range_of(counts, "tenure"))
        .groupBy("label_name", bin_of.alias("bin"))
        .agg(F.sum("n").alias("n"))
    )


def monthly_charges_box(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(label_name, n, minimum, q1, median, q3, maximum, mean) of MonthlyCharges.

    Exact by default; ``approximate`` uses one sketch aggregate instead.
    """
    name = label_name(df) if S.TARGET in df.columns else F.lit("All")
    charges = df.select(name.alias("label_name"), known(F.col("MonthlyCharges")).alias("MonthlyCharges")).filter(
        F.col("label_name").isNotNull()
    )
    plain = charges.groupBy("label_name").agg(
        F.count("MonthlyCharges").alias("n"),
        F.min("MonthlyCharges").alias("minimum"),
        F.max("MonthlyCharges").alias("maximum"),
        half_even(F.avg("MonthlyCharges"), 6).alias("mean"),
        *(
            [F.percentile_approx("MonthlyCharges", [0.25, 0.5, 0.75]).alias("quantiles")]
            if approximate
            else []
        ),
    )
    if not approximate:
        quartiles = exact_quantiles(charges, "MonthlyCharges", [0.25, 0.5, 0.75], ["label_name"])
        plain = plain.join(quartiles.drop("n"), "label_name")
    return plain.select(
        "label_name",
        "n",
        "minimum",
        *[half_even(F.col("quantiles")[i], 6).alias(q) for i, q in enumerate(["q1", "median", "q3"])],
        "maximum",
        "mean",
    )


def contract_churn(df: DataFrame) -> DataFrame:
    """(Contract, label_name, n); without a label just (Contract, n)."""
    if S.TARGET not in df.columns:
        keys = ["Contract"]
        rows = df.select("Contract")
    else:
        keys = ["Contract", "label_name"]
        rows = df.select("Contract", label_name(df).alias("label_name"))
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def risk_distribution(batch: DataFrame) -> DataFrame:
    """(position, RiskLabel, n): the four tiers in order, zeros included."""
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(label).alias("RiskLabel"),
            F.count_if(F.col("RiskLabel") == label).alias("n"),
        )
        for i, (label, _, _) in enumerate(S.RISK_TIERS)
    ]
    return batch.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def probability_histogram(batch: DataFrame, bins: int = 40) -> DataFrame:
    """(RiskLabel, bin, n) of ChurnProbability over equal bins of 0..100."""
    bin_of = equal_bin(F.col("ChurnProbability"), F.lit(0.0), F.lit(100.0), bins)
    return (
        batch.filter(F.col("ChurnProbability").isNotNull())
        .groupBy("RiskLabel", bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def correlation_inputs(df: DataFrame) -> DataFrame:
    """Numeric columns of the raw table: churn as 0/1 and TotalCharges parsed."""
    if S.TARGET in df.columns and is_text(df, S.TARGET):
        df = df.withColumn("Churn_binary", churned(df))
    if "TotalCharges" in df.columns and is_text(df, "TotalCharges"):
        df = df.withColumn("TotalCharges", to_number(F.trim("TotalCharges")))
    return df.select(*numeric_columns(df))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def most_varied(df: DataFrame, top_n: int = 15) -> list[str]:
    """The ``top_n`` numeric columns with the largest variance, from one aggregate row."""
    names = numeric_columns(df)
    spread = df.agg(*[F.var_samp(f"`{name}`").alias(name) for name in names]).first()
    return sorted(names, key=lambda name: -(spread[name] or 0.0))[:top_n]


def correlation(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(x, y, corr): Pearson correlation of all pairs of the numeric columns, both ways round.

    Each pair uses the rows where both are present. ``names`` takes some columns only.
    """
    names = numeric_columns(df) if names is None else names
    pairs = list(combinations_with_replacement(names, 2))

    def pearson(x: str, y: str) -> str:
        # corr() itself fails on a constant column under ANSI rules; here it gives null.
        a, b = f"double(`{x}`)", f"double(`{y}`)"
        spread = (
            f"sqrt(var_pop({a}) FILTER (WHERE `{y}` IS NOT NULL) * "
            f"var_pop({b}) FILTER (WHERE `{x}` IS NOT NULL))"
        )
        return f"try_divide(covar_pop({a}, {b}), {spread})"

    # SQL text: a few hundred expressions are much quicker to hand over that way.
    found = [f"{pearson(x, y)} AS c{i}" for i, (x, y) in enumerate(pairs)]
    measured = df.agg(*[F.expr(text) for text in found])
    rows = []
    for i, (x, y) in enumerate(pairs):
        value = f"rint(c{i} * 1e6D) / 1e6D AS corr"
        rows += [f"struct('{a}' AS x, '{b}' AS y, {value})" for a, b in sorted({(x, y), (y, x)})]
    return measured.selectExpr(f"inline(array({', '.join(rows)}))")


def churn_by_contract(df: DataFrame) -> DataFrame:
    """(Contract, customers, churn_rate_pct)."""
    return (
        df.select("Contract", churned(df).alias("_churned"))
        .filter(F.col("Contract").isNotNull())
        .groupBy("Contract")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            half_even(F.avg("_churned") * 100, 4).alias("churn_rate_pct"),
        )
    )


def churn_by_tenure(df: DataFrame) -> DataFrame:
    """(tenure_band, churn_rate_pct); tenures outside all bands are left out."""
    band = bin_label(F.col("tenure"), *S.TENURE_BANDS, None)
    return (
        df.select(band.alias("tenure_band"), churned(df).alias("_churned"))
        .filter(F.col("tenure_band").isNotNull())
        .groupBy("tenure_band")
        .agg(half_even(F.avg("_churned") * 100, 4).alias("churn_rate_pct"))
    )


def _segments(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Segment name -> (in the segment, in the group it is compared with)."""
    monthly = answered(df, "Contract", "Month-to-month")
    loyal = holds(F.col("tenure") >= S.LOYAL_TENURE)
    costly = holds(known(F.col("MonthlyCharges")) > S.HIGH_CHARGE)
    family = yes(df, "Partner") & yes(df, "Dependents")
    return {
        "month_to_month_vs_two_year": (monthly, answered(df, "Contract", "Two year")),
        "tenure_24_plus": (loyal, ~loyal),
        "charges_above_80": (costly, ~costly),
        "no_tech_support": (no(df, "TechSupport"), yes(df, "TechSupport")),
        "online_security": (yes(df, "OnlineSecurity"), no(df, "OnlineSecurity")),
        "family": (family, ~family),
    }


def segment_lift(df: DataFrame) -> DataFrame:
    """(segment, n_in, n_out, rate_in, rate_out, ratio): churn inside and outside segments."""
    target = churned(df)
    rows = [
        F.struct(
            F.lit(name).alias("segment"),
            F.count_if(inside).alias("n_in"),
            F.count_if(outside).alias("n_out"),
            F.avg(F.when(inside, target)).alias("rate_in"),
            F.avg(F.when(outside, target)).alias("rate_out"),
        )
        for name, (inside, outside) in _segments(df).items()
    ]
    measured = df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
    return measured.select(
        "segment",
        "n_in",
        "n_out",
        half_even(F.col("rate_in"), 6).alias("rate_in"),
        half_even(F.col("rate_out"), 6).alias("rate_out"),
        half_even(safe_divide(F.col("rate_in"), F.col("rate_out"), None), 6).alias("ratio"),
    )


def target_segments(df: DataFrame) -> DataFrame:
    """(segment, customers, monthly_charges, churn_rate) of the retention target groups."""
    fiber = answered(df, "InternetService", "Fiber optic")
    tenure, monthly = F.col("tenure"), answered(df, "Contract", "Month-to-month")
    charge = known(F.col("MonthlyCharges"))
    groups = {
        "month_to_month": monthly,
        "fiber_without_support_or_security": fiber & (no(df, "TechSupport") | no(df, "OnlineSecurity")),
        "tenure_12_to_24": holds((tenure >= 12) & (tenure <= 24)),
        "high_charge_month_to_month": monthly & holds(charge > S.HIGH_CHARGE),
        "tenure_below_6": holds(tenure < 6),
    }
    rows = [
        F.struct(
            F.lit(name).alias("segment"),
            F.count_if(member).alias("customers"),
            half_even(F.coalesce(F.sum(F.when(member, charge)), F.lit(0.0))).alias(
                "monthly_charges"
            ),
            half_even(F.coalesce(F.avg(F.when(member, churned(df))), F.lit(0.0)), 6).alias("churn_rate"),
        )
        for name, member in groups.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def top_importance(importance: DataFrame, top_n: int = 15) -> DataFrame:
    """The ``top_n`` features of an importance table."""
    return importance.orderBy(F.desc("importance"), "feature").limit(top_n)


def preview_rows(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows by customer id."""
    return df.orderBy(S.ID).limit(rows)


def preview_batch(batch: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows of a batch result with the columns that the dashboard shows."""
    shown = [S.ID, "ChurnProbability", "ChurnPrediction_Label", "RiskLabel", "Recommendation"]
    return preview_rows(batch, rows).select(*shown)

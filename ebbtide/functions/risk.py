"""Risk tiers, retention advice and revenue impact as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import half_even
from ebbtide.functions.text import holds, no

# Advice by action code, in our own words; order is the order of the sentences.
TIER_ADVICE = {
    "KEEP": "Loyalty looks strong: keep the standard engagement programme.",
    "WATCH": "Some drift: watch this account and send a loyalty reward or a short survey.",
    "CONTACT": "High churn risk: call the customer with a personal retention offer.",
    "ESCALATE": "Critical churn risk: escalate to the retention team at once and "
    "prepare a contract upgrade with a free add-on.",
}
TIP_ADVICE = {
    "UPGRADE_CONTRACT": "Tip: propose a one- or two-year contract at 15% off.",
    "ADD_TECH_SUPPORT": "Tip: bundle TechSupport, customers with support stay longer.",
    "ADD_SECURITY": "Tip: add the Online Security package, a strong reason to stay.",
}
ADVICE_SEPARATOR = "  \n"


def _by_tier(probability: Column, values: list[str]) -> Column:
    """One value per tier; null and NaN fall through to the last tier."""
    chain = None
    for (_, upper, _), value in zip(S.RISK_TIERS[:-1], values):
        below = probability < upper
        chain = F.when(below, value) if chain is None else chain.when(below, value)
    return chain.otherwise(values[-1])


def risk_label(probability: Column) -> Column:
    return _by_tier(probability, [label for label, _, _ in S.RISK_TIERS])


def risk_color(label: Column) -> Column:
    chain = None
    for name, _, colour in S.RISK_TIERS:
        chain = F.when(label == name, colour) if chain is None else chain.when(label == name, colour)
    return chain.otherwise(S.UNKNOWN_TIER_COLOUR)


def _tips(df: DataFrame) -> dict[str, Column]:
    """Condition of each tip, for the columns that ``df`` has."""
    contract = F.col("Contract").contains("Month") if "Contract" in df.columns else F.lit(False)
    return {
        "UPGRADE_CONTRACT": holds(contract),
        "ADD_TECH_SUPPORT": no(df, "TechSupport"),
        "ADD_SECURITY": no(df, "OnlineSecurity"),
    }


def action_codes(df: DataFrame, probability: Column) -> Column:
    """array<string>: the tier action first, then the tips that apply."""
    tips = [F.when(condition, code) for code, condition in _tips(df).items()]
    return F.array_compact(F.array(_by_tier(probability, list(TIER_ADVICE)), *tips))


def recommendation(df: DataFrame, probability: Column) -> Column:
    """The advice sentences that belong to ``action_codes``, one per line."""
    tips = [F.when(condition, TIP_ADVICE[code]) for code, condition in _tips(df).items()]
    return F.concat_ws(
        ADVICE_SEPARATOR, _by_tier(probability, list(TIER_ADVICE.values())), *tips
    )


def months_remaining(tenure: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(S.LOYAL_TENURE) - tenure).cast("int")


def business_impact(probability: Column, charge: Column, tenure: Column) -> dict[str, Column]:
    """Revenue at risk weighted by probability, cost of an offer, savings and return."""
    months = months_remaining(tenure)
    at_risk = half_even(charge * months * probability)
    cost = half_even(charge * S.OFFER_DISCOUNT * 12)
    savings = half_even(at_risk - cost)
    return {
        "revenue_at_risk": at_risk,
        "retention_cost": cost,
        "estimated_savings": savings,
        "roi_pct": F.when(cost > 0, half_even(savings / cost * 100, 1)).otherwise(F.lit(0.0)),
        "avg_remaining_tenure_months": months,
    }

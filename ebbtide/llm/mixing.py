"""Mixing domains to target weights by soft membership, in DataFrame operations alone.

A multinomial classifier learns the domains (languages, unless another column is named) from the documents of the labelled
table and gives every document a posterior over them, from its whole text. Then nonnegative rates, one per document,
are fitted so that the expected tokens of each domain, sum(rate * tokens * posterior), meet the target: the least change
of all rates, in squares, by projected gradient. The gradient is K numbers, one multiplier a domain; a document's rate is
1 - posterior . multipliers, projected onto `least` and above. A step moves the multipliers by the distances from the
targets in the metric of the rows that are not held at `least`, halved where it overshoots. It needs K and K * K sums over all
documents, and its result is K numbers, so nothing grows on the driver, no rate is stored between steps, and no step is done again.

The steps end at the optimum, when no domain is farther than CLOSE of all tokens from its target; the distance left is returned. With
least >= 1 no document may go: the total starts at the smallest that keeps every domain's tokens, and grows
until the posteriors, which are soft, can meet it.

The classifier is fitted on a bounded sample (`most` labelled documents with the smallest hashes of their ids); tokens,
posteriors and rates cover all rows. Tokens are white-space words. A null or empty text has no tokens, the prior as its
posterior and a rate like others, which moves no sum. Repeated rows have equal rates. Domains that no labelled
document has can't be met and are left out of the fit; without any labelled document all posteriors are equal. An empty
table gives no rows. Columns beyond those named are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.llm.licenses import let
from ebbtide.llm.workspace import Workspace

#: Hashed words, the words that a text's evidence counts for at most, and labelled documents in the sample.
BUCKETS, EVIDENCE, MOST = 1 << 12, 8.0, 4000
#: Steps at most, and how near the targets the sums are to be, as a share of all tokens.
STEPS, CLOSE = 60, 1e-7
#: Totals that are tried in turn where none is given and no document may go, as shares more than the smallest.
GROWTH = [0.0, *(0.005 * 2**k for k in range(10))]

# The target weights of the registered query and the pipeline.
TARGETS = {"en": 0.50, "fr": 0.18, "de": 0.18, "es": 0.14}


def buckets(text: Column) -> Column:
    """The bucket of every white-space word, from 1."""
    listed = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0b]+"), lambda w: w != "")
    return F.transform(listed, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int"))


@dataclass
class Classifier:
    domains: list[str]
    #: Log probability of each bucket in each domain, and of each domain.
    words: np.ndarray
    priors: np.ndarray

    def posteriors(self, listed: Column) -> Column:
        """The posterior (array of doubles, one per domain) of a text's buckets."""
        evidence = F.when(F.size(listed) == 0, 0.0).otherwise(F.lit(EVIDENCE) / (F.lit(EVIDENCE) + F.size(listed)))
        logs = []
        for row, prior in zip(self.words, self.priors):
            # Folded to one array literal when the plan is optimised.
            weights = F.split(F.lit(",".join(f"{x:.6g}" for x in row)), ",").cast("array<double>")
            logs.append(F.lit(float(prior)) + evidence * _sum_at(listed, weights))

        def normal(x: Column) -> Column:
            return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

        def shares(x: Column) -> Column:
            return let(F.aggregate(x, F.lit(0.0), lambda total, v: total + v), lambda all_: F.transform(x, lambda v: v / all_))

        return let(let(F.array(*logs), normal), shares)


def _sum_at(listed: Column, weights: Column) -> Column:
    return F.aggregate(listed, F.lit(0.0), lambda total, b: total + F.element_at(weights, b))


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], column: str = "lang", most: int = MOST) -> Classifier:
    known = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # A side of at most `most` ids.
    rows = docs.where(F.col(column).isin(domains)).select("doc_id", F.col(column).alias("domain"), "text")
    rows = rows.join(F.broadcast(sample), "doc_id").select("domain", buckets(F.col("text")).alias("listed"))
    counted = rows.select("domain", F.explode("listed").alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    # BUCKETS numbers for each domain, and one for the documents.
    counts = np.zeros((len(domains), BUCKETS))
    for r in counted.collect():
        counts[domains.index(r["domain"]), r["bucket"] - 1] = r["n"]
    documents = np.zeros(len(domains))
    for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect():
        documents[domains.index(r["domain"])] = r["n"]
    smooth = counts + 0.5
    words = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    share = (documents + 0.5) / (documents + 0.5).sum()
    return Classifier(domains, words, np.log(share))


@dataclass
class Fit:
    """Multipliers of the domains, the tokens wanted, and how far the domain farthest from its target is, as a share of them."""

    multipliers: np.ndarray
    total: float
    distance: float


def fit(rows: DataFrame, targets: np.ndarray, least: float = 0.0, total: float | None = None) -> Fit:
    """The multipliers y for rows (tokens, p): rate = max(least, 1 - p . y).

    total: the tokens wanted; without it those there are now or, with least >= 1, about the fewest that can be met.
    """
    k = len(targets)
    sums = _state(rows, np.zeros(k), least)[0]
    if not sums.sum():
        return Fit(np.zeros(k), 0.0, 0.0)
    met = (sums > 1e-9 * sums.sum()) & (targets > 0)
    if not met.any():
        return Fit(np.zeros(k), sums.sum(), 0.0)
    weights = np.where(met, targets, 0) / targets[met].sum()
    if total is not None or least < 1:
        return _solved(rows, weights, met, least, sums.sum() if total is None else total, np.zeros(k))
    smallest, at = max(sums[met] / weights[met]), np.zeros(k)
    for more in GROWTH:
        found = _solved(rows, weights, met, least, smallest * (1 + more), at)
        if found.distance <= CLOSE:
            break
        at = found.multipliers
    return found


def _state(rows: DataFrame, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of the domains at these multipliers, the metric of the rows not held at `least`, and the dual's sum; one pass."""
    k = len(y)
    p = [F.col("p")[i] for i in range(k)]
    u = sum((p[i] * F.lit(float(y[i])) for i in range(k)), F.lit(0.0))
    t, free = F.col("tokens"), F.lit(1.0) - F.col("u") >= F.lit(least)
    rate = F.greatest(F.lit(float(least)), F.lit(1.0) - F.col("u"))
    height = F.when(free, rate * rate / 2).otherwise(least * least / 2 + least * (1 - least) - least * F.col("u"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.select("tokens", "p", u.alias("u")).agg(
        *(F.sum(t * rate * p[i]).alias(f"s{i}") for i in range(k)),
        *(F.sum(F.when(free, t * p[i] * p[j])).alias(f"g{i}_{j}") for i, j in pairs),
        F.sum(t * height).alias("height"),
    ).first()
    metric = np.zeros((k, k))
    for i, j in pairs:
        metric[i, j] = metric[j, i] = row[f"g{i}_{j}"] or 0.0
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), metric, row["height"] or 0.0


def _solved(rows: DataFrame, weights: np.ndarray, met: np.ndarray, least: float, total: float, y: np.ndarray) -> Fit:
    goal = weights * total
    now, metric, height = _state(rows, y, least)
    best, since = np.inf, 0
    for _ in range(STEPS):
        gap = np.where(met, now - goal, 0.0)
        distance = float(np.abs(gap).max() / total)
        since = 0 if distance < best / 2 else since + 1
        best = min(best, distance)
        if distance <= CLOSE or since > 8:
            break  # at the targets, or as near as these posteriors get
        step = np.where(met, np.linalg.pinv(metric, rcond=1e-12, hermitian=True) @ gap, 0.0)
        if not step.any():
            # All rows that could move are held at `least`: follow the gradient itself.
            step = gap / max(now.sum(), 1.0)
        value, slope, share = height + y @ goal, float(gap @ step), 1.0
        while True:
            trial = y + share * step
            now_, metric_, height_ = _state(rows, trial, least)
            if height_ + trial @ goal <= value - 1e-4 * share * slope or share < 1e-4:
                break
            share /= 2
        y, now, metric, height = trial, now_, metric_, height_
    return Fit(y, total, float(np.abs(np.where(met, now - goal, 0.0)).max() / total))


def rates(p: Column, multipliers: np.ndarray, least: float) -> Column:
    """The rate of a row: 1 less its share of the multipliers, and never below `least`."""
    u = sum((p[i] * F.lit(float(x)) for i, x in enumerate(multipliers)), F.lit(0.0))
    return F.greatest(F.lit(float(least)), F.lit(1.0) - u)


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    column: str = "lang",
    least: float = 0.0,
    total: float | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of docs (all by default) with tokens, p (posteriors in the targets' order), rate, copies and distance.

    copies: the rate, rounded up or down by a draw that a row's id and text decide, so its expectation is the rate. distance: how far
    the domain farthest from its target is, as a share of all tokens. Columns of docs that have one of these names give way.
    """
    work = Workspace(docs.sparkSession, "mixing")
    domains = list(targets)
    model = learn(docs, labels, domains, column)
    own = ("tokens", "p", "rate", "copies", "distance")
    names = [c for c in (docs.columns if keep is None else keep) if c not in own]
    listed = buckets(F.col("text"))
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    parts = let(listed, lambda x: F.struct(F.size(x).cast("bigint").alias("tokens"), model.posteriors(x).alias("p")))
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), parts.alias("__parts"), draw.alias("__at"))
    kept = work.keep(kept.select("__row", "__at", F.col("__parts.tokens").alias("tokens"), F.col("__parts.p").alias("p")))
    found = fit(kept.select("tokens", "p"), np.array(list(targets.values())), least, total)
    out = kept.withColumn("rate", rates(F.col("p"), found.multipliers, least))
    out = out.withColumn("copies", F.floor(F.col("rate") + F.col("__at")).cast("bigint"))
    return out.select("__row.*", "tokens", "p", "rate", "copies", F.lit(found.distance).alias("distance"))

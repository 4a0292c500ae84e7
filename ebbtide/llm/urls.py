"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in numpy on a small labelled URL table of at most `most` rows (label 1: block). Features are the
character n-grams of the host and of the path, hashed apart; a feature is there or not. Scoring is a sum of weights in
Arrow batches; the weights are one array of fixed size.

A null url, or one without "://", has an empty host and path, fits no rule and gets the method's verdict on two empty
strings. Repeated rows are judged alike. Columns beyond those named are left alone. An empty table gives no rows; without
labelled rows, or with one label only, the model gives that label's verdict, and allows all without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Hashed features, and the lengths of the n-grams.
FEATURES, GRAMS = 1 << 16, (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


# The rules of the filter.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as host and path; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(str(rule))).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """The distinct hashed n-grams; the borders of both parts count as characters."""
    out = set()
    for mark, part in (("h", host), ("p", path)):
        part = f"\x02{part}\x03"
        for n in GRAMS:
            for i in range(max(1, len(part) - n + 1)):
                out.add(xxhash.xxh32_intdigest((mark + part[i : i + n]).encode("utf-8", "surrogatepass")) % FEATURES)
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


def train(rows: list[tuple[str, str, int]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias, from (host, path, label) by stochastic gradient steps with Adagrad."""
    weights, square = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    seen = [(np.append(features(h, p), FEATURES), y) for h, p, y in rows]
    labels = {y for _, y in seen}
    if len(labels) < 2:
        weights[-1] = 5.0 if labels == {1} else -5.0
        return weights
    draw = np.random.default_rng(3)
    for _ in range(epochs):
        for i in draw.permutation(len(seen)):
            at, y = seen[i]
            slope = 1 / (1 + np.exp(-weights[at].sum())) - y + decay * weights[at]
            square[at] += slope * slope
            weights[at] -= rate * slope / np.sqrt(square[at]) / np.sqrt(len(at))
    return weights


def labelled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = 4000) -> list[tuple[str, str, int]]:
    """The small labelled URL table: of each verdict of the rules, the `most` / 2 urls with the smallest hashes.

    The hash spreads the choice over the whole table; the bound is the only sample in this operator.
    """
    url = F.col("url")
    rows = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).distinct()
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).where("rule IS NOT NULL")
    block = F.col("rule").isin([str(r) for r in rules if r.verdict == "block"])
    out = []
    for label in (0, 1):
        some = rows.where(block if label else ~block).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most // 2)
        out += [(r["host"], r["path"], label) for r in some.collect()]
    return sorted(out)


def score(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages (page_id, host, path) with the probability that a url is to be blocked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [
                weights[features(h, p)].sum() + weights[-1]
                for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            chance = 1 / (1 + np.exp(-np.clip(np.array(total, dtype=np.float64), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=["page_id", "host", "path", "score"])

    return pages.select("page_id", "host", "path").mapInArrow(task, "page_id bigint, host string, path string, score double")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = 4000, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url)."""
    weights = train(labelled(pages, rules, most))
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("bigint"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = score(rows, weights).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule in rules:
        verdict = F.when(F.col("rule") == str(rule), rule.verdict).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

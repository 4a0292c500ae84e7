"""Attributions and importances.

Long attribution tables have the columns ``customerID, feature, feature_value, phi``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.functions.numeric import half_even
from ebbtide.operators.evaluate import roc_auc
from ebbtide.operators.ranking import exact_quantiles
from ebbtide.operators.score import Scorer, rule_terms
from ebbtide.shared import shuffle_partitions

SUMMARY_ROWS = 20
WATERFALL_ROWS = 15
REST = "rest"
BASE = "base value"


def sample_rows(df: DataFrame, rows: int | None, seed: int = S.SEED, key: str = S.ID) -> DataFrame:
    """``rows`` random rows, the same ones on every run; all rows when None."""
    if rows is None:
        return df
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":sample{seed}")))).limit(rows)


# --- exact attribution of the additive rule ---------------------------------------------


def linear_entries(df: DataFrame) -> DataFrame:
    """(customerID, base, entries): per row an array of (feature, feature_value, phi).

    phi is the term of the feature minus its mean over the table; base is the mean score.
    """
    terms = rule_terms(df)
    numeric = {"tenure", "MonthlyCharges", "SeniorCitizen"}
    wide = df.select(
        S.ID,
        *[term.alias(f"term_{name}") for name, term in terms.items()],
        *[F.col(name).cast("double").alias(f"value_{name}") for name in terms if name in numeric],
    )
    means = wide.agg(F.struct(*[F.avg(f"term_{name}").alias(name) for name in terms])).scalar()
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"value_{name}" if name in numeric else f"term_{name}").alias("feature_value"),
            half_even(F.col(f"term_{name}") - F.col("_means")[name], 9).alias("phi"),
        )
        for name in terms
    ]
    base = sum((F.col("_means")[name] for name in terms), F.lit(0.0))
    return wide.withColumn("_means", means).select(
        S.ID, half_even(base, 9).alias("base"), F.array(*entries).alias("entries")
    )


def linear_attribution(df: DataFrame) -> DataFrame:
    """Long attribution table of the additive rule."""
    return linear_entries(df).select(S.ID, F.inline("entries"))


# --- summaries of any long attribution table ----------------------------------------------


def as_entries(attribution: DataFrame) -> DataFrame:
    """Long table to one row per customer; an array is as long as the feature list."""
    entry = F.struct("feature", "feature_value", "phi")
    return attribution.groupBy(S.ID).agg(F.collect_list(entry).alias("entries"))


def attribution_summary(attribution: DataFrame, top_n: int = SUMMARY_ROWS) -> DataFrame:
    """(feature, n, mean_abs_phi, p05, median, p95) of the strongest features."""
    spread = exact_quantiles(attribution, "phi", [0.05, 0.5, 0.95], ["feature"]).drop("n")
    strength = attribution.groupBy("feature").agg(
        F.count("phi").alias("n"), half_even(F.avg(F.abs("phi")), 6).alias("mean_abs_phi")
    )
    names = ["p05", "median", "p95"]
    return (
        strength.join(spread, "feature")
        .select(
            "feature",
            "n",
            "mean_abs_phi",
            *[half_even(F.col("quantiles")[i], 6).alias(name) for i, name in enumerate(names)],
        )
        .orderBy(F.desc("mean_abs_phi"), "feature")
        .limit(top_n)
    )


def waterfall(entries: DataFrame, rows: int = WATERFALL_ROWS) -> DataFrame:
    """(customerID, position, feature, phi): the strongest features of every customer.

    Position 0 is the base value when the table has one; what does not fit in
    ``rows`` entries is summed up in a last entry.
    """
    ranked = F.array_sort(
        F.transform(
            "entries",
            lambda e: F.struct((-F.abs(e["phi"])).alias("key"), e["feature"].alias("feature"), e["phi"].alias("phi")),
        )
    )
    shown = F.transform(
        F.slice("_ranked", 1, rows),
        lambda e, i: F.struct((i + 1).alias("position"), e["feature"].alias("feature"), e["phi"].alias("phi")),
    )
    hidden = F.aggregate(
        F.slice("_ranked", rows + 1, F.greatest(F.size("_ranked"), F.lit(1))),
        F.lit(0.0),
        lambda total, e: total + e["phi"],
    )
    kind = "array<struct<position:int,feature:string,phi:double>>"
    extra = [
        F.when(
            F.size("_ranked") > rows,
            F.array(F.struct(F.lit(rows + 1).alias("position"), F.lit(REST).alias("feature"), hidden.alias("phi"))),
        )
        .otherwise(F.array())
        .cast(kind)
    ]
    if "base" in entries.columns:
        first = F.struct(F.lit(0).alias("position"), F.lit(BASE).alias("feature"), F.col("base").alias("phi"))
        extra.append(F.array(first).cast(kind))
    lines = F.concat(shown.cast(kind), *extra)
    return (
        entries.withColumn("_ranked", ranked)
        .select(S.ID, F.inline(lines))
        .withColumn("phi", half_even(F.col("phi"), 6))
    )


def dependence(
    attribution: DataFrame, top: int = 3, features: list[str] | None = None, bins: int = 10
) -> DataFrame:
    """(feature, bin, n, mean_value, mean_phi): phi against the feature value, by quantile bin.

    For the named features, or else for the ``top`` strongest ones.
    """
    if features is not None:
        chosen = attribution.filter(F.col("feature").isin(features))
    else:
        # `top` rows, and below one row per feature: small by construction.
        strongest = attribution_summary(attribution, top).select("feature")
        chosen = attribution.join(F.broadcast(strongest), "feature", "left_semi")
    edges = exact_quantiles(chosen, "feature_value", [i / bins for i in range(1, bins)], ["feature"])
    edges = edges.select("feature", F.col("quantiles").alias("_edges"))
    binned = chosen.join(F.broadcast(edges), "feature").withColumn(
        "bin", F.size(F.filter("_edges", lambda edge: edge < F.col("feature_value")))
    )
    return binned.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        half_even(F.avg("feature_value"), 6).alias("mean_value"),
        half_even(F.avg("phi"), 6).alias("mean_phi"),
    )


# --- Shapley values of a fitted model by permutation sampling -----------------------------


def background_rows(df: DataFrame, rows: int = 100, seed: int = S.SEED, key: str = S.ID) -> DataFrame:
    """(slot, z): ``rows`` sampled feature arrays, numbered from 0."""
    picked = sample_rows(df, rows, seed + 1, key).select(key, vector_to_array("features").alias("z"))
    # The window sees the sample only, `rows` rows.
    number = F.row_number().over(Window.orderBy(key)) - 1
    return picked.select(number.cast("bigint").alias("slot"), "z")


def shapley_sampling(
    rows: DataFrame,
    background: DataFrame,
    score_vectors: Scorer,
    feature_names: list[str],
    permutations: int = 10,
    seed: int = S.SEED,
    key: str = S.ID,
) -> DataFrame:
    """Long attribution table of a model on the vector column ``features``.

    Every row is mixed with a random background row: the features of a random order
    are switched one at a time from the background to the row, and each switch
    credits its feature with the change of the score. Per permutation the changes
    add up to f(row) - f(background) exactly. All mixtures are scored in bulk, one for each switch between unlike values.

    ``background`` comes from ``background_rows``. A last row per customer, feature
    "base value", has the mean score of its background rows.
    """
    width = len(feature_names)
    slots = background.agg(F.count(F.lit(1)).alias("n")).scalar()
    indexes = F.sequence(F.lit(0), F.lit(width - 1))
    mixed = (
        rows.select(key, vector_to_array("features").alias("x"))
        .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_slots", slots)
        .withColumn("slot", F.pmod(F.xxhash64(key, "perm", F.lit(seed)), F.col("_slots")))
        # The background is a fixed-size sample.
        .join(F.broadcast(background), "slot")
        .withColumn(
            "order",
            F.transform(
                F.array_sort(
                    F.transform(
                        indexes,
                        lambda j: F.struct(
                            F.xxhash64(F.col(key), F.col("perm"), j, F.lit(seed)).alias("draw"), j.alias("j")
                        ),
                    )
                ),
                lambda e: e["j"],
            ),
        )
        .withColumn("rank", F.transform(indexes, lambda j: F.array_position("order", j) - 1))
        # A switch between equal values changes neither the mixture nor the score: only the others make a mixture.
        .withColumn("_switched", F.filter("order", lambda j: ~F.get("x", j).eqNullSafe(F.get("z", j))))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.size("_switched"))))
        .withColumn("_upto", F.when(F.col("step") > 0, F.get("rank", F.get("_switched", F.col("step") - 1))).otherwise(-1))
        .withColumn(
            "features",
            array_to_vector(
                F.transform(
                    indexes,
                    lambda j: F.when(F.get("rank", j) <= F.col("_upto"), F.get("x", j)).otherwise(F.get("z", j)),
                )
            ),
        )
    )
    score = F.col(S.PROBABILITY)
    gained = F.when(F.col("step") > 0, F.struct(F.get("_switched", F.col("step") - 1).alias("j"), score.alias("part")))
    started = F.when(
        F.col("step") < F.size("_switched"), F.struct(F.get("_switched", F.col("step")).alias("j"), (-score).alias("part"))
    )
    # With the base of the first order, every feature gets a row, also one that is never switched.
    base = F.when(F.col("step") == 0, F.struct(F.lit(width).alias("j"), score.alias("part")))
    every = F.when(
        (F.col("step") == 0) & (F.col("perm") == 0),
        F.transform(indexes, lambda j: F.struct(j.alias("j"), F.lit(0.0).alias("part"))),
    )
    parts = F.concat(F.array_compact(F.array(gained, started, base)), F.coalesce(every, F.array().cast("array<struct<j:int,part:double>>")))
    own_value = F.when(F.col("_part.j") < width, F.get("x", F.col("_part.j")))
    names = F.array(*[F.lit(name) for name in [*feature_names, BASE]])
    return (
        score_vectors(mixed)
        .withColumn("_part", F.explode(parts))
        .groupBy(key, F.col("_part.j").alias("j"))
        .agg(
            (F.sum("_part.part") / permutations).alias("phi"),
            F.first(own_value).alias("feature_value"),
        )
        .select(key, F.get(names, F.col("j")).alias("feature"), "feature_value", "phi")
    )


def features_only(attribution: DataFrame) -> DataFrame:
    return attribution.filter(F.col("feature") != BASE)


# --- permutation importance ----------------------------------------------------------------


def with_neighbour(
    df: DataFrame,
    payload: Column,
    repeats: int,
    seed: int = S.SEED,
    key: str = S.ID,
    cuts: int | None = None,
) -> DataFrame:
    """Per repeat a random reordering of ``payload``: adds ``repeat`` and ``neighbour``.

    All rows stand in one random order per repeat, and each takes the payload of the next, the
    last that of the first. The order is cut by the leading digits of a row's place; the last
    row of a cut takes the first payload of the next cut, from a table of one row per repeat and
    cut. So the answer is the same for any number of ``cuts`` (the shuffle partitions by default).
    """
    parts = shuffle_partitions(df.sparkSession)
    cuts = min(cuts or parts, 1 << 16)
    place = F.concat(F.col(key).cast("string"), F.lit(f":shift{seed}:"), F.col("repeat").cast("string"))
    digits = F.conv(F.substring("_place", 1, 4), 16, 10).cast("bigint")
    placed = (
        df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("_place", F.md5(place))
        .withColumn("_cut", F.floor(digits * cuts / 65536).cast("int"))
        .withColumn("_payload", payload)
    )
    firsts = placed.groupBy("repeat", "_cut").agg(F.min_by("_payload", F.struct("_place", key)).alias("_first"))
    by_cut = Window.partitionBy("repeat").orderBy("_cut")
    whole = by_cut.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.when(F.lead("_cut").over(by_cut).isNotNull(), F.lead("_first").over(by_cut)).otherwise(F.first("_first").over(whole))
    borders = firsts.select("repeat", "_cut", after.alias("_after"))
    within = Window.partitionBy("repeat", "_cut").orderBy("_place", key)
    return (
        # The partitioning of the window; a given number keeps the tasks apart although
        # the rows are few bytes, because scoring them is the expensive part.
        placed.repartition(parts, "repeat", "_cut")
        .withColumn("_last", F.lead("_place").over(within).isNull())
        .withColumn("_next", F.lead("_payload").over(within))
        .join(F.broadcast(borders), ["repeat", "_cut"])  # repeats x cuts rows at most
        .withColumn("neighbour", F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next")))
        .drop("_cut", "_place", "_payload", "_last", "_next", "_after")
    )


def _importance(base: DataFrame, permuted: DataFrame, top_n: int | None) -> DataFrame:
    return importance_table(base, roc_auc(permuted, ["feature", "repeat"]), top_n)


def importance_table(base: DataFrame, areas: DataFrame, top_n: int | None) -> DataFrame:
    """Drop of the AUC per feature, from ``areas`` (feature, repeat, roc_auc): mean and population deviation over the repeats."""
    drops = areas.withColumn("drop", roc_auc(base).scalar() - F.col("roc_auc"))
    table = (
        drops.groupBy("feature")
        .agg(
            half_even(F.avg("drop"), 6).alias("importance_mean"),
            half_even(F.stddev_pop("drop"), 6).alias("importance_std"),
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )
    return table if top_n is None else table.limit(top_n)


def permutation_importance(
    df: DataFrame,
    scorer: Scorer,
    features: list[str],
    n_repeats: int = 10,
    top_n: int | None = SUMMARY_ROWS,
    seed: int = S.SEED,
    key: str = S.ID,
) -> DataFrame:
    """(feature, importance_mean, importance_std) of named input columns."""
    df = df.select(key, S.LABEL, *features)
    shifted = with_neighbour(df, F.struct(*features), n_repeats, seed, key)
    permuted = shifted.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    permuted = permuted.withColumns(
        {
            name: F.when(F.col("feature") == name, F.col("neighbour")[name]).otherwise(F.col(name))
            for name in features
        }
    )
    columns = [S.LABEL, S.PROBABILITY]
    return _importance(
        scorer(df).select(*columns),
        scorer(permuted).select("feature", "repeat", *columns),
        top_n,
    )


def vector_permutation_importance(
    df: DataFrame,
    score_vectors: Scorer,
    feature_names: list[str],
    n_repeats: int = 10,
    top_n: int | None = SUMMARY_ROWS,
    seed: int = S.SEED,
    key: str = S.ID,
) -> DataFrame:
    """The same for every slot of the vector column ``features``."""
    columns = [S.LABEL, S.PROBABILITY]
    # Most swaps of a level's column are between equal values and leave the row's own score.
    own = score_vectors(df.select(key, S.LABEL, "features")).select(key, *columns, vector_to_array("features").alias("x"))
    slots = F.sequence(F.lit(0), F.lit(len(feature_names) - 1))
    names = F.array(*[F.lit(name) for name in feature_names])
    mixture = F.transform(
        "x", lambda value, i: F.when(i == F.col("slot"), F.get("neighbour", i)).otherwise(value)
    )
    swapped = with_neighbour(own, F.col("x"), n_repeats, seed, key)
    swapped = swapped.withColumn("_unlike", F.filter(slots, lambda i: ~F.get("x", i).eqNullSafe(F.get("neighbour", i))))
    permuted = (
        swapped.withColumn("slot", F.explode("_unlike"))
        .select(S.LABEL, "repeat", F.get(names, F.col("slot")).alias("feature"), array_to_vector(mixture).alias("features"))
    )
    kept = swapped.withColumn("slot", F.explode(F.array_except(slots, F.col("_unlike")))).select(
        F.get(names, F.col("slot")).alias("feature"), "repeat", *columns
    )
    return _importance(
        own.select(*columns),
        score_vectors(permuted).select("feature", "repeat", *columns).unionByName(kept),
        top_n,
    )

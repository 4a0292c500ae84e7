import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.operators import explain, score
from ebbtide.operators.clean import with_label
from ebbtide.operators.evaluate import roc_auc
from ebbtide.operators.score import rule_scorer
from ebbtide.sources.subscribers import subscribers


@pytest.fixture(scope="module")
def table(spark, sf):
    return subscribers(spark, sf).persist()


@pytest.fixture(scope="module")
def entries(table):
    return explain.linear_entries(table).persist()


def test_linear_attribution_adds_up_to_the_score(table, entries):
    scores = {r[0]: r[1] for r in table.select(S.ID, score.rule_score(table)).collect()}
    for row in entries.collect():
        total = row["base"] + sum(e["phi"] for e in row["entries"])
        assert total == pytest.approx(scores[row[S.ID]], abs=1e-7)


def test_waterfall_adds_up_and_is_ordered(entries):
    lines = {}
    for r in explain.waterfall(entries, rows=4).collect():
        lines.setdefault(r[S.ID], []).append((r["position"], r["feature"], r["phi"]))
    for row in entries.collect():
        own = sorted(lines[row[S.ID]])
        assert [p for p, _, _ in own] == [0, 1, 2, 3, 4, 5] and own[-1][1] == "rest"
        sizes = [abs(phi) for _, _, phi in own[1:-1]]
        assert sizes == sorted(sizes, reverse=True)
        assert sum(phi for _, _, phi in own) == pytest.approx(
            row["base"] + sum(e["phi"] for e in row["entries"]), abs=1e-5
        )


def test_waterfall_without_a_rest(entries):
    assert {r["feature"] for r in explain.waterfall(entries).collect()}.isdisjoint({"rest"})


def test_summary_and_dependence(table):
    attribution = explain.linear_attribution(table).persist()
    summary = explain.attribution_summary(attribution, 3).collect()
    assert len(summary) == 3 and summary[0]["mean_abs_phi"] >= summary[-1]["mean_abs_phi"]
    chosen = explain.dependence(attribution, features=["tenure"]).collect()
    assert sum(r["n"] for r in chosen) == 150
    by_value = sorted((r["mean_value"], r["mean_phi"]) for r in chosen)
    assert all(a[1] >= b[1] for a, b in zip(by_value, by_value[1:]))
    assert {r["feature"] for r in explain.dependence(attribution).collect()} == {r["feature"] for r in summary}


def test_sample_is_the_same_every_time(table):
    first = {r[S.ID] for r in explain.sample_rows(table, 20).collect()}
    second = {r[S.ID] for r in explain.sample_rows(table.repartition(5), 20).collect()}
    assert first == second and len(first) == 20
    assert explain.sample_rows(table, None).count() == 150


WEIGHTS = [2.0, -1.0, 0.5]


def linear_model(df):
    x = vector_to_array("features")
    return df.withColumn(S.PROBABILITY, sum((x[i] * w for i, w in enumerate(WEIGHTS)), F.lit(0.25)))


@pytest.fixture(scope="module")
def vectors(spark):
    x = F.array(*[(F.xxhash64("id", F.lit(i)) % 100).cast("double") for i in range(3)])
    return spark.range(60).select(
        F.col("id").cast("string").alias(S.ID), (F.col("id") % 2).cast("int").alias(S.LABEL), array_to_vector(x).alias("features")
    ).persist()


def test_sampled_shapley_of_a_linear_model(vectors):
    """Against a single background row the values are exact: w * (x - z)."""
    background = explain.background_rows(vectors, 1)
    z = background.first()["z"]
    found = explain.shapley_sampling(vectors, background, linear_model, ["a", "b", "c"], permutations=3)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r[S.ID], {})[r["feature"]] = (r["phi"], r["feature_value"])
    base = 0.25 + sum(w * v for w, v in zip(WEIGHTS, z))
    assert len(by_id) == 60
    for r in vectors.collect():
        own = by_id[r[S.ID]]
        assert own["base value"][0] == pytest.approx(base)
        for i, name in enumerate("abc"):
            assert own[name][0] == pytest.approx(WEIGHTS[i] * (r["features"][i] - z[i]))
            assert own[name][1] == r["features"][i]


def test_sampled_shapley_adds_up(vectors):
    def curved(df):
        x = vector_to_array("features")
        return df.withColumn(S.PROBABILITY, x[0] * x[1] / 100 + F.abs(x[2]))

    background = explain.background_rows(vectors, 10)
    found = explain.shapley_sampling(vectors, background, curved, ["a", "b", "c"], permutations=4)
    total = {r[0]: r[1] for r in found.groupBy(S.ID).agg(F.sum("phi")).collect()}
    for r in curved(vectors).collect():
        assert total[r[S.ID]] == pytest.approx(r[S.PROBABILITY])


@pytest.mark.parametrize("cuts", [1, 7, 64])
def test_neighbours_are_a_reordering(vectors, cuts):
    shifted = explain.with_neighbour(vectors.select(S.ID), F.col(S.ID), 3, cuts=cuts).collect()
    for repeat in range(3):
        own = [r for r in shifted if r["repeat"] == repeat]
        assert sorted(r["neighbour"] for r in own) == sorted(r[S.ID] for r in own)
        assert sum(r["neighbour"] == r[S.ID] for r in own) <= len(own) // 4
    orders = [tuple(r["neighbour"] for r in sorted(shifted, key=lambda r: r[S.ID]) if r["repeat"] == k) for k in range(3)]
    assert len(set(orders)) == 3
    one = explain.with_neighbour(vectors.select(S.ID), F.col(S.ID), 3, cuts=1).collect()
    assert {(r["repeat"], r[S.ID]): r["neighbour"] for r in shifted} == {(r["repeat"], r[S.ID]): r["neighbour"] for r in one}


def test_importance_of_an_unused_column_is_zero(table):
    df = with_label(table)
    names = ["Contract", "tenure", "gender"]
    found = {r["feature"]: r for r in explain.permutation_importance(with_all(df), with_rest(df), names, 2).collect()}
    assert found["gender"]["importance_mean"] == 0.0 and found["gender"]["importance_std"] == 0.0
    assert found["Contract"]["importance_mean"] > 0


def with_all(df):
    return df


def with_rest(df):
    """A scorer that sees only the permuted columns; the other rule inputs are fixed."""
    fixed = {
        "InternetService": "DSL", "OnlineSecurity": "Yes", "TechSupport": "Yes", "Partner": "No", "Dependents": "No",
    }

    def scorer(rows):
        rows = rows.withColumns({name: F.lit(value) for name, value in fixed.items()})
        return rule_scorer(rows.withColumns({"MonthlyCharges": F.lit(50.0), "SeniorCitizen": F.lit(0)}))

    return scorer


def test_vector_importance_finds_the_driving_slot(vectors):
    labelled = linear_model(vectors).withColumn(S.LABEL, (F.col(S.PROBABILITY) > 0).cast("int"))
    assert roc_auc(labelled).first()[0] == 1.0
    found = explain.vector_permutation_importance(labelled, linear_model, ["a", "b", "c"], 2).collect()
    assert [r["feature"] for r in found][0] == "a" and found[0]["importance_mean"] > found[-1]["importance_mean"]


def test_only_unlike_values_are_scored(spark):
    """Vectors that agree in all slots but one: mixtures of equal values were scored over and over."""
    seen = []

    def watched(df):
        seen.append(df)
        return linear_model(df)

    flat = spark.range(20).select(
        F.col("id").cast("string").alias(S.ID), (F.col("id") % 2).cast("int").alias(S.LABEL),
        array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(2.0))).alias("features"),
    )
    background = explain.background_rows(flat.filter(f"{S.ID} = '3'"), 1)
    shares = explain.shapley_sampling(flat, background, watched, ["a", "b", "c"], permutations=2).collect()
    assert seen[-1].count() == 2 * (2 * 19 + 1)
    assert len(shares) == 20 * 4
    for r in shares:
        wanted = {"a": 2.0 * (int(r[S.ID]) - 3), "base value": 0.25 + 6.0 - 1.0 + 1.0}.get(r["feature"], 0.0)
        assert r["phi"] == pytest.approx(wanted)
    found = explain.vector_permutation_importance(flat, watched, ["a", "b", "c"], 2).collect()
    assert seen[-1].count() == 2 * 20 and {r["feature"] for r in found} == {"a", "b", "c"}

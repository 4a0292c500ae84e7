import pytest
from pyspark.sql import functions as F

from ebbtide import schema as S
from ebbtide.operators import split


@pytest.fixture(scope="module")
def labelled(spark):
    """200 rows, 50 positives."""
    return spark.range(200).select(
        F.format_string("r%04d", "id").alias(S.ID), (F.col("id") % 4 == 0).cast("int").alias(S.LABEL)
    )


def test_exact_counts_per_label(labelled):
    train, test = split.split_data(labelled)
    assert (train.count(), test.count()) == (160, 40)
    assert train.agg(F.avg(S.LABEL)).first()[0] == test.agg(F.avg(S.LABEL)).first()[0] == 0.25


def test_no_overlap_and_nothing_lost(labelled):
    train, test = split.split_data(labelled)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 200


@pytest.mark.parametrize("slots", [1, 3, 65536])
def test_exact_split_takes_the_smallest_draws(labelled, slots):
    chosen = split.stratified_split(labelled, 0.3, slots=slots).collect()
    draws = labelled.select(S.ID, split.uniform(S.ID, "split42").alias("u")).collect()
    draw = {r[0]: r["u"] for r in draws}
    for label, size in ((0, 45), (1, 15)):
        ordered = sorted((draw[r[S.ID]], r[S.ID], r["is_test"]) for r in chosen if r[S.LABEL] == label)
        assert [flag for _, _, flag in ordered] == [True] * size + [False] * (len(ordered) - size)


def test_split_does_not_depend_on_partitioning(labelled):
    first = {r[0] for r in split.split_data(labelled)[1].collect()}
    second = {r[0] for r in split.split_data(labelled.repartition(7))[1].collect()}
    assert first == second


def test_hash_split_is_close(labelled):
    counts = {r["is_test"]: r for r in split.split_counts(split.hash_split(labelled)).collect()}
    assert 20 <= counts[True]["n"] <= 60 and counts[True]["n"] + counts[False]["n"] == 200


def test_folds(labelled):
    folds = split.assign_folds(labelled, 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert all(20 <= r["count"] <= 60 for r in folds)


@pytest.mark.parametrize("slots", [1, 7, 65536])
def test_folds_are_stratified_and_follow_the_draws(labelled, slots):
    dealt = split.assign_folds(labelled.repartition(5), 3, slots=slots).collect()
    assert len(dealt) == 200
    draw = {r[0]: r["u"] for r in labelled.select(S.ID, split.uniform(S.ID, "fold42").alias("u")).collect()}
    for label in (0, 1):
        ordered = sorted((draw[r[S.ID]], r[S.ID], r["fold"]) for r in dealt if r[S.LABEL] == label)
        assert [fold for _, _, fold in ordered] == [i % 3 for i in range(len(ordered))]


def test_weights(labelled):
    weights = {r[S.LABEL]: (r["n"], r["weight"]) for r in split.class_weights(labelled).collect()}
    assert weights == {0: (150, 200 / 300), 1: (50, 2.0)}
    row = split.add_class_weights(labelled).filter("label = 1").first()
    assert (row["weight_none"], row["weight_balanced"], row["weight_pos_3"]) == (1.0, 2.0, 3.0)
    row = split.add_class_weights(labelled).filter("label = 0").first()
    assert (row["weight_balanced"], row["weight_pos_3"]) == (200 / 300, 1.0)

import pytest
from check import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from ebbtide.catalog.tree_twins import TREE_ORACLES
from ebbtide.shared import shared_dir, stored


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


# The encoding queries and the trees number every level, and the smallest table does not have them all.
NEEDS_ALL_LEVELS = {"aligned_matrix", "processed_round_trip", *TREE_ORACLES}
# One query of each kind of fit; `python check.py` compares them all.
FITS = {"tree_nodes", "gbt_metrics", "tree_attribution", "model_whatif"}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - (set(TREE_ORACLES) - FITS)))
def test_query_equals_its_sql_twin(spark, con, sf, name):
    if name in NEEDS_ALL_LEVELS:
        sf = "/root/testdata/sf0.01"
        con = duck(sf)
    assert compare(spark, con, name, sf).startswith("ok")


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() == 150


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark, "x").startswith(root or "/")
    df = spark.range(5).selectExpr("id * 2 AS v")
    assert sorted(r[0] for r in stored(df).collect()) == [0, 2, 4, 6, 8]


def test_whole_grids_equal_their_recursive_twin(spark, monkeypatch):
    """What the comparison does, on grids with several values of the parameters but few trees."""
    from ebbtide.catalog import queries as Q
    from ebbtide.catalog import tree_twins as W

    grids = {
        "random_forest": {
            "n_estimators": [1, 2], "max_depth": [None, 3], "min_samples_split": [2], "min_samples_leaf": [1, 30],
            "max_features": ["log2"], "class_weight": ["balanced", None],
        },
        "boosted_a": {
            "n_estimators": [1, 2], "max_depth": [1, 2], "learning_rate": [0.3], "subsample": [0.7], "colsample_bytree": [0.7, 1.0],
            "scale_pos_weight": [2],
        },
        "boosted_b": {
            "n_estimators": [1, 2], "max_depth": [-1], "learning_rate": [0.3], "num_leaves": [3, 4], "subsample": [1.0],
            "class_weight": ["balanced", None],
        },
    }
    assert Q.WHOLE_GRIDS == W.WHOLE_GRIDS
    sf = "/root/testdata/sf0.01"
    ours = sorted(tuple(row) for row in Q.searched(spark, sf, *grids, grids=grids).collect())
    assert ours == sorted(duck(sf).execute(W.whole_metrics(grids) + " SELECT * FROM metrics").fetchall())

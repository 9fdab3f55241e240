"""The tree over cells against Spark's tree, and the same tree whatever is grown where."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlytics.operators import celltree, regress, stats

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 1500
    a, b, c = rng.integers(0, 60, n), rng.normal(size=n), rng.integers(0, 4, n)
    y = np.where(a > 20, 3.0 * c, b) + rng.normal(scale=0.2, size=n)
    data = [(i, float(p), float(q), float(r), float(s)) for i, (p, q, r, s) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(data + data[:100], "id long, a double, b double, c double, y double")


def test_shallow_tree_is_sparks(rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from postlytics.operators.sampling import hash_split
    d = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(hash_split(rows, "id", 0.25, 42, "_test"))
    model = DecisionTreeRegressor(labelCol="y", maxDepth=4, seed=42).fit(d.where("not _test"))
    want = stats.regression_metrics(model.transform(d.where("_test")), "y", "prediction").first()
    got = regress.decision_tree_r2(rows, FEATURES, "y", "id", max_depth=4).first()
    assert got.n == want.n and all(math.isclose(got[c], want[c], rel_tol=1e-9) for c in ("r2", "mse", "rmse", "mae"))


def test_same_tree_with_nodes_grown_from_the_top(rows, monkeypatch):
    """No node's cells in one task above the limit, the same predictions."""
    d = rows.withColumn("_test", F.col("id") % 4 == 0).localCheckpoint()
    whole = celltree.predicted_cells
    got = []
    for limit in (celltree.LOCAL_CELLS, 40):
        monkeypatch.setattr(celltree, "predicted_cells", lambda cells, k, depth: whole(cells, k, depth, limit))
        out = celltree.tree_predictions(d, FEATURES, "y", "_test", 30, 1).collect()
        got.append(sorted((r.y, round(r.prediction, 9)) for r in out))
    assert got[0] == got[1] and len(got[0]) == d.where("_test").count()
    assert len({p for _, p in got[0]}) > 150


def test_limits_of_a_tree():
    bins = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    sums = np.array([[2, 2.0, 2.0], [1, 5.0, 25.0], [1, 9.0, 81.0], [0, 0.0, 0.0]])
    assert np.allclose(celltree.grow(bins, sums, 0), 4.0)
    assert np.allclose(celltree.grow(bins, sums, 30), [1, 5, 9, 9])   # an empty cell goes its way
    assert np.allclose(celltree.thresholds(np.array([1.0, 1.0, 3.0])), [2.0])
    assert len(celltree.thresholds(np.arange(10_000.0))) == 31
    assert len(celltree.thresholds(np.ones(5))) == 0


def test_large_leaf_is_no_group(spark, monkeypatch):
    """A label that is constant over more cells than a task may grow."""
    d = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), F.floor(F.col("id") / 20).cast("double").alias("b"),
                                F.lit(2.0).alias("y"), (F.col("id") % 3 == 0).alias("_test")).localCheckpoint()
    whole = celltree.predicted_cells
    monkeypatch.setattr(celltree, "predicted_cells", lambda cells, k, depth: whole(cells, k, depth, 50))
    monkeypatch.setattr(celltree, "grow", None)
    out = celltree.tree_predictions(d, ["a", "b"], "y", "_test", 30, 1).collect()
    assert len(out) == 134 and {r.prediction for r in out} == {2.0}

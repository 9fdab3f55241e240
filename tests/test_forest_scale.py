"""Forests at size: what is evaluated once a leaf, a cell or a table, and not once a row."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from postlytics.operators import forest


def _tree(rng, x, depth):
    """A random tree over the rows of ``x``; a feature is split again on the same way."""
    t = {c: [] for c in ("left", "right", "feat", "thr", "cover", "pred")}

    def add(rows, left):
        i = len(t["left"])
        for c, v in dict(left=-1, right=-1, feat=0, thr=0.0, cover=float(len(rows)), pred=rng.normal()).items():
            t[c].append(v)
        f = int(rng.integers(x.shape[1]))
        below = x[rows, f] <= np.median(x[rows, f])
        if left and below.any() and not below.all():
            t["feat"][i], t["thr"][i] = f, float(np.median(x[rows, f]))
            t["left"][i], t["right"][i] = add(rows[below], left - 1), add(rows[~below], left - 1)
        return i

    add(np.arange(len(x)), depth)
    return {c: np.array(v) for c, v in t.items()}


def _expected(t, node, row, known):
    """The tree's mean where only the features ``known`` are."""
    if t["left"][node] < 0:
        return t["pred"][node]
    sides = t["left"][node], t["right"][node]
    if t["feat"][node] in known:
        return _expected(t, sides[0 if row[t["feat"][node]] <= t["thr"][node] else 1], row, known)
    return sum(t["cover"][s] * _expected(t, s, row, known) for s in sides) / t["cover"][node]


def test_path_shap_is_the_shapley_value():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    t = _tree(rng, x, 5)
    rows = np.vstack([rng.normal(size=(5, 4)), [-np.inf, np.inf, np.nan, 0.0]])
    got = forest.path_shap(forest.leaf_paths(t), t["pred"][:, None], rows, 4)[:, :, 0]
    for row, phi in zip(rows, got):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = sum(math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                       * (_expected(t, 0, row, {*s, f}) - _expected(t, 0, row, set(s)))
                       for n in range(4) for s in itertools.combinations(others, n))
            assert math.isclose(phi[f], want, abs_tol=1e-12)


def test_shap_weights_are_made_once_a_pattern_not_once_a_row(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 5))
    made = []
    t = _tree(rng, x[:500], 6)
    paths, weights = forest.leaf_paths(t), forest.shapley_weights
    monkeypatch.setattr(forest, "shapley_weights", lambda share, follows: made.append(weights(share, follows)) or made[-1])
    forest.path_shap(paths, t["pred"][:, None], x, 5)
    assert sum(m[..., 0].size for m in made) == sum(1 << len(p[1]) for p in paths)


def test_shap_of_leaves_with_many_features(monkeypatch):
    """Patterns that occur, in place of all 2^d of them, give the same."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    t = _tree(rng, x, 7)
    paths = forest.leaf_paths(t)
    want = forest.path_shap(paths, t["pred"][:, None], x, 6)
    monkeypatch.setattr(forest, "PATTERN_FEATURES", 2)
    assert np.allclose(forest.path_shap(paths, t["pred"][:, None], x, 6), want, atol=1e-12)


def test_a_fit_computes_its_rows_once(spark):
    """The rows behind a fit are made once, whatever the learner's passes; nothing stays held."""
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    rows = [(float(i % 7), float(i % 5), float(1 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(2)
    d = forest.prepare(df.mapInArrow(counted, df.schema), ["a", "b"], "y", "regressor")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    forest.fit_forest(d, "y", "regressor", {"numTrees": 3, "maxDepth": 3})
    assert scans.value == 200
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_the_registered_regressor_search_is_the_whole_one(spark, monkeypatch):
    """Ten draws from the reference's 216 points and five folds, over all rows of the training side."""
    from inspect import signature
    from postlytics.plans import catalog, fixed
    seen, whole = {}, signature(forest.random_search)
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, y double")

    def search(*args, **named):
        bound = whole.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return {"numTrees": 1}

    monkeypatch.setattr(catalog, "_forest_data", lambda *_: (train, None, ["x"], "y"))
    monkeypatch.setattr(forest, "random_search", search)
    monkeypatch.setattr(forest, "cv_scores", lambda *_, **__: spark.createDataFrame([(0.5, 0.1)], "cv_r2 double, cv_mse double"))
    assert catalog.spark_queries()["forest_search_regressor"](spark, "unread").first()["params"] == "[('numTrees', 1)]"
    grid = seen["grid"] or fixed.FOREST_GRID
    assert seen["train"] is train and (seen["n_iter"], seen["folds"]) == (10, 5) and grid == fixed.FOREST_GRID

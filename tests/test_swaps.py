"""Permutation importance: coded rows, swapped predictions, inverse permutations."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from postlytics.operators import forest, permute, swaps


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 101, 4099])
def test_inverse_permutation(n):
    keys, i = permute.round_keys(n), np.arange(n)
    there = permute.permuted_numbers(i, n, keys)
    assert sorted(there) == i.tolist()
    assert (permute.permuted_numbers(there, n, keys, inverse=True) == i).all()


def test_permuted_by_a_column_of_keys(spark):
    keys = [permute.round_keys(s) for s in (1, 2)]
    df = spark.createDataFrame([(i, keys[i % 2]) for i in range(50)] + [(None, keys[0]), (3, None)], "i long, k array<long>")
    got = [r[0] for r in df.select(permute.permuted(F.col("i"), 70, F.col("k"))).collect()]
    assert got == [int(permute.permuted_numbers(np.array([i]), 70, keys[i % 2])[0]) for i in range(50)] + [None, None]


def _rows(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 1.0, 2.0, 5.0]), r.gauss(0, 1), r.choice("abcde")) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, a * b + ord(c) % 3, float((a > 1) + (c == "b") + (b * a > 0.7 or b < -1.1))) for i, a, b, c in rows],
                               "id long, a double, b double, c string, y double, cls double")
    return StringIndexer(inputCol="c", outputCol="cat").fit(df).transform(df).drop("c").repartition(5)


def _by_hand(model, df, features, label, kind, repeats, seed=42):
    """Every swapped row predicted by the model itself."""
    rows = [r.asDict() for r in df.orderBy("id").collect()]
    n, score = len(rows), {}
    for r in range(repeats):
        source = permute.permuted_numbers(np.arange(n), n, permute.round_keys(seed * 1000 + r))
        for f in [None, *features]:
            moved = [x | ({f: rows[s][f]} if f else {}) for x, s in zip(rows, source.tolist())]
            part = df.sparkSession.createDataFrame([tuple(float(x[c]) for c in [*features, label]) for x in moved],
                                                   ", ".join(f"{c} double" for c in [*features, label]))
            p = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(part)).toPandas()
            y, z = p[label], p["prediction"]
            score[f, r] = float((y == z).mean()) if kind == "classifier" else 1 - float(((y - z) ** 2).mean()) / float(y.var(ddof=0))
    out = {}
    for f in features:
        drop = [score[None, r] - score[f, r] for r in range(repeats)]
        out[f] = (float(np.mean(drop)), float(np.std(drop)))
    return out


@pytest.mark.parametrize("kind, masked", [("regressor", True), ("regressor", False), ("classifier", True), ("classifier", False)])
def test_importance_is_that_of_the_model_on_swapped_rows(spark, monkeypatch, kind, masked):
    monkeypatch.setattr(swaps, *(("_WORD", 7) if masked else ("MASK_LEAVES", 0)))
    monkeypatch.setattr(forest, "SWAP_ROWS", 37)
    df, features, label = _rows(spark), ["a", "b", "cat"], "y" if kind == "regressor" else "cls"
    d = forest.prepare(df, features, label, kind)
    m = forest.fit_forest(d, label, kind, {"numTrees": 6, "maxDepth": 8})
    assert max(t.numNodes for t in m.trees) > 29  # more than two words of leaves
    want = _by_hand(m, d.select("id", *features, label), features, label, kind, 2)
    got = forest.permutation_importance(m, d, features, label, kind, repeats=2, id_col="id")
    # no join of each repeat's rows with their donors, no row-wise rounds
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "_src" not in plan
    rows = got.collect()
    assert {r.feature for r in rows} == set(features)
    for r in rows:
        assert math.isclose(r.importance_mean, want[r.feature][0], abs_tol=1e-9)
        assert math.isclose(r.importance_std, want[r.feature][1], abs_tol=1e-9)


def test_importance_without_rows_and_with_unknown_labels(spark):
    df, features = _rows(spark), ["a", "b", "cat"]
    m = forest.fit_forest(forest.prepare(df, features, "y", "regressor"), "y", "regressor", {"numTrees": 3, "maxDepth": 3})
    assert forest.permutation_importance(m, df.limit(0), features, "y", "regressor", repeats=2, id_col="id").collect() == []
    some = df.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")))
    got = forest.permutation_importance(m, some, features, "y", "regressor", repeats=2, id_col="id").collect()
    assert all(math.isfinite(r.importance_mean) for r in got) and len(got) == 3


def test_search_and_scores_hold_only_what_the_fits_read(spark, monkeypatch):
    d = forest.prepare(_rows(spark), ["a", "b"], "y", "regressor")
    seen, fit = [], forest.fit_forest
    monkeypatch.setattr(forest, "fit_forest", lambda train, *rest: seen.append(set(train.columns)) or fit(train, *rest))
    grid = {"n_estimators": [2], "max_depth": [2], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    best = forest.random_search(d, "y", "regressor", "id", n_iter=1, folds=2, grid=grid)
    assert forest.cv_scores(d, "y", "regressor", best, "id", folds=2).count() == 1
    assert len(seen) >= 4 and all(columns == {"features", "y", "_fold"} for columns in seen)

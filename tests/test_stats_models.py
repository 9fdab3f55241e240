"""Statistics and models against numpy identities."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlytics.operators import distributions as dist
from postlytics.operators import regress, stats


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(5)
    n = 400
    x1 = rnd.normal(size=n)
    x2 = rnd.normal(size=n)
    x3 = x1 * 0.9 + rnd.normal(scale=0.3, size=n)
    y = 1.5 + 2 * x1 - x2 + rnd.normal(scale=0.5 + np.abs(x1), size=n)
    rows = [(i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, y double"), (x1, x2, x3, y)


def test_distributions():
    assert abs(dist.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(dist.t_two_sided(2.228138851986274, 10) - 0.05) < 1e-9
    assert abs(dist.f_sf(4.102821015130399, 2, 10) - 0.05) < 1e-9
    assert abs(dist.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9


def test_vif_uncentred(spark, data):
    df, (x1, x2, x3, _) = data
    got = {r.feature: r.vif for r in stats.vif(df, ["x1", "x2", "x3"]).collect()}
    X = np.column_stack([x1, x2, x3])
    for i, name in enumerate(["x1", "x2", "x3"]):
        others = np.delete(X, i, axis=1)
        beta = np.linalg.lstsq(others, X[:, i], rcond=None)[0]
        ssr = ((X[:, i] - others @ beta) ** 2).sum()
        r2 = 1 - ssr / (X[:, i] ** 2).sum()          # uncentred, no intercept
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-9)


def test_standardise_constant_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = stats.standardise(df, ["a", "c"]).collect()
    assert [round(r.a, 9) for r in out] == [round(v, 9) for v in (-1.224744871, 0.0, 1.224744871)]
    assert [r.c for r in out] == [0.0, 0.0, 0.0]


def test_durbin_watson(spark, data):
    df, (*_, y) = data
    dw = stats.durbin_watson(df, "y", ["id"]).first()[0]
    assert math.isclose(dw, (np.diff(y) ** 2).sum() / (y ** 2).sum(), rel_tol=1e-9)
    assert 0 <= dw <= 4


def test_breusch_pagan_matches_auxiliary_regression(spark, data):
    df, (x1, x2, _, y) = data
    e = y - y.mean()
    d = df.withColumn("e", F.col("y") - F.lit(float(y.mean())))
    r = stats.breusch_pagan(d, "e", ["x1", "x2"]).first()
    Z = np.column_stack([np.ones_like(x1), x1, x2])
    b = np.linalg.lstsq(Z, e ** 2, rcond=None)[0]
    fit = Z @ b
    r2 = 1 - ((e ** 2 - fit) ** 2).sum() / ((e ** 2 - (e ** 2).mean()) ** 2).sum()
    assert math.isclose(r.lm, len(y) * r2, rel_tol=1e-7)
    assert math.isclose(r.lm_p_value, dist.chi2_sf(len(y) * r2, 2), rel_tol=1e-6)


def test_pearson_and_spearman(spark, data):
    df, (x1, x2, x3, y) = data
    pl = {(r.x, r.y): r.z for r in stats.pearson_long(df, ["x1", "x3", "y"]).collect()}
    assert math.isclose(pl[("x1", "x3")], np.corrcoef(x1, x3)[0, 1], rel_tol=1e-9)
    assert pl[("y", "y")] == 1.0 and len(pl) == 9
    sp = stats.spearman_long(df, ["x1", "y"]).first()
    rx = np.argsort(np.argsort(x1)); ry = np.argsort(np.argsort(y))
    assert math.isclose(sp.rho, np.corrcoef(rx, ry)[0, 1], rel_tol=1e-9)


def test_lasso_cd_matches_spark(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df, _ = data
    cols = ["x1", "x2", "x3"]
    z = regress.fold_grams(df, cols, "y")[()]
    alpha = regress.alpha_grid(z, 10)[4]
    b0, b = regress.lasso_cd(z, alpha)
    v = VectorAssembler(inputCols=cols, outputCol="f").transform(df)
    m = LinearRegression(featuresCol="f", labelCol="y", elasticNetParam=1.0, regParam=alpha,
                         standardization=False, tol=1e-12, maxIter=2000).fit(v)
    assert np.allclose(b, m.coefficients.toArray(), atol=1e-6) and abs(b0 - m.intercept) < 1e-6


def test_ols_from_gram(spark, data):
    df, (x1, x2, x3, y) = data
    z = regress.fold_grams(df, ["x1", "x2"], "y")[()]
    b0, b = regress.ols_from_gram(z)
    Z = np.column_stack([np.ones_like(x1), x1, x2])
    want = np.linalg.lstsq(Z, y, rcond=None)[0]
    assert np.allclose([b0, *b], want, atol=1e-9)


def test_lasso_report_runs(spark, data):
    df, _ = data
    d = df.withColumn("y", F.exp(F.col("y") / 4))
    rep = regress.lasso_report(d, ["x1", "x2", "x3"], "y", "id", n_alphas=10)
    s = rep["summary"].first()
    assert s.alpha > 0 and s.n == 400 and s.dropped_nonpositive == 0
    assert abs(rep["residual_mean"].first()["mean_residual"]) < 1e-9
    assert 0 <= rep["durbin_watson"].first()[0] <= 4


def test_forest_shap_identity_and_tree_scores(spark, data):
    from postlytics.operators import forest
    df, _ = data
    d = forest.prepare(df, ["x1", "x2", "x3"], "y", "regressor")
    m = forest.fit_forest(d, "y", "regressor", {"numTrees": 4, "maxDepth": 4, "minInstancesPerNode": 2})
    sv = forest.shap_values(m, d, ["x1", "x2", "x3"], "id", "regressor")
    j = sv.join(m.transform(d).select("id", "prediction"), "id")
    r = j.agg(F.max(F.abs(F.col("phi_x1") + F.col("phi_x2") + F.col("phi_x3") + F.col("base") - F.col("output"))).alias("a"),
              F.max(F.abs(F.col("output") - F.col("prediction"))).alias("b")).first()
    assert r.a < 1e-8 and r.b < 1e-8
    scores = {row.tree: row.score for row in forest.per_tree_scores(m, d, "y", "regressor").collect()}
    for i, tree in enumerate(m.trees):
        p = tree.transform(d).select("y", "prediction")
        want = stats.regression_metrics(p, "y", "prediction").first()["r2"]
        assert math.isclose(scores[i], want, rel_tol=1e-9)


def test_shap_of_all_classes_equals_one_class_at_a_time(spark, data):
    from postlytics.operators import forest
    df, _ = data
    feats = ["x1", "x2", "x3"]
    three = df.withColumn("c", F.when(F.col("x1") < -0.3, 0.0).when(F.col("x1") + F.col("x2") < 0.5, 1.0).otherwise(2.0))
    d = forest.prepare(three, feats, "c", "classifier")
    m = forest.fit_forest(d, "c", "classifier", {"numTrees": 3, "maxDepth": 6, "minInstancesPerNode": 1})
    got = {(r.id, r["class"]): r for r in forest.shap_values_by_class(m, d, feats, "id").collect()}
    probability = {r.id: r.probability for r in m.transform(d).select("id", "probability").collect()}
    assert len(got) == 3 * len(probability)
    for cls in range(3):
        for r in forest.shap_values(m, d, feats, "id", "classifier", cls).collect():
            one = got[r.id, cls]
            assert all(math.isclose(one[f"phi_{f}"], r[f"phi_{f}"], abs_tol=1e-9) for f in feats)
            assert math.isclose(one.base, r.base, abs_tol=1e-9) and math.isclose(one.output, probability[r.id][cls], abs_tol=1e-9)
    importance = forest.shap_importance_by_class(m, d, feats, "id").collect()
    assert {(r["class"], r.feature) for r in importance} == {(c, f) for c in range(3) for f in feats}


def test_permutation_importance(spark, data):
    from postlytics.operators import forest
    df, _ = data
    d = forest.prepare(df, ["x1", "x2", "x3"], "y", "regressor")
    m = forest.fit_forest(d, "y", "regressor", {"numTrees": 5, "maxDepth": 5})
    imp = {r.feature: r.importance_mean for r in
           forest.permutation_importance(m, d, ["x1", "x2", "x3"], "y", "regressor", repeats=3).collect()}
    assert imp["x1"] > imp["x2"] > -0.05 and set(imp) == {"x1", "x2", "x3"}


def test_prototype_label(spark):
    from postlytics.operators.classify import prototype_label, prototypes
    rows = [(i, [1.0, 0.1 * i], 0) for i in range(3)] + [(10 + i, [0.0, 1.0 + i], 1) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    out = prototype_label(df, "v", prototypes(df, "v", "label"))
    assert all(r.label == r.predicted_label for r in out.collect())


@pytest.mark.parametrize("labels", [3, 400])
def test_prototype_label_equals_brute_force(spark, labels):
    import numpy as np

    from postlytics.operators import classify
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    y = rng.integers(0, labels, 2000)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    odd = [(-1, None, None), (-2, [0.0] * 64, None), (-3, [1.0], None), (-4, [], None),
           (-5, [None] + [1.0] * 63, None), (-6, [math.nan] * 64, None)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, label int")
    protos = classify.prototypes(df.where("id >= 0"), "v", "label")
    got = {r.id: r.predicted_label for r in classify.prototype_label(df, "v", protos).collect()}
    means = np.array([x[y == c].mean(axis=0) for c in sorted(protos)])
    sims = (x / np.linalg.norm(x, axis=1)[:, None]) @ (means / np.linalg.norm(means, axis=1)[:, None]).T
    assert [got[i] for i in range(2000)] == [sorted(protos)[k] for k in sims.argmax(axis=1)]
    assert all(got[r[0]] is None for r in odd)
    assert {r.s for r in classify.prototype_label(df, "v", {}).select(F.col("similarity").alias("s")).collect()} == {None}


def test_standardised_gram_equals_gram_of_standardised(spark):
    import numpy as np

    from postlytics.operators.regress import fold_grams, standardised_gram
    from postlytics.operators.stats import standardise
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), 5.0, float(y)) for a, b, y in rng.normal([10, -3, 1], [2, 0.5, 1], (300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    cols = ["a", "b", "c"]
    raw = fold_grams(df, cols, "y")[()]
    std = fold_grams(standardise(df, cols), cols, "y")[()]
    assert np.allclose(standardised_gram(raw, raw), std, rtol=1e-9, atol=1e-6)


def test_lasso_scale_in_fold_runs(spark):
    from postlytics.operators.regress import lasso_report
    rows = [(i, float(i % 7), float((i * 3) % 11), 2.0 + (i % 7) * 0.5 + (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    a = lasso_report(df, ["a", "b"], "y", "id", alphas=[0.01, 0.1], diagnostics=False)["summary"].first()
    b = lasso_report(df, ["a", "b"], "y", "id", alphas=[0.01, 0.1], diagnostics=False,
                     scale_in_fold=True)["summary"].first()
    assert a.n == b.n == 400 and 0.2 < b.cv_r2 <= 1 and abs(a.cv_r2 - b.cv_r2) < 0.05


def test_random_search_uses_all_folds(spark, monkeypatch):
    import pyspark.ml.tuning as tuning

    from postlytics.operators import forest
    seen = {}
    real_fit = tuning.CrossValidator.fit

    def spy(self, dataset, params=None):
        seen["numFolds"] = self.getNumFolds()
        seen["folds"] = sorted(r[0] for r in dataset.select("_fold").distinct().collect())
        return real_fit(self, dataset, params)

    monkeypatch.setattr(tuning.CrossValidator, "fit", spy)
    rows = [(i, float(i % 7), float(i % 3), float(i % 5)) for i in range(200)]
    df = forest.prepare(spark.createDataFrame(rows, "id long, a double, b double, y double"), ["a", "b"], "y",
                        "regressor")
    grid = {"n_estimators": [3], "max_depth": [2], "min_samples_split": [2], "min_samples_leaf": [2],
            "max_features": ["sqrt"]}
    forest.random_search(df, "y", "regressor", "id", n_iter=1, folds=5, grid=grid)
    assert seen == {"numFolds": 5, "folds": [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("kind", ["regressor", "classifier"])
def test_nodes_under_the_split_limit_are_not_split(spark, kind):
    """Against a plain walk of the unlimited tree that stops at the first node which
    fewer training rows reach than the limit (no rows are drawn)."""
    from postlytics.operators import forest
    rng = np.random.default_rng(3)
    x = rng.integers(0, 25, (300, 2)).astype(float)
    y = (x[:, 0] * 2 + x[:, 1] > 35).astype(float) if kind == "classifier" else x[:, 0] * x[:, 1]
    df = forest.prepare(spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                              "id long, a double, b double, y double"), ["a", "b"], "y", kind)
    params = {"numTrees": 1, "maxDepth": 12, "featureSubsetStrategy": "all", "bootstrap": False}
    [full] = forest.Trees(forest.fit_forest(df, "y", kind, params), spark).trees
    sizes = set()
    for limit in (2, 10, 40, 1000):
        model = forest.fit_forest(df, "y", kind, params | {"minSamplesSplit": limit})
        got = {r.id: r.prediction for r in model.transform(df).collect()}

        def plain(i, node, rows):
            if full["left"][node] < 0 or len(rows) < limit:
                return full["pred"][node]
            goes = x[rows, full["feat"][node]] <= full["thr"][node]
            side = goes if x[i, full["feat"][node]] <= full["thr"][node] else ~goes
            return plain(i, full["left"][node] if side is goes else full["right"][node], rows[side])

        assert [got[i] for i in range(300)] == [plain(i, 0, np.arange(300)) for i in range(300)]
        sizes.add(model.totalNumNodes)
    assert len(sizes) >= 3 and min(sizes) == 1


def test_all_points_of_the_grid_differ():
    from postlytics.operators import forest
    import itertools
    points = [forest.spark_params(dict(zip(forest.FOREST_GRID, c))) for c in itertools.product(*forest.FOREST_GRID.values())]
    assert len({tuple(sorted(p.items())) for p in points}) == 216


def test_permutation_importance_does_not_depend_on_partitions(spark, data):
    from postlytics.operators import forest
    df, _ = data
    d = forest.prepare(df, ["x1", "x2", "x3"], "y", "regressor")
    m = forest.fit_forest(d, "y", "regressor", {"numTrees": 3, "maxDepth": 4})
    got = [sorted((r.feature, round(r.importance_mean, 9)) for r in forest.permutation_importance(
        m, d.repartition(parts), ["x1", "x2", "x3"], "y", "regressor", repeats=3).collect()) for parts in (1, 16)]
    assert got[0] == got[1]


def test_forest_study_with_string_classes(spark):
    import random
    from postlytics.plans.studies import forest_study
    r = random.Random(5)
    rows = [(i, r.random(), r.random()) for i in range(240)]
    df = spark.createDataFrame([(i, a, b, 1 + 6 * a) for i, a, b in rows], "id long, a double, b double, score double")
    grid = {"n_estimators": [5], "max_depth": [4], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    out = forest_study(df, ["a", "b"], "score", "id", "classifier", n_iter=1, folds=2, grid=grid,
                       permutation_repeats=2, class_breaks=[2, 4])
    imp = {x.feature: x.importance_mean for x in out["permutation_importance"].collect()}
    assert imp["a"] > 0.2 > abs(imp["b"])
    assert out["shap_importance"].count() > 0


def test_spearman_with_one_value_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(900) < 0.4, 0.0, rng.integers(1, 60, 900)).astype(float)
    y = np.round(x * 0.3 + rng.normal(0, 8, 900))
    frame = pd.DataFrame({"x": x, "y": y})
    want = frame.rank().corr().loc["x", "y"]
    for parts in (1, 7):
        r = stats.spearman_long(spark.createDataFrame(frame).repartition(parts), ["x", "y"]).first()
        assert math.isclose(r.rho, want, rel_tol=1e-12)
        assert 0 <= r.p_value < 0.05


def test_spearman_of_a_constant_and_of_no_rows(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert math.isnan(stats.spearman_long(flat, ["x", "y"]).first().rho)
    assert math.isnan(stats.spearman_long(flat.limit(0), ["x", "y"]).first().rho)


def test_average_ranks_match_pandas(spark):
    frame = pd.DataFrame({"v": [3.0, 1.0, 3.0, 3.0, 2.0, 9.0, 1.0]})
    got = {r.v: r["rank"] for r in stats.average_ranks(spark.createDataFrame(frame), "v", num_partitions=3).collect()}
    assert got == dict(zip(frame.v, frame.v.rank()))


def test_vif_of_collinear_and_zero_columns(spark):
    rows = [(float(i), 2.0 * i, float((i * 7) % 11), 0.0) for i in range(1, 30)]
    got = {r.feature: r.vif for r in stats.vif(spark.createDataFrame(rows, "a double, b double, c double, z double"),
                                               ["a", "b", "c", "z"]).collect()}
    assert math.isinf(got["a"]) and math.isinf(got["b"]) and got["c"] >= 1 and math.isnan(got["z"])


def test_normality_reports_a_bound_above_a_tenth(spark):
    from statistics import NormalDist
    near = spark.createDataFrame([(NormalDist().inv_cdf((i + 0.5) / 200),) for i in range(200)], "v double")
    r = stats.normality(near, "v").first()
    assert r.p_is_bound and r.p_value == 0.1
    far = spark.createDataFrame([(float(i % 2),) for i in range(200)], "v double")
    r = stats.normality(far, "v").first()
    assert not r.p_is_bound and r.p_value < 0.001


def test_parts_are_built_when_asked_for():
    from postlytics.operators.parts import Parts
    made = []
    parts = Parts({"a": lambda: made.append("a") or 1, "b": lambda: made.append("b") or 2})
    wider = Parts(parts.makers("x_"))
    assert list(wider) == ["x_a", "x_b"] and not made
    assert wider["x_b"] == 2 and wider["x_b"] == 2 and made == ["b"]


def test_normal_columns_against_the_standard_library(spark):
    from statistics import NormalDist
    from postlytics.functions.normal import normal_cdf, normal_quantile
    ps = [1e-300, 1e-40, 1e-12, 1e-9, 1e-4, 0.02, 0.07, 0.075, 0.2, 0.5, 0.8, 0.925, 0.93, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    got = [r[0] for r in df.select(normal_quantile("p")).collect()]
    assert got[len(ps):] == [None] * 3
    for p, z in zip(ps, got):
        assert abs(z - NormalDist().inv_cdf(p)) <= 1e-12 * abs(z)
    zs = [-37.0, -12.0, -5.7, -5.6, -3.0, -0.7, -0.6, 0.0, 0.6, 0.7, 1.0, 5.7, 9.0]
    for z, (f,) in zip(zs, spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf("z")).collect()):
        assert abs(f - math.erfc(-z / math.sqrt(2)) / 2) <= 1e-13 * f


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_normal_points_and_distance_against_plain_python(spark, parts):
    from statistics import NormalDist, mean, pstdev, stdev
    r = random.Random(parts)
    values = [round(r.gauss(3, 2), 1) for _ in range(400)] + [9.0] * 300  # a third of the rows ties
    rows = [(i, v) for i, v in enumerate(values)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v double").withColumn("rank", F.lit("clash"))
    got = sorted(stats.normal_points(df, "v", "id", parts).collect())
    n = len(values)
    assert [x.rank for x in got] == list(range(1, n + 1)) and [x.sample for x in got] == sorted(values)
    for x in got:
        want = NormalDist().inv_cdf(x.rank / (n + 1))
        assert abs(x.theoretical - want) < 1e-12 and abs(x.line - (mean(values) + pstdev(values) * want)) < 1e-9
    fitted = NormalDist(mean(values), stdev(values))
    steps = [(fitted.cdf(v), i) for i, v in enumerate(sorted(values))]
    want = max(max((i + 1) / n - f, f - i / n) for f, i in steps)
    one = stats.normality_distance(df, "v", parts).first()
    assert abs(one.distance - want) < 1e-12 and one.n == n


def test_normal_plot_of_empty_and_constant_columns(spark):
    none = spark.createDataFrame([(1, None)], "id long, v double")
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, v double")
    assert stats.normal_points(none, "v", "id").count() == 0
    assert stats.normality_distance(none, "v").collect() == [(None, 0)]
    assert stats.normality_distance(same, "v").collect() == [(None, 2)]
    assert [x.line for x in stats.normal_points(same, "v", "id").orderBy("rank").collect()] == [2.0, 2.0]


def test_held_rows_come_in_few_partitions(spark):
    from postlytics.operators.stats import few_partitions
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(8 * cores).persist()
    few = few_partitions(many)
    assert few.rdd.getNumPartitions() == 2 * cores and few.is_cached and not many.is_cached and few.count() == 1000
    assert few_partitions(few) is few  # as many as they need
    few.unpersist()
    wide = spark.range(1000).repartition(8 * cores).persist()
    assert few_partitions(wide, rows=1000 // (4 * cores)).rdd.getNumPartitions() >= 4 * cores

"""Random forests and their explanations.

Models are ``pyspark.ml`` forests.  Per-tree work (best tree, tree mean vs
median, TreeSHAP) reads the saved model's node table -- one row per node with
leftChild, rightChild, split.featureIndex, split.leftCategoriesOrThreshold,
rawCount, prediction, impurityStats -- broadcasts it (its size is the model's,
not the data's) and evaluates all trees over Arrow batches in ``mapInPandas``,
vectorised over the rows of a batch.  Each batch emits partial sums, so only
per-tree or per-feature totals are shuffled.
"""

from __future__ import annotations

import itertools
import random
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlytics.operators import stats
from postlytics.operators.ordering import dense_index
from postlytics.operators.permute import permuted_numbers, round_keys
from postlytics.operators.swaps import CodedForest
from postlytics.plans.fixed import FOREST_GRID
from postlytics.session import ensure_checkpoint_dir, fit_held

MAX_DEPTH_UNLIMITED = 30   # Spark's largest tree depth stands in for "no limit"
MAX_BROADCAST_NODES = 20_000_000  # node rows (all trees) the per-tree operators may broadcast


# --------------------------------------------------------------------------
# fitting and search
# --------------------------------------------------------------------------
def spark_params(p: dict) -> dict:
    """sklearn-style forest parameters -> Spark's, and ``minSamplesSplit``, which
    ``fit_forest`` applies to the fitted trees."""
    out = {}
    if "n_estimators" in p:
        out["numTrees"] = int(p["n_estimators"])
    if "max_depth" in p:
        out["maxDepth"] = MAX_DEPTH_UNLIMITED if p["max_depth"] is None else int(p["max_depth"])
    if "min_samples_split" in p:
        out["minSamplesSplit"] = int(p["min_samples_split"])
    if "min_samples_leaf" in p:
        out["minInstancesPerNode"] = int(p["min_samples_leaf"])
    if "max_features" in p:
        out["featureSubsetStrategy"] = str(p["max_features"])
    return out


def _estimator(kind: str, label: str, seed: int, **params):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    cls = RandomForestClassifier if kind == "classifier" else RandomForestRegressor
    return cls(featuresCol="features", labelCol=label, seed=seed, **params)


def prepare(df: DataFrame, features: list[str], label: str, kind: str) -> DataFrame:
    """Drop rows with null or NaN, assemble ``features``; a string class label is
    indexed alphabetically into ``label_idx``."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    d = df.dropna(subset=features + [label])
    d = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(d)
    if kind == "classifier" and dict(d.dtypes)[label] == "string":
        d = StringIndexer(inputCol=label, outputCol=label + "_idx",
                          stringOrderType="alphabetAsc").fit(d).transform(d)
    return d


class Forest(Estimator):
    """``fit_forest`` as an estimator, so that Spark's cross-validation can search over
    ``settings`` (a dict of Spark's parameters and ``minSamplesSplit``)."""

    def __init__(self, kind: str, label: str, seed: int):
        super().__init__()
        self.kind, self.label, self.seed = kind, label, seed
        self.settings = Param(self, "settings", "parameters of the forest")

    def _fit(self, dataset: DataFrame):
        return fit_forest(dataset, self.label, self.kind, self.getOrDefault(self.settings), self.seed)


def _folded(train: DataFrame, label: str, id_col: str, folds: int, stratify: str | None) -> DataFrame:
    """``features``, ``label`` and ``_fold`` of ``train``: what the fits and scores read.  Spark's
    cross-validation holds both sides of each fold, so the ids and raw columns stay behind."""
    from postlytics.operators.sampling import with_folds
    narrow = train.select(*dict.fromkeys([id_col, "features", label]))
    return with_folds(narrow, folds, [id_col], stratify=stratify, name="_fold").select("features", label, "_fold")


def random_search(train: DataFrame, label: str, kind: str, id_col: str, n_iter: int = 10,
                  folds: int = 5, grid: dict | None = None, seed: int = 42,
                  parallelism: int = 4) -> dict:
    """``n_iter`` seeded draws (without replacement) from the whole grid, mapped
    to Spark parameters, each scored by ``folds``-fold cross-validation (contiguous
    folds for regressors, stratified for classifiers); up to ``parallelism``
    candidate models are fitted at once (concurrent Spark jobs).  Returns the
    best parameter dict, for ``fit_forest``."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator
    grid = grid or FOREST_GRID
    points = [dict(zip(grid, combo)) for combo in itertools.product(*grid.values())]
    draws = [spark_params(p) for p in random.Random(seed).sample(points, min(n_iter, len(points)))]
    est = Forest(kind, label, seed)
    strat = label if kind == "classifier" else None
    d = _folded(train, label, id_col, folds, strat)
    ev = (MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if kind == "classifier"
          else RegressionEvaluator(labelCol=label, metricName="r2"))
    cv = CrossValidator(estimator=est, estimatorParamMaps=[{est.settings: p} for p in draws], evaluator=ev, foldCol="_fold",
                        numFolds=folds, seed=seed, parallelism=max(1, min(parallelism, len(draws))))
    return draws[int(np.argmax(cv.fit(d).avgMetrics))]


def fit_forest(train: DataFrame, label: str, kind: str, params: dict, seed: int = 42):
    """L7/L8.  ``minSamplesSplit`` in ``params``: a node of fewer training rows is not split."""
    params = dict(params)
    limit = params.pop("minSamplesSplit", 2)
    model = fit_held(_estimator(kind, label, seed, **params), train, label)
    return split_limited(model, limit, train.sparkSession)


def split_limited(model, limit: int, spark: SparkSession):
    """The forest whose nodes of fewer than ``limit`` training rows (copies drawn for
    the tree count) are leaves: a split depends on the rows of its own node and its
    drawn features only, so cutting small nodes off afterwards equals never splitting
    them, but for which features are drawn elsewhere.  The node table is cut with
    joins and windows (a tree a window) and loaded back as a model."""
    if limit <= 2:   # a node that was split holds two rows or more
        return model
    old, new = _saved(model, spark), _scratch(spark)
    nodes = spark.read.parquet(f"{old}/data").select("treeID", "nodeData.*")
    small = F.col("rawCount") < limit
    # a node has no more rows than its parent: all below a small node have a small parent
    below = nodes.where(small & (F.col("leftChild") >= 0)).select(
        "treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"))
    place = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1
    kept = nodes.join(below, ["treeID", "id"], "left_anti").withColumn("_new", place)
    places = kept.select("treeID", F.col("id").alias("rightChild"), F.col("_new").alias("_right"))
    kept = kept.join(places, ["treeID", "rightChild"], "left")
    leaf = small | (F.col("leftChild") < 0)
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                    F.lit(-1).alias("numCategories"))
    # ids run in preorder, so a left child stands right behind its parent
    data = kept.select("treeID", F.struct(
        F.col("_new").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
        F.when(leaf, -1.0).otherwise(F.col("gain")).alias("gain"),
        F.when(leaf, -1).otherwise(F.col("_new") + 1).alias("leftChild"),
        F.when(leaf, -1).otherwise(F.col("_right")).alias("rightChild"),
        F.when(leaf, none).otherwise(F.col("split")).alias("split")).alias("nodeData"))
    data.write.parquet(f"{new}/data")
    spark.read.text(f"{old}/metadata").coalesce(1).write.text(f"{new}/metadata")
    spark.read.parquet(f"{old}/treesMetadata").write.parquet(f"{new}/treesMetadata")
    loaded = type(model).load(new)
    for path in (old, new):
        _delete(path, spark)
    return loaded


def split_account(model, df: DataFrame, limit: int) -> DataFrame:
    """Of each tree of ``split_limited`` by ``limit``: ``small_splits`` (split nodes of
    under ``limit`` training rows), ``cut`` (it has fewer nodes than before) and ``n``
    (rows of ``df`` that reach one of its leaves)."""
    spark = df.sparkSession
    before, after = Trees(model, spark).trees, Trees(split_limited(model, limit, spark), spark).trees
    bc = spark.sparkContext.broadcast(after)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _features_matrix(pdf)
                yield pd.DataFrame([(i, int((t["left"][tree_leaf(t, x)] < 0).sum())) for i, t in enumerate(bc.value)],
                                   columns=["tree", "n"])

    rows = [(i, int(((t["left"] >= 0) & (t["cover"] < limit)).sum()), len(t["left"]) < len(b["left"]))
            for i, (b, t) in enumerate(zip(before, after))]
    reached = df.select(_as_array()).mapInPandas(run, "tree int, n long").groupBy("tree").agg(F.sum("n").alias("n"))
    nodes = spark.createDataFrame(rows, "tree int, small_splits long, cut boolean")
    return nodes.join(reached, "tree", "left").select("tree", "small_splits", "cut", F.coalesce("n", F.lit(0)).alias("n"))


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"


def _saved(model, spark) -> str:
    """The folder, in the shared checkpoint folder, that ``model`` is written to."""
    path = _scratch(spark)
    model.write().save(path)
    return path


def _delete(path: str, spark) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cv_scores(train: DataFrame, label: str, kind: str, params: dict, id_col: str, folds: int = 3,
              seed: int = 42) -> DataFrame:
    """``folds``-fold mean R^2 and MSE (regressor) or accuracy (classifier)."""
    strat = label if kind == "classifier" else None
    d = _folded(train, label, id_col, folds, strat)
    rows = []
    for f in range(folds):
        m = fit_forest(d.where(F.col("_fold") != f), label, kind, params, seed)
        p = m.transform(d.where(F.col("_fold") == f))
        if kind == "classifier":
            rows.append(stats.accuracy(p, label, "prediction").first()["accuracy"])
        else:
            r = stats.regression_metrics(p, label, "prediction").first()
            rows.append((r["r2"], r["mse"]))
    spark = train.sparkSession
    if kind == "classifier":
        return spark.createDataFrame([(float(np.mean(rows)),)], "cv_accuracy double")
    return spark.createDataFrame([(float(np.mean([r[0] for r in rows])), float(np.mean([r[1] for r in rows])))],
                                 "cv_r2 double, cv_mse double")


def impurity_importance(model, features: list[str]) -> DataFrame:
    """Impurity-based importances, largest first."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


# --------------------------------------------------------------------------
# node table
# --------------------------------------------------------------------------
class Trees:
    """Per-tree node arrays of a fitted forest (driver side, model-sized)."""

    def __init__(self, model, spark):
        path = _saved(model, spark)
        data = spark.read.parquet(f"{path}/data")
        n_nodes = data.count()
        if n_nodes > MAX_BROADCAST_NODES:
            # the node arrays are shipped to every task; a forest this large needs
            # fewer or shallower trees (numTrees, maxDepth, minInstancesPerNode)
            raise ValueError(f"forest has {n_nodes} nodes, above MAX_BROADCAST_NODES="
                             f"{MAX_BROADCAST_NODES}; refit with fewer or shallower trees")
        nodes = data.select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
            "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild",
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
            F.col("nodeData.split.numCategories").alias("categories")).toPandas()
        _delete(path, spark)
        self.trees = []
        for tid, g in nodes.groupby("treeID"):
            g = g.sort_values("id")
            n = int(g["id"].max()) + 1
            left = np.full(n, -1, dtype=np.int64)
            right = np.full(n, -1, dtype=np.int64)
            feat = np.zeros(n, dtype=np.int64)
            thr = np.zeros(n)
            pred = np.zeros(n)
            cover = np.zeros(n)
            stats_ = [None] * n
            categories = {}  # of a split over categories: their number and those that go left
            for r in g.itertuples(index=False):
                i = int(r.id)
                left[i], right[i] = int(r.leftChild), int(r.rightChild)
                feat[i] = int(r.feature) if r.leftChild >= 0 else 0
                thr[i] = float(r.thr[0]) if r.leftChild >= 0 and len(r.thr) else 0.0
                pred[i] = float(r.prediction)
                cover[i] = float(r.rawCount)
                stats_[i] = np.asarray(r.impurityStats, dtype=float)
                if r.leftChild >= 0 and r.categories >= 0:
                    categories[i] = (int(r.categories), tuple(int(c) for c in r.thr))
            self.trees.append(dict(left=left, right=right, feat=feat, thr=thr, pred=pred,
                                   cover=cover, stats=stats_, categories=categories))
        self.num_trees = len(self.trees)

    def leaf_values(self, kind: str, cls: int | None = None):
        """Per tree, the value each node predicts: the mean for regression, the
        class-``cls`` share of the node's training rows for classification."""
        out = []
        for t in self.trees:
            if kind == "classifier":
                v = np.array([s[cls] / s.sum() if s is not None and s.sum() > 0 else 0.0
                              for s in t["stats"]])
            else:
                v = t["pred"]
            out.append(v)
        return out


def tree_predict(t: dict, x: np.ndarray) -> np.ndarray:
    """Node-prediction of one tree for each row of ``x`` (rows x features)."""
    return t["pred"][tree_leaf(t, x)]


def tree_leaf(t: dict, x: np.ndarray) -> np.ndarray:
    """The node of one tree that each row of ``x`` ends in."""
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = t["left"][node] >= 0
        if not inner.any():
            break
        f = t["feat"][node]
        go_left = x[np.arange(len(x)), f] <= t["thr"][node]
        nxt = np.where(go_left, t["left"][node], t["right"][node])
        node = np.where(inner, nxt, node)
    return node


def _features_matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in pdf["features"]]) if len(pdf) else np.zeros((0, 0))


def _as_array(col: str = "features"):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col)).alias(col)


def per_tree_scores(model, df: DataFrame, label: str, kind: str) -> DataFrame:
    """Each tree's test score -- R^2 (regressor) or accuracy on class
    indexes (classifier) -- from per-batch partial sums.  Columns tree, score."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(Trees(model, spark).trees)

    def run(batches):
        trees = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = _features_matrix(pdf)
            y = pdf[label].to_numpy(dtype=float)
            rows = []
            for i, t in enumerate(trees):
                p = tree_predict(t, x)
                if kind == "classifier":
                    rows.append((i, float((p == y).sum()), 0.0, 0.0, 0.0, len(y)))
                else:
                    rows.append((i, float(((y - p) ** 2).sum()), float(y.sum()), float((y * y).sum()), 0.0, len(y)))
            yield pd.DataFrame(rows, columns=["tree", "a", "sy", "syy", "z", "n"])

    part = df.select(_as_array(), label).mapInPandas(
        run, "tree int, a double, sy double, syy double, z double, n long")
    tot = part.groupBy("tree").agg(F.sum("a").alias("a"), F.sum("sy").alias("sy"),
                                   F.sum("syy").alias("syy"), F.sum("n").alias("n"))
    if kind == "classifier":
        score = F.col("a") / F.col("n")
    else:
        score = F.lit(1.0) - F.col("a") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    return tot.select("tree", score.alias("score"))


def best_tree(model, df: DataFrame, label: str, kind: str, features: list[str]) -> DataFrame:
    """L10 + L11: the tree with the best test score (lowest index on ties) and
    its decision rules as text lines."""
    scores = per_tree_scores(model, df, label, kind)
    best = scores.agg(F.max_by("tree", F.struct(F.col("score"), -F.col("tree"))).alias("t")).first()["t"]
    text = model.trees[int(best)].toDebugString
    for i, f in enumerate(features):
        text = text.replace(f"feature {i} ", f"{f} ")
    lines = [(int(best), n, line) for n, line in enumerate(text.splitlines())]
    return df.sparkSession.createDataFrame(lines, "tree int, line_no int, rule string")


def tree_mean_median(model, df: DataFrame, label: str, id_col: str, n: int = 10, seed: int = 42) -> DataFrame:
    """L15 (with J4, K11): for ``n`` sampled rows, mean and median of the trees'
    predictions and their absolute errors; joined by row id, any tree count,
    exact median, no truncation."""
    from postlytics.operators.sampling import sample_rows
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(Trees(model, spark).trees)
    sample = sample_rows(df, id_col, n, seed)

    def run(batches):
        trees = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = _features_matrix(pdf)
            preds = np.stack([tree_predict(t, x) for t in trees], axis=1)
            yield pd.DataFrame({id_col: pdf[id_col].values, label: pdf[label].astype(float).values,
                                "tree_mean": preds.mean(axis=1), "tree_median": np.median(preds, axis=1)})

    id_type = dict(df.dtypes)[id_col]
    out = sample.select(id_col, _as_array(), label).mapInPandas(
        run, f"{id_col} {id_type}, {label} double, tree_mean double, tree_median double")
    return out.withColumns({"error_mean": F.abs(F.col(label) - F.col("tree_mean")),
                            "error_median": F.abs(F.col(label) - F.col("tree_median"))})


def in_out_sample(model, train: DataFrame, test: DataFrame, label: str, kind: str) -> DataFrame:
    """Accuracy (classifier) or RMSE (regressor) on the training and the test rows."""
    both = (model.transform(train).withColumn("sample", F.lit("in"))
            .unionByName(model.transform(test).withColumn("sample", F.lit("out"))))
    if kind == "classifier":
        m = F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy")
    else:
        e = F.col(label) - F.col("prediction")
        m = F.sqrt(F.avg(e * e)).alias("rmse")
    return both.groupBy("sample").agg(m, F.count(F.lit(1)).alias("n"))


def high_scored_error(model, test: DataFrame, label: str, kind: str, high_class: float | None = None,
                      log_threshold: float = 5.0) -> DataFrame:
    """Accuracy on rows of the high class (null when there are none), or
    the mean absolute log error on rows with exp(label) >= threshold."""
    p = model.transform(test)
    if kind == "classifier":
        rows = p.where(F.col(label) == F.lit(high_class))
        return rows.agg(F.try_divide(F.sum((F.col(label) == F.col("prediction")).cast("double")),
                                     F.count(F.lit(1)).cast("double")).alias("accuracy_high"),
                        F.count(F.lit(1)).alias("n_high"))
    rows = p.where(F.exp(F.col(label)) >= F.lit(log_threshold))
    return rows.agg(F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mean_abs_log_error_high"),
                    F.count(F.lit(1)).alias("n_high"))


# --------------------------------------------------------------------------
# permutation importance
# --------------------------------------------------------------------------
SWAP_ROWS = 2048         # rows whose swaps are evaluated at once
SENT_ROWS = 4_000_000    # rows and donors' codes a task takes


def permutation_importance(model, test: DataFrame, features: list[str], label: str, kind: str,
                           repeats: int = 10, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """Drop in score (R^2 or accuracy) when one feature's values are
    permuted across the test rows, mean and std over ``repeats``.

    A repeat's permutation is a keyed Feistel network over the dense row index
    (``permute``), so neighbours in the order get unrelated donors.  Rows are numbered in
    the order of ``id_col`` (else of all features and the label), so the result does not
    depend on how they are partitioned.  A donor sends its codes (``swaps``, a byte or four a
    feature) to the row that takes its values in each repeat, one shuffle for all repeats;
    a row and its donors, one a repeat, then lie together and every swap is evaluated there.
    Tasks hold the forest's nodes (``Trees``) and send a line a feature and repeat."""
    from pyspark.ml.feature import VectorAssembler
    spark = test.sparkSession
    order = [id_col] if id_col else [*features, label]
    idx, n = dense_index(test.select(*dict.fromkeys([*order, *features, label])), order, "_i")
    base_pred = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(idx.select(*features, label)))
    metric = (F.avg((F.col(label) == F.col("prediction")).cast("double")) if kind == "classifier" else
              F.lit(1.0) - F.avg((F.col(label) - F.col("prediction")) ** 2) / F.var_pop(label))
    base_score, variance = base_pred.agg(metric, F.var_pop(label)).first()
    trees = Trees(model, spark)
    if kind == "classifier":
        shares = [np.array([v / v.sum() if v is not None and v.sum() > 0 else np.zeros(model.numClasses) for v in t["stats"]])
                  for t in trees.trees]
    else:
        shares = [t["pred"][:, None] for t in trees.trees]
    limits = np.array(model.getThresholds()) if kind == "classifier" and model.isSet("thresholds") else None
    held = spark.sparkContext.broadcast((CodedForest(trees.trees, len(features), shares), trees.num_trees))
    keys = [round_keys(seed * 1000 + r) for r in range(repeats)]
    k, size = len(features), repeats + 1

    def send(batches):
        forest = held.value[0]
        for batch in batches:
            i, *x, y = batch.columns
            i = i.to_numpy()
            codes = forest.codes(np.stack([c.to_numpy(zero_copy_only=False) for c in x], axis=1))
            ends = np.arange(len(i) + 1, dtype=np.int32) * (k * codes.itemsize)
            codes = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(i * size), codes, y], ["_k", "_codes", "_y"])
            for r in range(repeats):
                to = permuted_numbers(i, n, keys[r], inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(to * size + r + 1), codes, pa.nulls(len(i), pa.float64())],
                                                 ["_k", "_codes", "_y"])

    def scores(table: pa.Table):
        forest, m = held.value
        codes = np.frombuffer(b"".join(map(_bytes_of, table["_codes"].chunks)), forest.code_type).reshape(-1, size, k).transpose(1, 2, 0)
        y = table["_y"].to_numpy()[::size]
        known = np.asarray(table["_y"].is_valid())[::size]
        out = []
        for f, total in forest.swapped(np.ascontiguousarray(codes[0]), np.ascontiguousarray(codes[1:])):
            for r, found in enumerate(total):
                if kind == "classifier":
                    part = (np.argmax(found if limits is None else found / limits, axis=1) == y).astype(float)
                else:
                    part = (y - found[:, 0] / m) ** 2
                out.append((f, r, float(part[known].sum()), int(known.sum())))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["_f", "_rep", "part", "n"])

    def take(batches):
        rows, waiting = 0, []
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= SWAP_ROWS * size:
                whole = pa.Table.from_batches(waiting)
                full = rows // size * size
                yield scores(whole.slice(0, full))
                waiting, rows = whole.slice(full).to_batches(), rows - full
        if rows:
            yield scores(pa.Table.from_batches(waiting))

    sent = idx.select("_i", *[F.col(f).cast("double") for f in features], F.col(label).cast("double")).mapInArrow(
        send, "_k long, _codes binary, _y double")
    # a receiver's rows, one of its own and one a repeat, go to one task and stand together there
    receiver = F.call_function("div", F.col("_k"), F.lit(size).cast("long"))
    parts = -(-n * size // SENT_ROWS)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, receiver) if parts > usual else sent.repartition(receiver)
    per = (sent.sortWithinPartitions("_k").mapInArrow(take, "_f long, _rep long, part double, n long")
           .groupBy("_f", "_rep").agg(F.try_divide(F.sum("part"), F.sum("n")).alias("s")))
    if kind != "classifier":
        per = per.withColumn("s", F.lit(1.0) - F.try_divide("s", F.lit(variance).cast("double")))
    names = spark.createDataFrame(list(enumerate(features)), "_f int, feature string")
    return (per.groupBy("_f").agg((F.lit(base_score) - F.avg("s")).alias("importance_mean"),
                                  F.stddev_pop(F.lit(base_score) - F.col("s")).alias("importance_std"))
               .join(F.broadcast(names), "_f").select("feature", "importance_mean", "importance_std")
               .orderBy(F.desc("importance_mean")))


def _bytes_of(codes: pa.Array) -> bytes:
    """The bytes of an array of strings of bytes that has no nulls, one after another."""
    ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + len(codes) + 1]
    return codes.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes() if len(codes) else b""


# --------------------------------------------------------------------------
# TreeSHAP (L14)
# --------------------------------------------------------------------------
PATTERN_FEATURES = 10  # a leaf with more features on its way is not tabulated whole
SHAP_ROWS = 8192       # rows that are evaluated at once, so that their sums stay in the cache


def leaf_paths(t: dict) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One entry a leaf: its node, the distinct features on the way to it and, for
    each, the interval (low, high] its splits leave and the share of training rows that
    take this way (the product over its splits)."""
    found, todo = [], [(0, {})]
    while todo:
        node, way = todo.pop()
        if t["left"][node] < 0:
            features = np.array(sorted(way), np.int64)
            low, high, share = np.array([way[f] for f in features.tolist()]).reshape(-1, 3).T
            found.append((node, features, low, high, share))
            continue
        f, threshold, cover = int(t["feat"][node]), t["thr"][node], t["cover"][node] or 1.0
        low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
        for child, side in ((t["left"][node], (low, min(high, threshold))), (t["right"][node], (max(low, threshold), high))):
            todo.append((child, way | {f: (*side, share * t["cover"][child] / cover)}))
    return found


def shapley_weights(share: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's game, whose worth is the product over the d features (last
    axis) of ``follows`` (0 or 1) where the feature is known and of ``share`` where it is not.
    A feature's value is the integral over t in [0, 1] of its step times the others'
    share + t step (Owen 1972), a polynomial of degree d - 1: Gauss's rule is exact."""
    d = share.shape[-1]
    step = follows - share
    total = np.zeros(step.shape)
    for at, weight in zip(*np.polynomial.legendre.leggauss((d + 1) // 2)):
        factor = share + (at + 1) / 2 * step
        others = np.ones(step.shape)
        np.cumprod(factor[..., :-1], axis=-1, out=others[..., 1:])
        after = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        others[..., :-1] *= after
        total += weight / 2 * others
    return total * step


def _pattern(columns: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number a row, whose bit i says whether the row follows the way by feature i
    (a NaN goes right, as in the model)."""
    kind = np.uint8 if len(features) <= 8 else np.int64
    out = np.zeros(columns.shape[1], kind)
    for i, f in enumerate(features.tolist()):
        yes = ~(columns[f] <= low[i]) if low[i] > -np.inf else np.ones(len(out), bool)
        if high[i] < np.inf:
            yes &= columns[f] <= high[i]
        out |= yes.astype(kind) << kind(i)
    return out


def _bits(pattern: np.ndarray, d: int) -> np.ndarray:
    return (pattern[:, None] >> np.arange(d)) & 1


def path_shap(paths: list, values: np.ndarray, x: np.ndarray, n_features: int) -> np.ndarray:
    """Path-dependent TreeSHAP (Lundberg, Erion, Lee 2018): phi (rows x features x outputs) of
    a tree from its ``leaf_paths``; ``values`` is (nodes x outputs).  A leaf gives a row
    what the row's pattern of followed features says, so a leaf's values are tabulated once
    a call over its 2^d patterns (or those that occur, for many features) and looked up;
    they do not depend on the output, so all outputs come from one evaluation."""
    rows, outputs = len(x), values.shape[1]
    phi = np.zeros((rows, n_features * outputs))
    tables: dict[int, np.ndarray] = {}
    by_size: dict[int, list] = {}
    for path in paths:
        by_size.setdefault(len(path[1]), []).append(path)
    for d, group in by_size.items():
        if 0 < d <= PATTERN_FEATURES:
            every = _bits(np.arange(1 << d), d).astype(float)
            block = max(1, (1 << 20) // (d << d))
            for at in range(0, len(group), block):
                part = group[at:at + block]
                shares = np.stack([path[4] for path in part])[:, None, :]
                tables |= dict(zip((path[0] for path in part), shapley_weights(shares, every[None])))
    for at in range(0, rows, SHAP_ROWS):
        columns = np.ascontiguousarray(x[at:at + SHAP_ROWS].T)
        total = phi[at:at + SHAP_ROWS]
        found = np.empty_like(total)
        for node, features, low, high, share in paths:
            d = len(features)
            if not d:
                continue
            pattern = _pattern(columns, features, low, high)
            if d > PATTERN_FEATURES:
                met, pattern = np.unique(pattern, return_inverse=True)
                weights = shapley_weights(share, _bits(met, d).astype(float))
            else:
                weights = tables[node]
            table = np.zeros((len(weights), n_features, outputs))
            table[:, features] = weights[:, :, None] * values[node]
            np.take(table.reshape(len(weights), -1), pattern, axis=0, out=found, mode="clip")
            total += found
    return phi.reshape(rows, n_features, outputs)


def tree_shap(t: dict, values: np.ndarray, x: np.ndarray, n_features: int) -> np.ndarray:
    """phi (rows x features) of one tree whose nodes predict ``values``."""
    return path_shap(leaf_paths(t), values[:, None], x, n_features)[:, :, 0]


def expected_value(t: dict, values: np.ndarray) -> float:
    leaves = t["left"] < 0
    c = t["cover"][leaves]
    return float((c * values[leaves]).sum() / c.sum()) if c.sum() > 0 else 0.0


def _gathered(batches, rows: int = 8 * SHAP_ROWS):
    """The batches, joined to about ``rows`` rows, so that a tree's tables serve many."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf):
            held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _packed(trees: Trees, kind: str, classes: list[int | None]) -> list:
    """A tree's paths, node values (nodes x outputs), expected values and node arrays."""
    packed = []
    for t, *shares in zip(trees.trees, *[trees.leaf_values(kind, c) for c in classes]):
        packed.append((leaf_paths(t), np.stack(shares, axis=1), np.array([expected_value(t, v) for v in shares]),
                       {c: t[c] for c in ("left", "right", "feat", "thr")}))
    return packed


def _forest_shap(items: list, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest's phi (rows x features x outputs), base (outputs) and output (rows x outputs)."""
    classes = items[0][1].shape[1]
    phi, base, out = np.zeros((len(x), k, classes)), np.zeros(classes), np.zeros((len(x), classes))
    for paths, values, mean, nodes in items:
        phi += path_shap(paths, values, x, k)
        base += mean
        out += values[tree_leaf(nodes, x)]
    m = len(items)
    return phi / m, base / m, out / m


def shap_values(model, df: DataFrame, features: list[str], id_col: str, kind: str,
                cls: int = 1) -> DataFrame:
    """Per-row SHAP values of the forest's output (regression mean, or the
    class-``cls`` probability), with ``base`` and ``output`` columns so that
    sum(phi) + base = output."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(_packed(Trees(model, spark), kind, [cls]))
    k = len(features)

    def run(batches):
        for pdf in _gathered(batches):
            phi, base, out = _forest_shap(bc.value, _features_matrix(pdf), k)
            res = pd.DataFrame(phi[:, :, 0], columns=[f"phi_{f}" for f in features])
            res.insert(0, id_col, pdf[id_col].values)
            res["base"], res["output"] = base[0], out[:, 0]
            yield res

    id_type = dict(df.dtypes)[id_col]
    schema = f"{id_col} {id_type}, " + ", ".join(f"phi_{f} double" for f in features) + ", base double, output double"
    return df.select(id_col, _as_array()).mapInPandas(run, schema)


def shap_importance(model, df: DataFrame, features: list[str], id_col: str, kind: str,
                    cls: int = 1) -> DataFrame:
    """Mean |SHAP value| per feature, largest first."""
    sv = shap_values(model, df, features, id_col, kind, cls)
    one = sv.agg(*[F.avg(F.abs(F.col(f"phi_{f}"))).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in features])
    return one.select(F.explode(cells).alias("c")).select("c.*").orderBy(F.desc("mean_abs_shap"))


# --------------------------------------------------------------------------
# SHAP values of all outputs at once
# --------------------------------------------------------------------------
def shap_values_by_class(model, df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """A row for each row of ``df`` and class of a classification forest: ``id_col``,
    ``class``, phi_<feature>..., ``base`` and ``output``, the class's probability, with
    sum(phi) + base = output.  All classes are evaluated in one pass."""
    spark = df.sparkSession
    classes = int(model.numClasses)
    bc = spark.sparkContext.broadcast(_packed(Trees(model, spark), "classifier", list(range(classes))))
    k = len(features)

    def run(batches):
        for pdf in _gathered(batches):
            phi, base, out = _forest_shap(bc.value, _features_matrix(pdf), k)
            for c in range(classes):
                res = pd.DataFrame(phi[:, :, c], columns=[f"phi_{f}" for f in features])
                res.insert(0, id_col, pdf[id_col].values)
                res.insert(1, "class", c)
                res["base"], res["output"] = base[c], out[:, c]
                yield res

    id_type = dict(df.dtypes)[id_col]
    schema = f"{id_col} {id_type}, class int, " + ", ".join(f"phi_{f} double" for f in features) + ", base double, output double"
    return df.select(id_col, _as_array()).mapInPandas(run, schema)


def shap_importance_by_class(model, df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """L14 for every class: mean |SHAP value| per class and feature, largest first."""
    sums = shap_values_by_class(model, df, features, id_col).groupBy("class").agg(
        *[F.avg(F.abs(F.col(f"phi_{f}"))).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in features])
    return sums.select("class", F.inline(cells)).orderBy("class", F.desc("mean_abs_shap"))

"""Linear models and the regression study.

The lasso path, its cross-validation, OLS and the residual diagnostics need the
data only through sums of cross products.  One aggregation of the augmented Gram
matrix Z^T Z, Z = [1, X, y], grouped by fold cell gives every training and test
sum for every fold, so the whole study is one pass over the rows; coordinate
descent then runs on k x k numbers.  The objective is the lasso's
(1/2n) ||y - b0 - X b||^2 + alpha ||b||_1, the same one Spark's
``LinearRegression(elasticNetParam=1, standardization=False)`` minimises.
The Poisson model uses Spark's ``GeneralizedLinearRegression``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from postlytics.operators import stats
from postlytics.operators.parts import Parts
from postlytics.operators.sampling import with_fold_columns, with_folds
from postlytics.session import fit_held


# --------------------------------------------------------------------------
# Gram sums
# --------------------------------------------------------------------------
def fold_grams(df: DataFrame, cols: list[str], label: str, fold_cols: list[str] | None = None):
    """{fold key tuple: (Z^T Z, n)} for Z = [1, cols..., label], one aggregation."""
    fold_cols = fold_cols or []
    names = cols + [label]
    k = len(names)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.col(names[i])).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}")
             for i in range(k) for j in range(i, k)]
    rows = (df.groupBy(*fold_cols).agg(*aggs) if fold_cols else df.agg(*aggs)).collect()
    out = {}
    for r in rows:
        z = np.zeros((k + 1, k + 1))
        n = r["_n"]
        z[0, 0] = n
        for i in range(k):
            z[0, i + 1] = z[i + 1, 0] = r[f"s{i}"] or 0.0
            for j in range(i, k):
                z[i + 1, j + 1] = z[j + 1, i + 1] = r[f"g{i}_{j}"] or 0.0
        out[tuple(r[c] for c in fold_cols)] = z
    return out


def _moments(z):
    n = z[0, 0]
    m = z[0, 1:] / n
    cov = z[1:, 1:] / n - np.outer(m, m)
    return n, m, cov


def lasso_cd(z: np.ndarray, alpha: float, beta0: np.ndarray | None = None,
             tol: float = 1e-10, max_iter: int = 100_000) -> tuple[float, np.ndarray]:
    """Coordinate descent for the lasso with intercept from an augmented Gram
    matrix (last variable = target).  Returns (intercept, coefficients)."""
    n, m, cov = _moments(z)
    c, cy = cov[:-1, :-1], cov[:-1, -1]
    p = len(cy)
    b = np.zeros(p) if beta0 is None else beta0.copy()
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if c[j, j] <= 0:
                continue
            rho = cy[j] - c[j] @ b + c[j, j] * b[j]
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / c[j, j]
            delta = max(delta, abs(new - b[j]) * math.sqrt(c[j, j]))
            b[j] = new
        if delta < tol:
            break
    b0 = m[-1] - m[:-1] @ b
    return float(b0), b


def ols_from_gram(z: np.ndarray) -> tuple[float, np.ndarray]:
    """L1: least squares with intercept from an augmented Gram matrix."""
    n, m, cov = _moments(z)
    b = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
    return float(m[-1] - m[:-1] @ b), b


def sse_sst(z: np.ndarray, b0: float, b: np.ndarray) -> tuple[float, float, float]:
    """(sum of squared errors, total sum of squares about the set's own mean, n)
    of the linear prediction b0 + X b on the rows summarised by ``z``."""
    w = np.concatenate([[-b0], -b, [1.0]])          # residual = w . [1, x, y]
    sse = float(w @ z @ w)
    n = float(z[0, 0])
    sst = float(z[-1, -1] - z[0, -1] ** 2 / n)
    return sse, sst, n


def alpha_grid(z: np.ndarray, n_alphas: int = 100, eps: float = 1e-3) -> list[float]:
    """Log-spaced lasso penalties from alpha_max = max |Xc^T yc| / n down to
    alpha_max * eps."""
    _, _, cov = _moments(z)
    amax = float(np.max(np.abs(cov[:-1, -1])))
    if amax <= 0:
        return [0.0]
    return list(np.logspace(math.log10(amax), math.log10(amax * eps), n_alphas))


def linear_prediction(cols: list[str], b0: float, b) -> Column:
    e = F.lit(float(b0))
    for c, v in zip(cols, b):
        e = e + F.col(c) * F.lit(float(v))
    return e


# --------------------------------------------------------------------------
# reports
# --------------------------------------------------------------------------
def _fold_sum(grams, keep):
    tot = None
    for key, z in grams.items():
        if keep(key):
            tot = z.copy() if tot is None else tot + z
    return tot


def standardised_gram(g_fit: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The Gram of [1, (x - m) / s, y] from the raw Gram ``g`` of [1, x, y], with
    the mean m and population std s of each feature taken from ``g_fit``: an
    affine map A of the columns, so the result is A^T g A (a constant feature
    becomes 0)."""
    n, k = g_fit[0, 0], g.shape[0] - 2
    a = np.eye(k + 2)
    for j in range(1, k + 1):
        m = g_fit[0, j] / n
        s = math.sqrt(max(g_fit[j, j] / n - m * m, 0.0))
        a[j, j], a[0, j] = (1.0 / s, -m / s) if s > 0 else (0.0, 0.0)
    return a.T @ g @ a


def lasso_report(df: DataFrame, features: list[str], label: str, id_col: str,
                 log_target: bool = True, cv_select: int = 5, cv_score: int = 3,
                 n_alphas: int = 100, alphas: list[float] | None = None,
                 diagnostics: bool = True, scale_in_fold: bool = False) -> Parts:
    """M8 lasso part.

    Features are standardised with population std over all rows (as the
    reference does before cross-validating), the target is log-transformed
    (rows with target <= 0 are dropped and counted).  Folds are contiguous
    blocks in ``id_col`` order.  ``scale_in_fold`` standardises each training
    fold with its own moments instead (no leak); on Gram matrices that is an
    affine map, so it needs no extra pass.  Returns named result DataFrames; the
    diagnostics are computed when they are asked for."""
    spark = df.sparkSession
    d = df.select(id_col, *features, label).dropna()
    dropped = None
    # one pass: rows dropped by the log target and the feature moments of the rest
    keep = (F.col(label) > 0) if log_target else None
    extra = [F.sum((~keep).cast("long")).alias("_dropped")] if log_target else []
    moments = d.agg(*extra, *stats.moment_aggs(features, keep)).first()
    if log_target:
        dropped = moments["_dropped"] or 0
        d = d.where(keep).withColumn(label, F.log(F.col(label)))
    raw = d
    d = stats.standardise_with(d, features, moments)
    d = with_fold_columns(raw if scale_in_fold else d, {"_f5": cv_select, "_f3": cv_score}, [id_col])
    grams = fold_grams(d, features, label, ["_f5", "_f3"])

    def pair(keep_train):
        tr = _fold_sum(grams, keep_train)
        te = _fold_sum(grams, lambda k: not keep_train(k))
        return (standardised_gram(tr, tr), standardised_gram(tr, te)) if scale_in_fold else (tr, te)

    total = _fold_sum(grams, lambda k: True)
    if scale_in_fold:
        total = standardised_gram(total, total)
        d = stats.standardise_with(raw, features, moments)
    grid = alphas or alpha_grid(total, n_alphas)
    # L3: choose alpha by mean test MSE over the cv_select folds
    cv_mse = []
    for a in grid:
        errs = []
        for f in range(cv_select):
            tr, te = pair(lambda k, f=f: k[0] != f)
            b0, b = lasso_cd(tr, a)
            sse, _, n = sse_sst(te, b0, b)
            errs.append(sse / n)
        cv_mse.append(float(np.mean(errs)))
    best = grid[int(np.argmin(cv_mse))]
    # L4: cv_score-fold R^2 and MSE at the chosen alpha
    r2s, mses = [], []
    for f in range(cv_score):
        tr, te = pair(lambda k, f=f: k[1] != f)
        b0, b = lasso_cd(tr, best)
        sse, sst, n = sse_sst(te, b0, b)
        r2s.append(1 - sse / sst)
        mses.append(sse / n)
    b0, b = lasso_cd(total, best)
    coefs = spark.createDataFrame([(c, float(v), bool(v != 0)) for c, v in zip(features, b)]
                                  + [("(intercept)", b0, True)],
                                  "feature string, coefficient double, selected boolean")
    summary = spark.createDataFrame(
        [(float(best), float(np.mean(r2s)), float(np.mean(mses)), int(total[0, 0]),
          int(dropped) if dropped is not None else None)],
        "alpha double, cv_r2 double, cv_mse double, n long, dropped_nonpositive long")
    path = spark.createDataFrame([(float(a), m) for a, m in zip(grid, cv_mse)], "alpha double, cv_mse double")
    fitted = d
    out = {"coefficients": lambda: coefs, "summary": lambda: summary, "alpha_path": lambda: path,
           "certificate": lambda: lasso_certificate(fitted, features, label, b0, list(b), best)}
    if not diagnostics:
        return Parts(out)
    resid = d.withColumn("resid", F.col(label) - linear_prediction(features, b0, b))
    out |= residual_diagnostics(resid, "resid", features, id_col).makers()
    out["vif"] = lambda: stats.vif(df.select(*features).dropna(), features)
    out["pearson"] = lambda: stats.pearson_long(df.select(*features).dropna(), features)
    return Parts(out)


def _certified(df: DataFrame, features: list[str], gaps: Column, scale: Column) -> DataFrame:
    """One row a feature: ``feature, gap, n``; the gap is relative to ``scale``."""
    one = df.select("_n", F.posexplode(F.transform(gaps, lambda g: F.abs(g) / scale)).alias("_i", "gap"))
    names = F.array(*[F.lit(c) for c in [*features, "(intercept)"]])
    return one.select(F.element_at(names, F.col("_i") + 1).alias("feature"), "gap", F.col("_n").alias("n"))


def lasso_certificate(df: DataFrame, features: list[str], label: str, intercept: float, coefficients: list[float],
                      alpha: float) -> DataFrame:
    """The optimality of a lasso fit from the rows themselves (L3-L5): ``feature, gap,
    n``.  With the residual r, a fit is optimal where the mean of x r is alpha times
    the coefficient's sign, at most alpha in size where the coefficient is zero, and the
    mean of r is zero.  The gap is the distance from that, relative to the largest
    penalty that leaves any coefficient (so it has no unit); one aggregate, no model."""
    r = F.col(label) - linear_prediction(features, intercept, np.asarray(coefficients))
    y0 = F.avg(label)
    sums = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_r"),
                  F.array(*[F.avg(F.col(c) * r) for c in features]).alias("_xr"),
                  F.greatest(*[F.abs(F.avg(F.col(c) * F.col(label)) - F.avg(c) * y0) for c in features], F.lit(0.0)).alias("_scale"))
    gaps = []
    for i, b in enumerate(coefficients):
        g = F.col("_xr")[i]
        gaps.append(g - F.lit(alpha * math.copysign(1, b)) if b else F.greatest(F.abs(g) - F.lit(alpha), F.lit(0.0)))
    return _certified(sums, features, F.array(*gaps, F.col("_r")), F.greatest("_scale", F.lit(1e-300)))


def poisson_certificate(df: DataFrame, features: list[str], label: str, intercept: float, coefficients: list[float],
                        alpha: float) -> DataFrame:
    """The optimality of a Poisson fit with log link and L2 penalty ``alpha`` from the
    rows themselves (L6): ``feature, gap, n``.  At the optimum the mean of x (y - mu) is
    alpha times the coefficient, and the mean of y - mu is zero; the gap is relative to
    the mean of y."""
    r = F.col(label) - F.exp(linear_prediction(features, intercept, np.asarray(coefficients)))
    sums = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_r"), F.avg(label).alias("_scale"),
                  F.array(*[F.avg(F.col(c) * r) for c in features]).alias("_xr"))
    gaps = [F.col("_xr")[i] - F.lit(float(alpha * b)) for i, b in enumerate(coefficients)]
    return _certified(sums, features, F.array(*gaps, F.col("_r")), F.col("_scale"))


def residual_diagnostics(d: DataFrame, resid: str, features: list[str], id_col: str) -> Parts:
    """K4-K8 on a residual column; each part starts its jobs when it is asked for."""
    return Parts({
        "residual_mean": lambda: d.agg(F.avg(resid).alias("mean_residual"), F.count(resid).alias("n")),
        "qq": lambda: stats.qq_points(d, resid),
        "normality": lambda: stats.normality(d, resid),
        "breusch_pagan": lambda: stats.breusch_pagan(d, resid, features),
        "durbin_watson": lambda: stats.durbin_watson(d, resid, [id_col]),
    })


def ols_report(df: DataFrame, features: list[str], label: str, id_col: str = "id",
               test: float = 0.25, seed: int = 42) -> Parts:
    """L1 + diagnostics: OLS on a hash split; test R^2, coefficients, residual checks."""
    from postlytics.operators.sampling import hash_split
    d = hash_split(df.select(id_col, *features, label).dropna(), id_col, test, seed, "_test")
    grams = fold_grams(d, features, label, ["_test"])
    tr, te = grams.get((False,)), grams.get((True,))
    b0, b = ols_from_gram(tr)
    sse, sst, n = sse_sst(te, b0, b)
    spark = df.sparkSession
    resid = stats.residuals(d.withColumn("_fit", linear_prediction(features, b0, b)), label, "_fit", "resid")
    return Parts({
        "coefficients": lambda: spark.createDataFrame(
            [(c, float(v)) for c, v in zip(features, b)] + [("(intercept)", b0)], "feature string, coefficient double"),
        "summary": lambda: spark.createDataFrame(
            [(1 - sse / sst, sse / n, int(n))], "test_r2 double, test_mse double, n_test long"),
        "residuals": lambda: resid.select(id_col, "resid"),
    } | residual_diagnostics(resid, "resid", features, id_col).makers())


def decision_tree_r2(df: DataFrame, features: list[str], label: str, id_col: str = "id",
                     max_depth: int = 30, test: float = 0.25, seed: int = 42) -> DataFrame:
    """L2: a single regression tree, test R^2.  The tree has nodes for nearly every row at
    this depth, so it is grown over cells (``celltree``) and never held whole."""
    from postlytics.llm.common import store
    from postlytics.operators.celltree import tree_predictions
    from postlytics.operators.sampling import hash_split
    d = hash_split(df.select(id_col, *features, label).dropna(), id_col, test, seed, "_test")
    d = store(d.select(*features, label, "_test"), "tree-rows")
    return stats.regression_metrics(tree_predictions(d, features, label, "_test", max_depth, seed), label, "prediction")


def poisson_report(df: DataFrame, features: list[str], label: str, id_col: str,
                   alpha: float = 1.0, folds: int = 3, test: float = 0.25, seed: int = 42) -> Parts:
    """Poisson regression with L2 penalty ``alpha`` (log link) on
    standardised features: ``folds``-fold D^2 and MSE, Durbin-Watson of hold-out
    residuals, mean and variance of the training target (D19).  Spark's
    regParam is relative to mean(y), hence regParam = alpha / mean(y)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    from postlytics.operators.sampling import hash_split
    spark = df.sparkSession
    d = stats.standardise(df.select(id_col, *features, label).dropna(), features)
    d = VectorAssembler(inputCols=features, outputCol="features").transform(d)

    def fit(train):
        ybar = train.agg(F.avg(label)).first()[0]
        glr = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features",
                                          labelCol=label, regParam=alpha / ybar, maxIter=100)
        return fit_held(glr, train, label)

    def deviance_terms(pred, ybar):
        y, mu = F.col(label), F.col("prediction")
        unit = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0)) - (y - mu)
        null = F.when(y > 0, y * F.log(y / F.lit(ybar))).otherwise(F.lit(0.0)) - (y - F.lit(ybar))
        return pred.agg(F.sum(unit).alias("dev"), F.sum(null).alias("null_dev"),
                        F.avg((y - mu) * (y - mu)).alias("mse"), F.sum((y - mu) * (y - mu)).alias("sse"),
                        F.sum((y - F.lit(ybar)) * (y - F.lit(ybar))).alias("sst")).first()

    def summary():
        # the reference prints the model's default score (deviance D^2) as "R^2": both are reported
        folded = with_folds(d, folds, [id_col], name="_fold").persist()
        d2s, r2s, mses = [], [], []
        for f in range(folds):
            model = fit(folded.where(F.col("_fold") != f))
            te = folded.where(F.col("_fold") == f)
            ybar = te.agg(F.avg(label)).first()[0]
            r = deviance_terms(model.transform(te), ybar)
            d2s.append(1 - r["dev"] / r["null_dev"])
            r2s.append(1 - r["sse"] / r["sst"] if r["sst"] else float("nan"))
            mses.append(r["mse"])
        folded.unpersist()
        return spark.createDataFrame([(float(np.mean(d2s)), float(np.mean(r2s)), float(np.mean(mses)))],
                                     "cv_d2 double, cv_r2 double, cv_mse double")

    split = hash_split(d, id_col, test, seed, "_test")
    train = split.where(~F.col("_test"))
    model = functools.cache(lambda: fit(train))

    def coefficients():
        return spark.createDataFrame([(c, float(v)) for c, v in zip(features, model().coefficients)]
                                     + [("(intercept)", float(model().intercept))], "feature string, coefficient double")

    def durbin_watson():
        held = stats.residuals(model().transform(split.where(F.col("_test"))), label, "prediction")
        return stats.durbin_watson(held, "resid", [id_col])

    def certificate():
        return poisson_certificate(train, features, label, float(model().intercept), list(map(float, model().coefficients)), alpha)

    return Parts({"summary": summary, "coefficients": coefficients, "durbin_watson": durbin_watson, "certificate": certificate,
                  "dispersion": lambda: stats.dispersion(train, label)})

"""Statistics.

Everything row-sized stays in Spark.  Operators that need a matrix (VIF,
Breusch-Pagan, OLS) run one aggregation of cross products -- the Gram matrix --
and only those k x k numbers reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from postlytics.functions.normal import normal_cdf, normal_quantile
from postlytics.operators import distributions as dist
from postlytics.operators.ordering import dense_index, exact_quantiles, step_sums


def _long_rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pearson_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """K2: Pearson correlation of every ordered column pair, long form (x, y, z):
    one aggregation, then the k^2 cells as rows (no driver round trip)."""
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.corr(a, b).alias(f"{a}\u0001{b}"))
    one = df.agg(*aggs, *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    cells = []
    for a in cols:
        for b in cols:
            if a == b:
                z = F.when(F.col(f"_sd_{a}") > 0, F.lit(1.0))
            else:
                key = f"{a}\u0001{b}" if cols.index(a) < cols.index(b) else f"{b}\u0001{a}"
                z = F.col(f"`{key}`")
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), z.cast("double").alias("z")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.x", "c.y", "c.z")


def running_counts(df: DataFrame, col: str, num_partitions: int | None = None) -> DataFrame:
    """(``col``, ``_c``, ``_upto``): each distinct value, its rows and the rows up to and
    with it.  Ties are counted first, so the rows of one value never meet in a task; the
    counts are range-partitioned and summed up, with one sum per partition on the driver."""
    from postlytics.session import cut_lineage
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranged = cut_lineage(counts.repartitionByRange(n, col).withColumn("_p", F.spark_partition_id()))
    before, run = {}, 0
    for p, c in sorted(ranged.groupBy("_p").agg(F.sum("_c")).collect()):
        before[p], run = run, run + c
    upto = F.sum("_c").over(Window.partitionBy("_p").orderBy(col))
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("_p").cast("long")) \
        if before else F.lit(0)
    return ranged.select(col, "_c", (start + upto).alias("_upto"))


def average_ranks(df: DataFrame, col: str, name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """(``col``, ``name``), the average rank (from 1) of each distinct value, from
    ``running_counts``."""
    return running_counts(df, col, num_partitions).select(col, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))


def spearman_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """K1: Spearman rho (average ranks for ties) and two-sided p (t with n-2
    d.f.) for every column pair i < j.  Rows are collapsed to distinct combinations
    with a count and joined to the ranks of each column; as the mean rank is known,
    one aggregation gives all centred sums."""
    d = df.select(*cols).dropna()
    n = d.count()
    ranked = d.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    for i, c in enumerate(cols):
        ranked = ranked.join(average_ranks(d, c, f"_r{i}"), c)
    r = [F.col(f"_r{i}") - F.lit((n + 1) / 2) for i in range(len(cols))]
    sums = ranked.agg(*[F.sum(F.col("_n") * r[i] * r[j]).alias(f"s{i}_{j}")
                        for i in range(len(cols)) for j in range(i, len(cols))]).first()
    rows = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            norm = math.sqrt((sums[f"s{i}_{i}"] or 0.0) * (sums[f"s{j}_{j}"] or 0.0))
            rho = sums[f"s{i}_{j}"] / norm if norm else float("nan")
            if math.isnan(rho) or n < 3:
                p = float("nan")
            elif abs(rho) >= 1:
                p = 0.0
            else:
                t = rho * math.sqrt((n - 2) / (1 - rho * rho))
                p = dist.t_two_sided(t, n - 2)
            rows.append((a, cols[j], rho, p))
    schema = StructType([StructField("x", StringType()), StructField("y", StringType()),
                         StructField("rho", DoubleType()), StructField("p_value", DoubleType())])
    return _long_rows(df.sparkSession, rows, schema)


def standardise(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """K3: (x - mean) / population std; a constant column becomes 0.  The 2k
    moments are one aggregation and come back as literals."""
    stats = df.agg(*moment_aggs(cols)).first()
    return standardise_with(df, cols, stats, suffix)


def moment_aggs(cols: list[str], where: Column | None = None) -> list[Column]:
    """Mean and population std of each column (over the rows where ``where``
    holds), named m<i> and s<i> -- to be folded into a caller's aggregation."""
    val = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
    return ([F.avg(val(c)).alias(f"m{i}") for i, c in enumerate(cols)] +
            [F.stddev_pop(val(c)).alias(f"s{i}") for i, c in enumerate(cols)])


def standardise_with(df: DataFrame, cols: list[str], stats, suffix: str = "") -> DataFrame:
    """K3 with moments already computed (a row holding m<i>, s<i>)."""
    new = {}
    for i, c in enumerate(cols):
        m, s = stats[f"m{i}"], stats[f"s{i}"]
        if m is None:
            new[c + suffix] = F.lit(None).cast("double")
        elif not s:
            new[c + suffix] = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            new[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(new)


def dispersion(df: DataFrame, col: str) -> DataFrame:
    """Mean and population variance (Poisson check: they should be equal)."""
    return df.agg(F.avg(col).alias("mean"), F.var_pop(col).alias("variance"))


def gram(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """X^T X over ``cols`` in one aggregation (rows with nulls dropped)."""
    d = df.select(*cols).dropna()
    k = len(cols)
    aggs = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}")
            for i in range(k) for j in range(i, k)]
    r = d.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, int(r["n"])


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """K9: variance inflation factor of each column against the others, on the
    raw (unscaled) columns and with no intercept: VIF_i = G_ii (G^-1)_ii, which is
    1 / (1 - uncentred R^2) of column i on the rest.  The columns are scaled to unit
    length first; one that the others make up exactly has an infinite factor, a
    column of zeros none (NaN)."""
    g, _ = gram(df, cols)
    size = np.sqrt(np.diag(g))
    size[size == 0] = np.nan
    used = np.flatnonzero(~np.isnan(size))
    value, vector = np.linalg.eigh((g / np.outer(size, size))[np.ix_(used, used)])
    null = value < 1e-12 * max(len(used), 1)
    found = dict.fromkeys(range(len(cols)), float("nan"))
    for place, i in enumerate(used):
        bound = np.abs(vector[place, null]).max(initial=0) > 1e-5
        found[i] = float("inf") if bound else float((vector[place, ~null] ** 2 / value[~null]).sum())
    rows = [(c, found[i]) for i, c in enumerate(cols)]
    schema = StructType([StructField("feature", StringType()), StructField("vif", DoubleType())])
    return _long_rows(df.sparkSession, rows, schema)


def durbin_watson(df: DataFrame, resid: str, order_by: list[str]) -> DataFrame:
    """K8: sum (e_t - e_{t-1})^2 / sum e_t^2 in ``order_by`` order, in one scan
    (``ordering.step_sums``)."""
    return step_sums(df, resid, order_by).select((F.col("steps") / F.col("squares")).alias("durbin_watson"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """R^2, MSE, RMSE, MAE in one aggregation."""
    e = F.col(label) - F.col(prediction)
    m = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
               F.var_pop(label).alias("_var"), F.count(F.lit(1)).alias("n"))
    return m.select((F.lit(1.0) - F.col("mse") / F.col("_var")).alias("r2"), "mse",
                    F.sqrt("mse").alias("rmse"), "mae", "n")


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of rows where prediction equals label."""
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def residuals(df: DataFrame, label: str, prediction: str, name: str = "resid") -> DataFrame:
    """K4: label - prediction."""
    return df.withColumn(name, F.col(label) - F.col(prediction))


def qq_points(df: DataFrame, col: str, points: int = 99) -> DataFrame:
    """K5: normal QQ data on a fixed grid p = (i - 0.5) / m: sample quantile of
    the standardised column (exact, linear interpolation) against the standard
    normal quantile; the 's' line is the identity on standardised data."""
    z = standardise(df.select(col).dropna(), [col], "_z")
    ps = [(i - 0.5) / points for i in range(1, points + 1)]
    # one global group: rank selection, not a value -> count map in one task
    q = exact_quantiles(z, [col + "_z"], ps)[col + "_z"]
    rows = [(float(p), dist.norm_ppf(p), float(v) if v is not None else None) for p, v in zip(ps, q or [])]
    schema = StructType([StructField("p", DoubleType()), StructField("theoretical", DoubleType()),
                         StructField("sample", DoubleType())])
    return _long_rows(df.sparkSession, rows, schema)


def normal_points(df: DataFrame, col: str, key: str, num_partitions: int | None = None) -> DataFrame:
    """K5: the normal plot with a point for every row whose ``col`` is not null: ``rank``
    (from 1, ties by ``key``, unique), the position ``p`` = rank / (n + 1), ``theoretical``,
    its standard normal quantile, ``sample``, the value as it is, and ``line``, the mean
    plus standard deviation times ``theoretical``.  One range shuffle; n and the two
    moments are all that the driver sees.  No rows give no points."""
    rows = df.select(F.col(key).alias("_k"), F.col(col).cast("double").alias("sample")).where(F.col("sample").isNotNull())
    ranked, n = dense_index(rows, ["sample", "_k"], "_i", num_partitions)
    mean, sd = ranked.agg(F.avg("sample"), F.stddev_pop("sample")).first()
    points = ranked.select((F.col("_i") + 1).alias("rank"), ((F.col("_i") + 1) / F.lit(float(n + 1))).alias("p"), "sample")
    points = points.withColumn("theoretical", normal_quantile("p"))
    return points.select("rank", "p", "theoretical", "sample", (F.lit(mean) + F.lit(sd) * F.col("theoretical")).alias("line"))


def normality_distance(df: DataFrame, col: str, num_partitions: int | None = None) -> DataFrame:
    """K6: one row, ``distance`` and ``n``: the greatest distance of the empirical
    distribution of ``col`` (nulls left out) from the normal one with its mean and sample
    standard deviation.  The steps of the empirical distribution are the running counts of
    the distinct values, so it needs no row order.  Null for fewer than two rows or no
    spread."""
    rows = df.select(F.col(col).cast("double").alias("_v")).dropna()
    steps = running_counts(rows, "_v", num_partitions)
    m = rows.agg(F.avg("_v").alias("m"), F.stddev_samp("_v").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if not m["s"]:
        return df.sparkSession.createDataFrame([(None, m["n"])], "distance double, n long")
    at = normal_cdf((F.col("_v") - m["m"]) / m["s"])
    gap = F.greatest(F.col("_upto") / float(m["n"]) - at, at - (F.col("_upto") - F.col("_c")) / float(m["n"]))
    return steps.agg(F.max(gap).alias("distance"), F.lit(m["n"]).cast("long").alias("n"))


def normality(df: DataFrame, col: str) -> DataFrame:
    """K6: Kolmogorov-Smirnov distance of the standardised column (sample standard
    deviation) to N(0, 1) (Spark ML's distributed test) with the Lilliefors p-value
    for estimated mean and sd, plus the plain KS p-value.  The formula for the former
    holds up to 0.1: beyond, ``p_value`` is 0.1 and ``p_is_bound`` is true."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    d = df.select(col).dropna()
    moments = d.agg(F.avg(col).alias("m0"), F.stddev_samp(col).alias("s0"), F.count(F.lit(1)).alias("n")).first()
    z, n = standardise_with(d, [col], moments, "_z"), moments["n"]
    r = KolmogorovSmirnovTest.test(z, col + "_z", "norm", 0.0, 1.0).first()
    d = float(r.statistic)
    p = float(dist.lilliefors_p(d, n))
    rows = [(d, min(p, 0.1), p > 0.1, float(r.pValue), int(n))]
    return df.sparkSession.createDataFrame(
        rows, "ks_statistic double, p_value double, p_is_bound boolean, ks_p_value double, n long")


def breusch_pagan(df: DataFrame, resid: str, cols: list[str]) -> DataFrame:
    """K7: Breusch-Pagan test -- regress e^2 on [1, X]; LM = n R^2 with k d.f.,
    F = (R^2/k) / ((1-R^2)/(n-k-1)).  X and e^2 are standardised first (one
    aggregation), so that the one Gram aggregation loses no digits."""
    d = df.select(*cols, resid).dropna().withColumn("_e2", F.col(resid) * F.col(resid))
    names = cols + ["_e2"]
    g, n = gram(standardise(d, names), names)
    k = len(cols)
    beta = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
    r2 = float(beta @ g[:k, k] / g[k, k]) if g[k, k] > 0 else float("nan")
    lm = n * r2
    fval = (r2 / k) / ((1 - r2) / (n - k - 1)) if n - k - 1 > 0 and r2 < 1 else float("nan")
    lm, fval = float(lm), float(fval)
    rows = [(lm, float(dist.chi2_sf(lm, k)), fval, float(dist.f_sf(fval, k, n - k - 1)), int(n))]
    return df.sparkSession.createDataFrame(
        rows, "lm double, lm_p_value double, f_value double, f_p_value double, n long")


def few_partitions(held: DataFrame, rows: int = 1_000_000, factor: int = 2) -> DataFrame:
    """The persisted ``held``, or where it has more partitions than ``factor`` a core and more
    than one for so many ``rows``, a persisted frame of that many in its place."""
    n = max(factor * held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // rows))
    if held.rdd.getNumPartitions() <= n:
        return held
    few = held.coalesce(n).persist()
    few.count()
    held.unpersist()
    return few


def silhouette_sweep(df: DataFrame, cols: list[str], ks=range(2, 11), seed: int = 42,
                     scale: bool = False) -> DataFrame:
    """K-means for each k and its silhouette.  Spark's evaluator offers
    squared-Euclidean and cosine distances; squared Euclidean is used (the
    reference's plain Euclidean silhouette would need all point pairs).

    Each k takes some 25 scans, and every task of a scan sends the driver a result of its
    own (about 8 KB, mostly metrics), so the held rows come in ``few_partitions``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    d = df.select(*cols).fillna(0.0)
    if scale:
        d = standardise(d, cols)
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(d).select("features")
    vec = few_partitions(vec.persist())
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(vec)
        rows.append((int(k), float(ev.evaluate(model.transform(vec)))))
    vec.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")

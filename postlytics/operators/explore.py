"""Exploration aggregates, sorts and top-k.

All of them are hash aggregations with map-side partial aggregation, so a hot
group key is reduced before the shuffle.

Exact medians and quantiles come from sketch brackets (``quantiles``), one plan for
groups of any size and columns of any numeric type; ``exact=False`` gives
``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlytics.functions._util import as_col
from postlytics.functions.binning import cut
from postlytics.operators.quantiles import bracket_quantiles, column_quantiles


def _approx_median(value) -> Column:
    return F.percentile_approx(as_col(value), 0.5, 10000).cast("double")


def with_group_quantiles(per_group: DataFrame, src: DataFrame, group: list[str], value: str,
                         probs: list[float], names: list[str]) -> DataFrame:
    """Left-join quantiles of ``src.value`` per group onto a frame with one row
    per group (null-safe on the keys); a group without values gets nulls, as
    with ``percentile``."""
    q = bracket_quantiles(src, group, value, probs)
    q = q.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], "_q")
    cond = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    j = per_group.join(q, cond, "left")
    return j.select(*per_group.columns, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def attach_group_median(df: DataFrame, ref: DataFrame, key: str, value: str, name: str,
                        exact: bool = True) -> DataFrame:
    """D3 + C2: median of ``value`` per ``key`` in ``ref``, left-joined onto ``df``."""
    if exact:
        med = bracket_quantiles(ref, [key], value, [0.5]).select(key, F.col("_q")[0].alias(name))
    else:
        med = ref.groupBy(key).agg(_approx_median(value).alias(name))
    return df.join(med, key, "left")


def group_stat(df: DataFrame, key: str, value: str, how: str, name: str, exact: bool = True) -> DataFrame:
    """Mean or median of ``value`` per ``key``."""
    if how == "median" and exact:
        keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).drop("_c")
        return with_group_quantiles(keys, df, [key], value, [0.5], [name])
    fn = {"mean": lambda: F.avg(value), "median": lambda: _approx_median(value)}[how]
    return df.groupBy(key).agg(fn().alias(name))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per distinct value; null counts as a value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def point_counts(df: DataFrame, x: str, y: str, name: str = "count") -> DataFrame:
    """Rows per (x, y) point -- the data behind a sized scatter plot."""
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias(name))


def pair_points(df: DataFrame, cols: list[str], name: str = "count") -> DataFrame:
    """The points of every pair of ``cols`` in one pass: ``x, y`` (column names),
    ``x_value, y_value`` (double) and the rows there, counted in each task first."""
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("x_value"), F.col(y).cast("double").alias("y_value"))
             for i, x in enumerate(cols) for y in cols[i + 1:]]
    return df.select(F.inline(F.array(*pairs))).groupBy("x", "y", "x_value", "y_value").agg(F.count(F.lit(1)).alias(name))


def box_summary(df: DataFrame, group: str, value: str, positive_only: bool = False) -> DataFrame:
    """Min, q1, median, q3, max (linear interpolation), mean and count of
    ``value`` per ``group``; rows with a null group are left out."""
    d = df.where(F.col(group).isNotNull())
    if positive_only:
        d = d.where(F.col(value) > 0)
    v = F.col(value)
    per = d.groupBy(group).agg(F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"),
                               F.avg(v).alias("mean"), F.count(v).alias("n"))
    out = with_group_quantiles(per, d, [group], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return out.select(group, "min", "q1", "median", "q3", "max", "mean", "n")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max]; bin k covers (lo, hi], the
    first bin also holds min.  Columns bin, breakpoint (upper edge), count; empty
    bins are kept, null values are left out.  Only min and max (two scalars)
    reach the driver; the counting is one partial aggregation."""
    spark = df.sparkSession
    v = F.col(value).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    spine = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return spine.select("bin", F.lit(None).cast("double").alias("breakpoint"),
                            F.lit(0).cast("long").alias("count"))
    width = (hi - lo) / bins
    if width > 0:
        b = F.least(F.greatest(F.ceil((v - F.lit(lo)) / F.lit(width)), F.lit(1)), F.lit(bins))
    else:
        b = F.lit(1)
    counts = (df.where(v.isNotNull()).groupBy(b.cast("int").alias("bin"))
                .agg(F.count(F.lit(1)).alias("count")))
    return (F.broadcast(spine).join(counts, "bin", "left")
             .select("bin",
                     (F.lit(lo) + F.col("bin").cast("double") * F.lit(width)).alias("breakpoint"),
                     F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histograms(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """D15 for several columns at once: (column, bin, breakpoint, count), the same
    bins as ``histogram``.  One aggregation gives every min and max (2k scalars
    reach the driver); one pass emits a (column, bin) pair per non-null value and
    counts them with a partial aggregation, so at most k x bins groups per task
    are shuffled."""
    spark = df.sparkSession
    vals = [F.col(c).cast("double") for c in cols]
    mm = df.agg(*[F.min(v).alias(f"lo{i}") for i, v in enumerate(vals)],
                *[F.max(v).alias(f"hi{i}") for i, v in enumerate(vals)]).first()
    spine, pairs = [], []
    for i, (c, v) in enumerate(zip(cols, vals)):
        lo, hi = mm[f"lo{i}"], mm[f"hi{i}"]
        if lo is None:
            spine += [(c, b, None) for b in range(1, bins + 1)]
            continue
        width = (hi - lo) / bins
        spine += [(c, b, lo + float(b) * width) for b in range(1, bins + 1)]
        b = (F.least(F.greatest(F.ceil((v - F.lit(lo)) / F.lit(width)), F.lit(1)), F.lit(bins))
             if width > 0 else F.lit(1))
        pairs.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("column"),
                                                     b.cast("int").alias("bin"))))
    schema = "column string, bin int, breakpoint double"
    axis = spark.createDataFrame(spine, schema)
    if not pairs:
        return axis.withColumn("count", F.lit(0).cast("long"))
    counts = (df.select(F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("_c"))
                .groupBy(F.col("_c.column").alias("column"), F.col("_c.bin").alias("bin"))
                .agg(F.count(F.lit(1)).alias("count")))
    return (F.broadcast(axis).join(counts, ["column", "bin"], "left")
             .select("column", "bin", "breakpoint",
                     F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def global_stats(df: DataFrame, mean_cols: list[str], median_cols: list[str],
                 exact: bool = True) -> DataFrame:
    """One row of means and medians.

    The exact medians of all columns come from one bracket pass each way over the rows
    (``quantiles.column_quantiles``); ``exact=False`` gives ``percentile_approx``."""
    aggs = [F.avg(c).alias(f"average_{c}") for c in mean_cols]
    if not exact:
        aggs += [_approx_median(c).alias(f"median_{c}") for c in median_cols]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    out = df.agg(*aggs)
    if not exact or not median_cols:
        return out
    med = column_quantiles(df, median_cols, [0.5]).agg(*[
        F.max(F.when(F.col("_c") == i, F.col("_q")[0])).alias(f"median_{c}") for i, c in enumerate(median_cols)])
    one = F.lit(0).alias("_one")
    return out.select("*", one).join(med.select("*", one), "_one").select(*[f"average_{c}" for c in mean_cols], *[f"median_{c}" for c in median_cols], "n_rows")


def top_k(df: DataFrame, by: str, k: int = 5, nulls: str = "first",
          tie: list[str] | None = None, fill_zero: list[str] | None = None) -> DataFrame:
    """The k rows with the largest ``by``.  Nulls sort first by default (as in
    the reference); ``tie`` makes the cut at k deterministic.  Runs as a
    distributed partial top-k (TakeOrderedAndProject)."""
    if fill_zero:
        df = df.fillna(0, subset=fill_zero)
    c = F.col(by)
    order = [c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()]
    order += [F.col(t).asc() for t in (tie or [])]
    return df.orderBy(*order).limit(k)


def first_n(df: DataFrame, n: int, order_by: list[str], last: bool = False) -> DataFrame:
    """First (or last) n rows in ``order_by`` order."""
    cols = [F.col(c).desc() if last else F.col(c).asc() for c in order_by]
    return df.orderBy(*cols).limit(n)


def bucket_stats(df: DataFrame, by: str, value: str | None, bucket_of: str, breaks, labels,
                 inner: str = "count", outer: str = "count", order_by: list[str] | None = None,
                 bucket_name: str = "bucket", exact: bool = True) -> DataFrame:
    """Two-level aggregation.

    Level 1 groups rows per author ``by``: ``inner`` is "count" (rows per author),
    "median" or "mean" of ``value``; ``bucket_of`` is the author attribute that is
    binned ("count" = rows per author, else the first value of that column in
    ``order_by`` order).  Level 2 groups authors per ``cut`` bucket: the ``outer``
    statistic of the level-1 value plus the number of authors.  A null bucket is
    dropped."""
    if bucket_of == "count":
        attr = F.count(F.lit(1)).alias("_b")
    else:
        order = F.struct(*[F.col(c) for c in (order_by or [bucket_of])])
        attr = F.min_by(F.col(bucket_of), order).alias("_b")
    if inner == "median" and exact:
        per_author = with_group_quantiles(df.groupBy(by).agg(attr), df, [by], value, [0.5], ["_v"])
    else:
        stat = {"count": lambda: F.count(F.lit(1)), "median": lambda: _approx_median(value), "mean": lambda: F.avg(value)}[inner]()
        per_author = df.groupBy(by).agg(stat.alias("_v"), attr)
    binned = per_author.withColumn(bucket_name, cut("_b", breaks, labels)).where(
        F.col(bucket_name).isNotNull())
    if outer == "median" and exact:
        counts = binned.groupBy(bucket_name).agg(F.count(F.lit(1)).alias("entry_count"))
        out = with_group_quantiles(counts, binned, [bucket_name], "_v", [0.5], ["median_value"])
        return out.select(bucket_name, "median_value", "entry_count")
    outer_stat = {"count": lambda: [], "median": lambda: [_approx_median("_v").alias("median_value")],
                  "mean": lambda: [F.avg("_v").alias("mean_value")]}[outer]()
    return binned.groupBy(bucket_name).agg(*outer_stat, F.count(F.lit(1)).alias("entry_count"))


def row_bucket_stats(df: DataFrame, value: str, bucket_col: str, breaks, labels,
                     bucket_name: str = "bucket", exact: bool = True) -> DataFrame:
    """Median of ``value`` and row count per ``cut`` bucket of a row
    attribute; null bucket dropped."""
    binned = (df.withColumn(bucket_name, cut(bucket_col, breaks, labels))
                .where(F.col(bucket_name).isNotNull()))
    if exact:
        counts = binned.groupBy(bucket_name).agg(F.count(F.lit(1)).alias("entry_count"))
        out = with_group_quantiles(counts, binned, [bucket_name], value, [0.5], ["median_score"])
        return out.select(bucket_name, "median_score", "entry_count")
    return (binned.groupBy(bucket_name)
                  .agg(_approx_median(value).alias("median_score"),
                       F.count(F.lit(1)).alias("entry_count")))

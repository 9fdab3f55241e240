"""Exact quantiles from sketch brackets.

A mergeable rank sketch per group (``percentile_approx``) gives, for every wanted
probability, two values that the order statistic lies between.  One exact pass then
counts: values inside a bracket keep their value, all others collapse to one entry for
each stretch between brackets (count, smallest and largest value), combined in each
task before the shuffle.  Running counts over these few entries point at the order
statistics.  Nothing is sorted but the entries, no group's values meet in one task,
and the plan is the same for a group of three rows and for one that holds a third of
the table: its entries are the distinct values of about 4 / accuracy of its rows.

The counts prove each bracket: a rank that falls into a stretch, other than its first
or last, raises an error instead of giving a near value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000  # of the sketch: ranks are off by at most n / ACCURACY


def bracket_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], name: str = "_q",
                      accuracy: int = ACCURACY) -> DataFrame:
    """The columns of ``group`` (one at least; null is a group) and ``name``: array<double>, the quantile of
    ``value`` for each of ``probs``, interpolated linearly as by ``percentile``.  Groups
    without a non-null value are absent."""
    keys = [f"_k{i}" for i in range(len(group))]
    d = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    eps = 2.0 / accuracy
    grid = [x for p in probs for x in (max(0.0, p - eps), min(1.0, p + eps))]
    sketch = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, grid)), F.lit(accuracy)).alias("_b"))
    sketch = sketch.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_n", "_b")
    bounds = [F.col("_b")[i] for i in range(len(grid))]
    v = F.col("_v")
    cell = _sum([(b < v).cast("int") for b in bounds] + [(b <= v).cast("int") for b in bounds])
    inside = F.lit(False)
    for low, high in zip(bounds[::2], bounds[1::2]):
        inside = inside | v.between(low, high)
    on = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]
    entries = d.join(sketch, on).groupBy(
        *keys, "_n", cell.alias("_cell"), F.when(inside, v).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    running = entries.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell", "_x")))
    found = running.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        F.max(_at(_rank(p, side))).alias(f"_{side}{i}") for i, p in enumerate(probs) for side in ("floor", "ceil")])
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys)],
                        F.array(*[_between(p, F.col(f"_floor{i}"), F.col(f"_ceil{i}")) for i, p in enumerate(probs)]).alias(name))


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _position(p: float) -> Column:
    return (F.col("_n") - 1).cast("double") * F.lit(float(p))


def _rank(p: float, side: str) -> Column:
    return getattr(F, side)(_position(p)).cast("long")


def _at(rank: Column) -> Column:
    """The value of ``rank`` (from 0) if the entry holds it, else null."""
    first, last = F.col("_to") - F.col("_c"), F.col("_to") - 1
    return F.when((rank >= first) & (rank <= last),
                  F.when((F.col("_min") == F.col("_max")) | (rank == first), F.col("_min")).when(rank == last, F.col("_max"))
                  .otherwise(F.raise_error(F.lit("a quantile's bracket does not hold its rank")).cast("double")))


def _between(p: float, a: Column, b: Column) -> Column:
    pos, lo, hi = _position(p), F.floor(_position(p)).cast("double"), F.ceil(_position(p)).cast("double")
    return F.when((hi == lo) | (a == b), a).otherwise((hi - pos) * a + (pos - lo) * b)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One row a column of ``cols`` with values: its place ``_c`` and ``_q``, the
    quantiles over all rows."""
    cells = [F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(cols)]
    return bracket_quantiles(df.select(F.inline(F.array(*cells))), ["_c"], "_value", probs)

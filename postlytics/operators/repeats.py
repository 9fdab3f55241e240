"""Repeat count (F3 / C7): rows with the same key and time in [t - h, t).

The correlated per-row filter of the reference becomes RANGE windows over the
distinct (key, time) pairs:

1. Rows are collapsed to (key, time, multiplicity) -- a partial aggregation, so
   a burst of equal timestamps, however hot, is reduced map-side.
2. The window partition is (key, chunk) with chunk = floor(time / H), H the
   largest horizon asked for: every pair goes to its own chunk and, as a halo
   copy, to the next one, so a look-back [t-h, t), h <= H, lies inside the
   pair's partition.  Times are whole seconds, so a partition holds at most 2H
   pairs whatever the key's share of the rows -- a hot key is split along its
   time line.  Each count is the difference of two growing frames (unbounded ..
   -1) and (unbounded .. -h-1) of summed multiplicities, evaluated
   incrementally.  All horizons share the one window shuffle.
3. The counts go back to the rows with a left equi-join on (key, time); rows
   with a null key or time find no pair and get 0.  AQE's skew-join handling
   splits a hot pair (or the null key) on the row side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from postlytics.functions.timefeat import floor_div


def repeat_counts(df: DataFrame, key: str, time: str, horizons: dict[str, int], rows: DataFrame | None = None) -> DataFrame:
    """Adds one LONG column per ``{name: horizon_seconds}`` to ``rows`` (else to ``df``);
    the rows counted are always those of ``df``."""
    rows = df if rows is None else rows
    cols = rows.columns
    big = max(int(h) for h in horizons.values())
    pairs = (df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
               .groupBy(key, time).agg(F.count(F.lit(1)).alias("_n")))
    chunk = floor_div(F.col(time), big)
    # each pair once at home and once as the halo of the next chunk, from one aggregation
    copies = F.array(F.struct(chunk.alias("c"), F.lit(True).alias("home")),
                     F.struct((chunk + 1).alias("c"), F.lit(False).alias("home")))
    both = (pairs.select(key, time, "_n", F.explode(copies).alias("_x"))
                 .select(key, time, "_n", F.col("_x.c").alias("_c"), F.col("_x.home").alias("_home")))
    w = Window.partitionBy(key, "_c").orderBy(F.col(time).cast("long"))
    upto = F.coalesce(F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = {}
    for name, h in horizons.items():
        before = F.coalesce(F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, -int(h) - 1)),
                            F.lit(0))
        counts[name] = (upto - before).cast("long")
    per_time = both.withColumns(counts).where(F.col("_home")).select(key, time, *horizons.keys())
    # null key or time: no match, count 0
    out = rows.join(per_time, [key, time], "left")
    return out.select(*cols, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in horizons])


def repeat_count(df: DataFrame, key: str, time: str, horizon_seconds: int, name: str) -> DataFrame:
    return repeat_counts(df, key, time, {name: horizon_seconds})

"""Positional operators (F1, F2, F4, F5) without a single-task window.

A window with an ORDER BY but no PARTITION BY runs in one task.  Instead:

* ``with_dense_index`` range-partitions on the order, numbers rows inside each
  partition, and adds per-partition offsets.  Only one count per partition
  reaches the driver (bounded by the partition count); the offsets go back as a
  literal array, so no join is needed.  The numbered frame is checkpointed to the
  shared checkpoint folder first: range bounds are sampled, and both the counts
  and the rows must come from the same partitioning.
* ``forward_features`` (F1 lead differences, F2 rolling medians) uses halo
  buckets: bucket = index div B, and the first n rows of each bucket are copied
  into the previous bucket, so every forward frame of n rows and every lead
  target lies inside one bucket.  Replication <= 1 + n/B.
* ``with_previous``, ``lag_difference`` (F4) and ``step_sums`` scan sorted range
  partitions and carry each partition's last value to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from postlytics.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row in partition


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_index(df: DataFrame, order_by: list[str], name: str = "idx",
                num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """add a 0-based global row index in ``order_by`` order (ascending, nulls
    first).  ``order_by`` must be unique per row.  Returns (frame, row count)."""
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    n = _num_partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = dict(ranged.groupBy(pid.alias("p")).count().collect())
    parts = max(counts) + 1 if counts else 0
    offsets, run = [], 0
    for p in range(parts):
        offsets.append(run)
        run += counts.get(p, 0)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    if parts:
        off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), (pid + 1).cast("int"))
    else:
        off = F.lit(0).cast("long")
    return ranged.withColumn(name, (off + local).cast("long")).drop("_mid"), run


def with_dense_index(df: DataFrame, order_by: list[str], name: str = "idx",
                     num_partitions: int | None = None) -> DataFrame:
    return dense_index(df, order_by, name, num_partitions)[0]


def forward_features(df: DataFrame, order_by: list[str], n: int,
                     leads: dict[str, str] | None = None, medians: dict[str, str] | None = None,
                     bucket_rows: int = 100_000, direction: str = "forward",
                     num_partitions: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """One dense index and one bucket shuffle for both forward operators:

    * ``leads`` {name: col}: ``col[i + n] - col[i]`` (F1), null for the last n rows;
    * ``medians`` {name: col}: median of ``col`` over rows i .. i+n-1, nulls
      skipped (F2), null for the last n rows -- including row N-n, whose frame is
      full (reference rule).

    Rows are bucketed by index div B; the first n rows of each bucket are copied
    into the previous bucket, so every frame and every lead target lies inside
    the bucket of its row.

    ``direction="backward"`` mirrors both: ``col[i] - col[i - n]`` and the median
    of rows i-n+1 .. i, null for the first n rows; the last n rows of a bucket
    are copied into the next one.

    Only the order and value columns are indexed, checkpointed and bucketed; the other
    columns are joined to the result by the order columns, which are unique per row.
    (Rows that share all of them get the values of one of them.)  ``rows``, a frame with
    the order columns, is returned in the place of ``df``: the values still come from all
    rows of ``df``, but only those of ``rows`` and their columns travel."""
    leads, medians = leads or {}, medians or {}
    if bucket_rows < n:
        raise ValueError("bucket_rows must be at least n")
    if direction not in ("forward", "backward"):
        raise ValueError("direction is 'forward' or 'backward'")
    fwd = direction == "forward"
    used = list(dict.fromkeys([*order_by, *leads.values(), *medians.values()]))
    idx, total = dense_index(df.select(*used), order_by, "_idx", num_partitions)
    bucket = F.floor(F.col("_idx") / F.lit(bucket_rows)).cast("long")
    # every row at home; the first (last) n rows of a bucket also as the halo of the
    # previous (next) bucket -- one pass over the indexed rows, replication <= 1 + n / B
    offset = F.pmod(F.col("_idx"), F.lit(bucket_rows))
    if fwd:
        is_halo = (offset < F.lit(n)) & (F.col("_idx") >= F.lit(bucket_rows))
    else:
        is_halo = offset >= F.lit(bucket_rows - n)
    at_home = F.struct(bucket.alias("b"), F.lit(True).alias("home"))
    as_halo = F.struct((bucket - 1 if fwd else bucket + 1).alias("b"), F.lit(False).alias("home"))
    copies = F.when(is_halo, F.array(at_home, as_halo)).otherwise(F.array(at_home))
    both = (idx.withColumn("_x", F.explode(copies))
               .withColumn("_b", F.col("_x.b")).withColumn("_home", F.col("_x.home")).drop("_x"))
    w = Window.partitionBy("_b").orderBy("_idx")
    if fwd:
        frame, cut = w.rowsBetween(0, n - 1), F.col("_idx") < F.lit(total - n)
        new = {name: F.when(cut, F.lead(F.col(c), n).over(w) - F.col(c)) for name, c in leads.items()}
    else:
        frame, cut = w.rowsBetween(-(n - 1), 0), F.col("_idx") >= F.lit(n)
        new = {name: F.when(cut, F.col(c) - F.lag(F.col(c), n).over(w)) for name, c in leads.items()}
    new.update({name: F.when(cut, F.percentile(F.col(c), F.lit(0.5)).over(frame))
                for name, c in medians.items()})
    out = both.withColumns(new).where(F.col("_home"))
    if rows is None and set(df.columns) <= set(used):
        return out.select(*df.columns, *new)
    keys = {f"_k{i}": c for i, c in enumerate(order_by)}
    out = out.select(*[F.col(c).alias(k) for k, c in keys.items()], *new).dropDuplicates(list(keys))
    same = [F.col(c).eqNullSafe(F.col(k)) for k, c in keys.items()]
    return (df if rows is None else rows).join(out, same, "left").drop(*keys)


def time_until_nth_next(df: DataFrame, value: str, n: int = 30, order_by: list[str] | None = None,
                        name: str = "time_on_first_page", direction: str = "forward") -> DataFrame:
    """``value[i + n] - value[i]`` in ``order_by`` order; null for the last n rows."""
    return forward_features(df, order_by or ["time", "id"], n, leads={name: value}, direction=direction)


def rolling_median(df: DataFrame, value: str, n: int = 30, order_by: list[str] | None = None,
                   name: str = "average_score_of_posts_before", bucket_rows: int = 100_000,
                   direction: str = "forward") -> DataFrame:
    """rolling median of ``n`` rows, forward by default (see ``forward_features``)."""
    return forward_features(df, order_by or ["time", "id"], n, medians={name: value},
                            bucket_rows=bucket_rows, direction=direction)


def with_previous(df: DataFrame, value: str, order_by: list[str], name: str = "_prev",
                  num_partitions: int | None = None) -> DataFrame:
    """Each row with ``value`` of the row before it in ``order_by`` order (unique per
    row, nulls first; null for the first row), by a boundary-carry scan.

    Rows are range-partitioned and sorted once and checkpointed; each task shifts its
    own values.  Only the first row of a partition looks across the border: the last
    value of each partition is carried to the next one that has rows, one row a
    partition, and joined to those first rows.  No global index and no self-join."""
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    ranged = cut_lineage(df.repartitionByRange(_num_partitions(df, num_partitions), *keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()))
    place = ranged.schema.fieldNames().index(value)
    names = [*ranged.columns, name, "_head"]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                col = batch.column(place)
                prev = pa.concat_arrays([pa.nulls(1, col.type) if last is None else last, col[:-1]])
                head = pa.array([last is None] + [False] * (batch.num_rows - 1))
                last = col[-1:]
                yield pa.RecordBatch.from_arrays([*batch.columns, prev, head], names)

    shifted = ranged.mapInArrow(shift, StructType([*ranged.schema.fields, StructField(name, ranged.schema[value].dataType),
                                                   StructField("_head", BooleanType())]))
    part = F.shiftright(F.col("_at"), _LOCAL_BITS)
    ends = ranged.groupBy(part.alias("_p")).agg(F.max_by(value, "_at").alias("_end"))
    ends = ends.select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_end"))  # a row a partition
    joined = shifted.join(ends, (part == F.col("_p")) & F.col("_head"), "left")
    return joined.withColumn(name, F.when(F.col("_head"), F.col("_end")).otherwise(F.col(name))).select(*df.columns, name)


def lag_difference(df: DataFrame, value: str, order_by: list[str], name: str = "diff",
                   num_partitions: int | None = None) -> DataFrame:
    """``value[i] - value[i-1]`` in ``order_by`` order (null for the first row)."""
    out = with_previous(df, value, order_by, "_prev", num_partitions)
    return out.withColumn(name, F.col(value) - F.col("_prev")).drop("_prev")


def step_sums(df: DataFrame, value: str, order_by: list[str], num_partitions: int | None = None) -> DataFrame:
    """One row: ``steps``, the sum of (value[i] - value[i-1])^2 in ``order_by`` order,
    ``squares``, the sum of value^2, and ``n``, the rows.  One range shuffle: each task
    adds up its sorted rows and keeps its first and last value; the steps across borders
    are added from these, one row a partition.  A step from or to a null counts nothing."""
    keys = [F.col(c).asc_nulls_first() for c in order_by]
    ranged = (df.select(*order_by, F.col(value).cast("double").alias("_v")).repartitionByRange(_num_partitions(df, num_partitions), *keys)
              .sortWithinPartitions(*keys).select("_v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        steps, squares, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).to_numpy(zero_copy_only=False)  # a null is not a number
                with_last = v if last is None else np.concatenate([[last], v])
                steps.append(float(np.nansum(np.diff(with_last) ** 2)))
                squares.append(float(np.nansum(v ** 2)))
                first, last, n = v[0] if first is None else first, v[-1], n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (
                TaskContext.get().partitionId(), float(first), float(last), math.fsum(steps), math.fsum(squares), n)],
                ["p", "first", "last", "steps", "squares", "n"])

    parts = ranged.mapInArrow(scan, "p long, first double, last double, steps double, squares double, n long")
    step = F.nanvl(F.pow(F.col("first") - F.lag("last").over(Window.orderBy("p")), 2), F.lit(0.0))
    return parts.withColumn("_s", F.coalesce(step, F.lit(0.0))).agg(
        F.sum(F.col("steps") + F.col("_s")).alias("steps"), F.sum("squares").alias("squares"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _row_hash(df: DataFrame):
    """Hash of all of a row's columns: a tie-breaker that splits many rows of one
    value over range partitions (unless the rows are identical) and is the same
    when a lost task is recomputed, unlike a partition id or row position."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    num_partitions: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation between the order statistics at
    ``p * (n - 1)``, as ``percentile``) of several numeric columns, by rank
    selection instead of a value -> count map in one task.

    The non-null values of all columns go into one long frame (column, value),
    which is range-partitioned on (column, value, row hash) -- the hash of the
    whole row lets a value held by many rows spread over several partitions and
    is the same when a task is recomputed -- and checkpointed.
    Per-(partition, column) counts (partitions x columns numbers) give each
    partition's rank offset; the at most 2 x len(probs) rows per column at the
    wanted ranks are then read with one ``isin`` filter on the row id.  Returns
    {column: [quantile per prob]} (None for a column without values)."""
    n_parts = _num_partitions(df, num_partitions)
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    # tie-break by the whole row's content: deterministic when a task is recomputed
    long = (df.select(_row_hash(df).alias("_rh"), F.explode(F.array(*cells)).alias("_x"))
              .select(F.col("_x.c").alias("c"), F.col("_x.v").alias("v"), "_rh")
              .where(F.col("v").isNotNull())
              .withColumn("_tb", F.xxhash64("c", "v", "_rh")).drop("_rh"))
    keys = [F.col("c"), F.col("v"), F.col("_tb")]
    ranged = cut_lineage(long.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
                             .select("c", "v", F.monotonically_increasing_id().alias("_mid")))
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = sorted((r.p, r.c, r["count"]) for r in
                    ranged.groupBy(pid.alias("p"), "c").count().collect())
    # rows of column c inside partition p are contiguous (sorted by c first)
    start_in_part, col_runs = {}, {i: [] for i in range(len(cols))}
    acc, last_p = 0, None
    for p, c, k in counts:              # sorted by partition, then column
        if p != last_p:
            acc, last_p = 0, p
        start_in_part[(p, c)] = acc
        acc += k
        col_runs[c].append((p, k))
    wanted, plan = set(), {}
    for c, runs in col_runs.items():
        total = sum(k for _, k in runs)
        if total == 0:
            continue
        def locate(g, runs=runs, c=c):
            off = 0
            for p, k in runs:
                if g < off + k:
                    return (p << _LOCAL_BITS) | (start_in_part[(p, c)] + g - off)
                off += k
            raise AssertionError("rank out of range")
        for p_i, q in enumerate(probs):
            pos = (total - 1) * q
            lo, hi = math.floor(pos), math.ceil(pos)
            ids = (locate(lo), locate(hi))
            wanted.update(ids)
            plan[(c, p_i)] = (pos, lo, hi, ids)
    values = {}
    if wanted:
        values = {r._mid: r.v for r in ranged.where(F.col("_mid").isin(sorted(wanted))).collect()}
    out = {}
    for c, name in enumerate(cols):
        res = []
        for p_i in range(len(probs)):
            if (c, p_i) not in plan:
                res.append(None)
                continue
            pos, lo, hi, (id_lo, id_hi) = plan[(c, p_i)]
            a, b = values[id_lo], values[id_hi]
            res.append(a if hi == lo or a == b else (hi - pos) * a + (pos - lo) * b)
        out[name] = res
    return out

"""Sampling and splitting.

Randomness is a hash of (id, seed): a row's draw does not depend on partitioning
or on which executor computes it, so re-running a lost task gives the same rows.
The hash is the first 32 bits of md5(id || '#' || seed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlytics.operators.ordering import dense_index


def hash32(id_col: str, seed: int) -> Column:
    h = F.md5(F.concat_ws("#", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, id_col: str, test: float = 0.25, seed: int = 42,
               name: str = "is_test") -> DataFrame:
    """A row is in the test split when hash mod 10000 < test * 10000."""
    cut = int(round(test * 10000))
    return df.withColumn(name, F.pmod(hash32(id_col, seed), F.lit(10000)) < F.lit(cut))


def _reach(counts: list[tuple[int, int]], n: int) -> tuple[int | None, int, int]:
    """Of ascending (value, rows): the value at which ``n`` rows are reached, how many
    of its rows that takes, and how many it has; (None, 0, 0) with fewer rows."""
    for value, rows in counts:
        if rows >= n:
            return value, n, rows
        n -= rows
    return None, 0, 0


def _smallest(h: DataFrame, id_col: str, n: int, counts: list[tuple[int, int]]) -> tuple[Column, DataFrame | None]:
    """The n rows of ``h`` with the smallest (``_h``, id): a filter on ``_h``, and the
    rows at the cut where they are not all wanted.  ``counts`` are the rows per upper
    16 bits of ``_h``; the cut's bucket is counted by its lower 16."""
    if n <= 0:
        return F.lit(False), None
    top, need, _ = _reach(counts, n)
    if top is None:
        return F.lit(True), None
    low = F.col("_h").bitwiseAND(F.lit(0xFFFF)).alias("_b")
    inside = h.where(F.shiftright("_h", 16) == F.lit(top)).groupBy(low).count().collect()
    value, need, size = _reach(sorted((r._b, r["count"]) for r in inside), need)
    cut = (top << 16) | value
    if need == size:
        return F.col("_h") <= F.lit(cut), None
    return F.col("_h") < F.lit(cut), h.where(F.col("_h") == F.lit(cut)).orderBy(id_col).limit(need)


def smallest_by_hash(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest (hash, id): an exact sample without
    replacement of size n.  Two rounds of 16-bit hash-prefix counts (at most
    65,536 numbers each reach the driver) find the cut; no global sort and no
    single-task limit over the big side."""
    h = df.withColumn("_h", hash32(id_col, seed))
    counts = h.groupBy(F.shiftright("_h", 16).alias("_b")).count().collect()
    picked, ties = _smallest(h, id_col, n, sorted((r._b, r["count"]) for r in counts))
    out = h.where(picked)
    return (out.unionByName(ties) if ties is not None else out).drop("_h")


def undersample(df: DataFrame, score: str, id_col: str, limit: float = 10, seed: int = 42) -> DataFrame:
    """All rows with score >= limit plus an equal number of rows with
    score < limit, drawn without replacement.  Too few low rows -> all of them
    (the reference raises); null scores are in neither group.

    One aggregation counts the high rows and the low rows per hash prefix, one the
    prefix at the cut; the result is then one filter over the rows."""
    high, low = F.col(score) >= F.lit(limit), F.col(score) < F.lit(limit)
    h = df.withColumn("_h", hash32(id_col, seed))
    counts = h.groupBy(F.shiftright("_h", 16).alias("_b")).agg(
        F.count_if(high).alias("high"), F.count_if(low).alias("low")).collect()
    n_high = sum(r.high for r in counts)
    picked, ties = _smallest(h.where(low), id_col, n_high, sorted((r._b, r.low) for r in counts))
    out = h.where(high | (low & picked))
    return (out.unionByName(ties) if ties is not None else out).drop("_h")


def sample_rows(df: DataFrame, id_col: str, n: int = 10, seed: int = 42) -> DataFrame:
    """A fixed-size sample (small n: a distributed top-n by hash)."""
    return (df.withColumn("_h", hash32(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h"))


def with_fold_columns(df: DataFrame, ks: dict[str, int], order_by: list[str]) -> DataFrame:
    """Several unstratified fold columns {name: k} from one dense index."""
    idx, n = dense_index(df, order_by, "_i")
    cols = {}
    for name, k in ks.items():
        sizes = [n // k + (1 if f < n % k else 0) for f in range(k)]
        cols[name] = _block_fold(F.col("_i"), sizes)
    return idx.withColumns(cols).drop("_i")


def with_folds(df: DataFrame, k: int, order_by: list[str], stratify: str | None = None,
               name: str = "fold") -> DataFrame:
    """Fold column 0..k-1.

    Without ``stratify``: contiguous blocks in ``order_by`` order, the first
    n mod k folds one row larger (unshuffled k-fold).  With ``stratify``: the
    per-class fold sizes of an unshuffled stratified k-fold -- class c's rows,
    in order, fill folds 0..k-1 with the sizes obtained by dealing the sorted
    labels round-robin over the folds -- assigned in contiguous blocks.  Only
    class counts (bounded by the number of classes) reach the driver."""
    if stratify is None:
        return with_fold_columns(df, {name: k}, order_by)
    counts = sorted((r[0], r[1]) for r in df.groupBy(stratify).count().collect()
                    if r[0] is not None)
    idx, _ = dense_index(df.where(F.col(stratify).isNotNull()), [stratify] + order_by, "_i")
    start, expr = 0, None
    for label, c in counts:
        # positions p in [start, start + c) with p mod k == f
        sizes = [(start + c - 1 - f) // k - (start - 1 - f) // k for f in range(k)]
        local = F.col("_i") - F.lit(start)
        e = _block_fold(local, sizes)
        expr = F.when(F.col(stratify) == F.lit(label), e) if expr is None else expr.when(
            F.col(stratify) == F.lit(label), e)
        start += c
    return idx.withColumn(name, expr).drop("_i")


def _block_fold(i: Column, sizes: list[int]) -> Column:
    expr, edge = None, 0
    for f, s in enumerate(sizes):
        edge += s
        cond = i < F.lit(edge)
        expr = F.when(cond, F.lit(f)) if expr is None else expr.when(cond, F.lit(f))
    return expr.otherwise(F.lit(len(sizes) - 1)).cast("int")

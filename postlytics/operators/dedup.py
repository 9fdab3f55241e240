"""Deduplication (E1-E5) and keyed insert-or-ignore.

First/best-per-key is a ``min_by``/``max_by`` aggregation, not a window: it is
combined map-side, so a key holding a third of all rows is reduced to one row
per map task before the shuffle instead of landing whole in one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _pick(df: DataFrame, key: list[str], order: list, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*[F.col(k) for k in key])
              .agg(pick(row, F.struct(*order)).alias("_row"))
              .select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in df.columns]))


def keep_best(df: DataFrame, key: str | list[str], score: str, tie: str) -> DataFrame:
    """Per key keep the row with the highest ``score``; a null score loses to
    any value; equal scores keep the largest ``tie``.  A null key is one group."""
    key = [key] if isinstance(key, str) else key
    return _pick(df, key, [F.col(score), F.col(tie)], F.max_by)


def first_per_key(df: DataFrame, key: str | list[str], order_by: list[str]) -> DataFrame:
    """First row per key in ``order_by`` order (make it unique)."""
    key = [key] if isinstance(key, str) else key
    return _pick(df, key, [F.col(c) for c in order_by], F.min_by)


def keep_duplicated(df: DataFrame, key: str) -> DataFrame:
    """Keep only rows whose ``key`` occurs at least twice; null key excluded.

    Counting is a partial aggregation; the keys found are semi-joined back
    (AQE splits a skewed key on the probe side)."""
    dup = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") > 1).select(key))
    return df.join(dup, key, "left_semi")


def insert_or_ignore(target: DataFrame, batch: DataFrame, id_col: str, url_col: str,
                     order_by: list[str], not_null: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` inserted into ``target`` with id primary key and
    unique url, where an existing or earlier row wins on either key.

    The batch is first made id-unique (last row per id wins, as when the id->url
    map is built).  Then: drop rows whose id or url already exists in the target,
    drop rows with nulls in NOT NULL columns, and keep the first remaining row per
    url.  With unique ids this equals inserting one row at a time.  Returns the
    rows to append (write with ``write_append``)."""
    cols = batch.columns
    order = F.struct(*[F.col(c) for c in order_by])
    row = F.struct(*[F.col(c) for c in cols])
    # id-unique batch: the url (and row) of the last occurrence, at the position
    # of the first occurrence (a dict keyed by id keeps its first insertion slot)
    b = (batch.groupBy(id_col).agg(F.max_by(row, order).alias("_row"), F.min(order).alias("_pos"))
              .select(*[F.col("_row")[c].alias(c) for c in cols], "_pos"))
    for c in [url_col] + list(not_null or []):
        b = b.where(F.col(c).isNotNull())
    b = b.join(target.select(id_col), id_col, "left_anti")
    b = b.join(target.select(url_col).where(F.col(url_col).isNotNull()), url_col, "left_anti")
    return _pick(b, [url_col], [F.col("_pos")], F.min_by).select(*cols)

"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlytics.llm.common import WHITE, store


def normalised(text: Column) -> Column:
    """The text (null: empty) without the characters of the white-space class."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None, prefix_chars: int = 64) -> DataFrame:
    """One row a row of ``df``: ``doc_id, keep_id, group_size, kept`` and the
    columns of ``carry``.

    Texts are equal when identical after deleting white space.  Three rounds
    narrow the candidates: the normalised length, then a hash of the first
    ``prefix_chars`` characters, then SHA-256 of the whole; only rows whose
    (length, prefix) occurs twice are read in full for the last one.  Of equal
    texts the row with the most code points in the original text stays, then the
    smallest id.  Counts are partial aggregates and the joins back are on keys
    with one row on the small side, so a hot group is split by AQE.

    A null text counts as empty (all empty texts are one group); a null id is
    the last choice.  Rows repeated with the kept row's id all stay, as nothing
    tells them apart: ``kept`` is ``doc_id == keep_id``.  An empty table gives no
    rows.  Other columns are not read."""
    carry = carry or {}
    norm = normalised(F.col(text_col))
    keys = [F.octet_length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_prefix"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars")]
    extra = [c.alias(f"_x_{k}") for k, c in carry.items()]
    kept_extra = [f"_x_{k}" for k in carry]
    narrow = store(df.select(F.col(id_col).alias("doc_id"), *keys, *extra), "exact-keys")

    lengths = narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    # counted before the join on the length, which would bring a hot length's rows to one task
    counted = narrow.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    pairs = counted.join(lengths, "_len", "left_semi").where("_n > 1").drop("_n")
    # the third round: whole texts of the survivors only
    texts = df.select(F.col(id_col).alias("doc_id"), *keys, *extra, norm.alias("_norm"))
    full = store(texts.join(pairs, ["_len", "_prefix"], "left_semi").select(
        "doc_id", "_len", "_chars", *kept_extra, F.sha2("_norm", 256).alias("_full")), "exact-full")
    best = F.min(F.struct((-F.col("_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    groups = full.groupBy("_len", "_full").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_b")).select(
        "_len", "_full", "group_size", F.col("_b.c").alias("keep_id"))
    grouped = full.join(groups, ["_len", "_full"]).select("doc_id", "keep_id", "group_size", *kept_extra)
    alone = narrow.join(pairs, ["_len", "_prefix"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *kept_extra)
    return grouped.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col(f"_x_{k}").alias(k) for k in carry])


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM n),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -chars, b := doc_id)) AS keep_id
      FROM h GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
"""

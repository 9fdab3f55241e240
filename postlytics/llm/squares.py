"""Packing whole documents into sequences by the sum of squares.

Every document is tokenised and ends with an end id.  Documents longer than a
sequence are cut into full sequences and a rest; rests and shorter documents are
placed whole.  Each goes where the sum over all residual gaps of (open sequences with
that gap) squared becomes smallest: into an open sequence, which leaves its gap's
count and joins that of the smaller gap, or into a new one.  Ties go to the smallest
gap that is left.

The rule needs the counts of all open sequences, so it runs in buckets of a fixed
number of documents, dealt by a hash of the document's key and placed longest first,
each in one task on (key, length) rows.  What a bucket fills to the last id stays;
the documents of its other sequences, a fraction, are dealt anew in the next round.
Bucket size and number of rounds do not depend on the data, and the open rest is that
of the last round's few buckets.

Handled without error: a null text counts as empty and is a piece of the end id alone;
each repeated row and null id is a document of its own; an empty table gives no rows;
other columns, whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlytics.llm.common import free_tables, store
from postlytics.llm.packing import tokenised_pieces
from postlytics.llm.tokens import WordBpe

BIN_BITS, ROUND_BIT = 20, 58  # a sequence number: round, bucket, sequence of the bucket


def least_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length, in this order: its sequence (from 0) and offset there; and the
    gap that each sequence is left with."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences with a gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    none = np.iinfo(np.int64).max
    for k, length in enumerate(lengths.tolist()):
        before = counts[length:]  # by the gap that would be left
        change = 2 * (counts[:capacity - length + 1] - before) + 2  # of the sum of squares
        change[0] = 1 - 2 * counts[length]  # full: not counted any more
        change[before == 0] = none
        change[-1] = 2 * counts[capacity - length] + 1 if length < capacity else 0  # a new sequence
        left = int(change.argmin())
        gap = left + length
        if gap < capacity:
            one = stacks[gap].pop()
            counts[gap] -= 1
        else:
            one = len(gaps)
            gaps.append(gap)
        where[k], offset[k], gaps[one] = one, capacity - gap, left
        if left:
            counts[left] += 1
            stacks[left].append(one)
    return where, offset, np.array(gaps, np.int64)


def _round(r: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Places the rows of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        free_tables()
        table = table.sort_by([("length", "descending"), ("_key", "ascending")])
        key, length, bucket = (table.column(c).to_numpy() for c in ("_key", "length", "_bucket"))
        where, offset, gaps = least_squares(length, capacity)
        number = (r << ROUND_BIT) + (bucket << BIN_BITS) + where
        return pa.table({"_key": key, "length": length, "sequence_id": number, "offset": offset, "_gap": gaps[where]})

    return run


def place(rests: DataFrame, capacity: int, rows_a_bucket: int = 4096, rounds: int = 4) -> DataFrame:
    """``rests`` (_key unique, length up to ``capacity``) with ``sequence_id`` and
    ``offset``.  Each round is written to the shared scratch folder."""
    done, rows = [], rests.select("_key", F.col("length").cast("long").alias("length"))
    for r in range(rounds):
        buckets = -(-rows.count() // rows_a_bucket) or 1
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", F.lit(r)), F.lit(buckets).cast("long")))
        placed = store(dealt.groupBy("_bucket").applyInArrow(
            _round(r, capacity), "_key long, length long, sequence_id long, offset long, _gap long"), "squares-round")
        last = buckets == 1 or r == rounds - 1
        done.append(placed if last else placed.where("_gap = 0"))
        if last:
            break
        rows = placed.where("_gap > 0").select("_key", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("_key", "sequence_id", "offset")


def pack_squares(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                 capacity: int = 4096, rows_a_bucket: int = 4096, rounds: int = 4,
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """One row a piece of a document: ``doc_id, piece, start, length, sequence_id,
    offset`` and ``carry``'s columns, by default the piece's ``ids`` (little-endian
    32-bit).  ``tokenizer`` is a file of the kind that ``WordBpe`` reads.  Only
    documents of more than ``capacity`` ids are cut, every ``capacity`` ids; a full
    piece is a sequence of its own, with a negative number.  What is carried is
    computed before the one shuffle that brings pieces and places together."""
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = store(tokenised_pieces(df, tokenizer, id_col, text_col, end_id, capacity, WordBpe).select(
        "_key", "doc_id", (F.col("start") / capacity).cast("int").alias("piece"), "start", "length",
        *[c.alias(name) for name, c in carry.items()]), "squares-pieces")
    rests = pieces.where(F.col("length") < capacity)
    placed = rests.join(place(rests, capacity, rows_a_bucket, rounds), "_key")
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("_key"), "offset": F.lit(0).cast("long")})
    return placed.unionByName(full).drop("_key")

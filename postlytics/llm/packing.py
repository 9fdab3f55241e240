"""Packing documents into training sequences by minimum bin slack.

Every document is tokenised and ends with an end id.  It is cut into full
sequences of ``capacity`` ids and one rest of 1 to capacity - 1 ids.  The rests
are packed: their lengths are a multiset of at most capacity - 1 numbers, whatever
the size of the corpus, so one aggregate brings its counts to the driver.  There,
for the longest rest left, a bitset subset-sum dynamic program finds the lengths
that fill the window closest to capacity; the backtracked multiset is a pattern,
used as often as the counts allow.  Rests that no multiset completes are laid end
to end and cut at the sequence borders.  Which document takes which place follows
from its length and its rank among the documents of that length, so placing is one
pass over narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from postlytics.llm.common import free_tables, slices, small_batches, store, worker_table
from postlytics.llm.tokens import ID, ByteBpe


def tokenised_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 1, capacity: int = 2048, units: type[ByteBpe] = ByteBpe, keep_table: bool = True) -> DataFrame:
    """One row a piece: ``_key`` (unique), ``doc_id``, ``start``, ``length``,
    ``doc_tokens``, ``ids`` (little-endian 32-bit).  All pieces of a document but
    its last have ``capacity`` ids.  ``units`` is the table class that fits the file;
    without ``keep_table`` a worker drops its table when a partition ends, so that the
    next operator of an application finds the memory free."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    end, width = np.array([end_id], ID).tobytes(), capacity * ID.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (TaskContext.get().partitionId() << 40) - 1
        table = worker_table(tokenizer, lambda: units(tokenizer))
        for whole in batches:
            for batch in slices(whole, "text"):
                docs = [table.ids(t) for t in batch.column(1).to_pylist()]
                row, start, ids, total = [], [], [], []
                for i, data in enumerate(docs):
                    data += end
                    for at in range(0, len(data), width):
                        row.append(i)
                        start.append(at // ID.itemsize)
                        ids.append(data[at:at + width])
                        total.append(len(data) // ID.itemsize)
                keys = range(key + 1, key + 1 + len(row))
                key += len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), batch.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()),
                     pa.array([len(x) // ID.itemsize for x in ids], pa.int64()), pa.array(total, pa.int64()),
                     pa.array(ids, pa.binary())],
                    ["_key", "doc_id", "start", "length", "doc_tokens", "ids"])
        if not keep_table:
            free_tables()

    return rows.mapInArrow(run, f"_key long, doc_id {kind.simpleString()}, start long, length long, "
                                "doc_tokens long, ids binary")


def fill(gap: int, counts: dict[int, int]) -> dict[int, int] | None:
    """A multiset of the lengths in ``counts`` that sums to the largest total up to
    ``gap``: subset sums as bits of one integer, each length added in powers of two
    of copies, then backtracked."""
    reach, steps, full = 1, [], (1 << (gap + 1)) - 1
    for length in sorted((x for x in counts if x <= gap and counts[x]), reverse=True):
        left, k = min(counts[length], gap // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach >> gap & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def plan(counts: dict[int, int], capacity: int, max_slack: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (multiset of lengths, number of windows) and the counts of the
    lengths that no pattern takes.  For the longest length left the fill is
    optimal, so when its slack is over ``max_slack`` no later window could take it
    either, and all its copies are left."""
    counts = {k: v for k, v in counts.items() if v}
    patterns, left = [], {}
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = fill(capacity - longest, rest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if capacity - sum(k * n for k, n in chosen.items()) > max_slack:
            left[longest] = counts.pop(longest)
            continue
        times = min(counts[k] // n for k, n in chosen.items())
        patterns.append((chosen, times))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return patterns, left


class Places:
    """Where the rest of a given length and rank goes."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int):
        self.capacity, used, rows, window = capacity, {}, [], 0
        for chosen, times in patterns:
            offset = 0
            for length, n in sorted(chosen.items(), reverse=True):
                rows.append((length, used.get(length, 0), n, window, offset))
                used[length] = used.get(length, 0) + n * times
                offset += length * n
            window += times
        self.patterned, at = window, 0
        for length in sorted(left, reverse=True):  # n = 0: end to end from position ``offset`` of the tail
            rows.append((length, used.get(length, 0), 0, window, at))
            at += length * left[length]
        self.sequences = window + -(-at // capacity)
        rows.sort()
        self.length, self.base, self.n, self.window, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.first = np.searchsorted(self.length, np.arange(capacity + 1))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each rest: (row, cut start, cut length, sequence, offset), two entries
        for a rest that is cut."""
        at = np.empty(len(length), np.int64)
        for one in np.unique(length):
            mine = length == one
            lo, hi = self.first[one], self.first[one + 1]
            at[mine] = lo + np.searchsorted(self.base[lo:hi], rank[mine], side="right") - 1
        t, n = rank - self.base[at], self.n[at]
        tail = n == 0
        n1 = np.maximum(n, 1)
        pos = self.offset[at] + t * length  # in the tail
        seq = self.window[at] + np.where(tail, pos // self.capacity, t // n1)
        off = np.where(tail, pos % self.capacity, self.offset[at] + t % n1 * length)
        head = np.minimum(length, self.capacity - off)
        cut = np.flatnonzero(head < length)
        row = np.arange(len(length))
        return (np.concatenate([row, cut]), np.concatenate([np.zeros_like(row), head[cut]]),
                np.concatenate([head, (length - head)[cut]]), np.concatenate([seq, seq[cut] + 1]),
                np.concatenate([off, np.zeros_like(cut)]))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         capacity: int = 2048, rows_a_bucket: int = 20_000, keep_table: bool = True) -> DataFrame:
    """One row a piece of a document: ``doc_id, start, length, ids, doc_tokens,
    sequence_id, offset``.  The pieces of a sequence lie gapless from offset 0;
    every sequence holds ``capacity`` ids but at most one, the last of the tail.

    A null text counts as empty and gives a piece of the end id alone; each
    repeated row and null id is a document of its own; an empty table gives no
    rows.  Other columns are not read.

    The tokenised pieces are written once to the shared scratch folder.  Ranks are
    counted in buckets of about ``rows_a_bucket`` rows of one length, so a length
    that a third of all documents share is still many groups."""
    pieces = store(tokenised_pieces(df, tokenizer, id_col, text_col, end_id, capacity, keep_table=keep_table), "packing-pieces")
    rests = pieces.where(F.col("length") < capacity).select("_key", "length")
    counts = {r[0]: r[1] for r in rests.groupBy("length").count().collect()}  # under capacity rows
    patterns, left = plan(counts, capacity)
    places = Places(patterns, left, capacity)
    buckets = max(1, sum(counts.values()) // rows_a_bucket)
    rests = rests.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    before = (rests.groupBy("length", "_bucket").count()
              .select("length", "_bucket", (F.sum("count").over(
                  Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before")))
    inner = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_key")) - 1
    ranked = rests.withColumn("_inner", inner).join(before, ["length", "_bucket"]).select(
        "_key", "length", (F.col("_inner") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, *cols = places.find(length, rank)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[row], *cols)],
                                             ["_key", "_cut", "_n", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, "_key long, _cut long, _n long, sequence_id long, offset long")
    part = F.expr("substring(ids, CAST(4 * _cut + 1 AS INT), CAST(4 * _n AS INT))")
    rest_rows = pieces.where(F.col("length") < capacity).join(placed, "_key").select(
        "doc_id", (F.col("start") + F.col("_cut")).alias("start"), F.col("_n").alias("length"), part.alias("ids"),
        "doc_tokens", "sequence_id", "offset")
    full_rows = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.col("_key") + F.lit(places.sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest_rows.unionByName(full_rows)


def pack_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

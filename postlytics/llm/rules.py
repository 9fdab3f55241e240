"""Quality rules: per-text word statistics, and cross-document line frequency
per host.

The line rule: lines are normalised (lower case, runs of white space to one
space, trimmed) and hashed; for each host the distinct documents that hold a line are
counted; a line above the host's limits is boilerplate and removed; a document
that loses more than a share of its words that way is rejected as depleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlytics.llm.common import byte_rows, slices, small_batches

# fixed values: the symbols that are counted, and the base rule's window and limits
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30

_MULTIPLIERS = (np.random.default_rng(8).integers(1, 1 << 62, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of ``WINDOW`` words that is found twice or more in
    the list.  Windows are told apart by a 64-bit sum of word hashes with a
    multiplier for each place."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h ^= h >> np.uint64(29)
    with np.errstate(over="ignore"):
        win = sum(h[i:i + n] * _MULTIPLIERS[i] for i in range(WINDOW))
    order = np.argsort(win, kind="stable")
    same = win[order[1:]] == win[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text.
    ``bytes.split`` splits at space and 09-0D exactly."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    inner = (raw & 0xC0) != 0x80  # the first byte of each code point
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    symbols = int(np.bincount(raw, minlength=256)[list(SYMBOLS.encode())].sum())
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return (len(words), int(np.count_nonzero(inner)) - int(np.count_nonzero(white)), symbols,
            len(lines) - len(set(lines)), repeated_words(words))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, bounds = byte_rows(batch, "text")
            data = raw.tobytes()
            rows = [base_stats(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in zip(*rows))],
                ["_row", "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``_row`` (a hash of the id and text), ``doc_id``, ``text`` and the
    five counts.  A null text has no words."""
    small_batches(df.sparkSession)
    rows = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("doc_id"),
                     F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_stats, f"_row long, doc_id {kind}, text string, n_words long, word_chars long, n_symbols long, "
                                   "n_dup_lines long, n_repeat_words long")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_line_docs: int = 10, min_line_texts: int = 3, max_line_share: float = 0.01,
                  max_line_docs: int = 10_000, max_removed_share: float = 0.5) -> DataFrame:
    """One row a row of ``df``: ``doc_id``, the base statistics, ``base_failed``,
    ``n_lines_removed``, ``removed_words``, ``kept``, ``removed_lines`` (the places of the
    removed lines, counted from 0) and ``text`` without them.

    Documents are told apart by id and text.  A line is above its host's limits when
    more than ``min_line_docs`` documents of the host hold it and these are more than
    ``max_line_share`` of the host's documents or, on a large host, more than
    ``max_line_docs``.  Fewer than ``min_line_texts`` different texts are no evidence,
    so that a much copied clean text is not its own boilerplate.  ``kept`` is false for a base failure and for
    a document that loses more than ``max_removed_share`` of its words.

    All rows of a null host are one host; a null text has no lines and fails the
    base rule; rows repeated with id and text get the same verdict each; a null
    text stays null; an empty table gives no rows.  Other columns are not read."""
    docs = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"), F.col(id_col).alias("doc_id"),
                     F.col(host_col).alias("_host"), F.xxhash64(F.col(text_col)).alias("_text"),
                     F.col(text_col).alias("text"))
    line = F.posexplode(F.split("text", "\n")).alias("_at", "_raw")
    squeezed = F.trim(F.regexp_replace(F.lower("_raw"), r"[\x20\x09-\x0D]+", " "))
    lines = (docs.select("_row", "doc_id", "_host", "_text", line)
             .select("_row", "doc_id", "_host", "_text", "_at", squeezed.alias("_line"))
             .where("_line <> ''")
             .select("_row", "doc_id", "_host", "_text", "_at", F.xxhash64("_line").alias("_hash"),
                     F.size(F.split("_line", " ")).alias("_words")))
    # distinct on all four keys first, so that neither a hot text nor a hot line is one task's
    per_text = (lines.select("_host", "_hash", "_text", "_row").distinct()
                .groupBy("_host", "_hash", "_text").agg(F.count(F.lit(1)).alias("_n")))
    held = (per_text.groupBy("_host", "_hash").agg(F.sum("_n").alias("_docs"), F.count(F.lit(1)).alias("_texts"))
            .where((F.col("_docs") > min_line_docs) & (F.col("_texts") >= min_line_texts)))
    hosts = docs.select("_host", "_row").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    above = (held.join(hosts, held["_host"].eqNullSafe(hosts["_host"]))
             .where((F.col("_docs") > max_line_share * F.col("_host_docs")) | (F.col("_docs") > max_line_docs))
             .select(held["_host"].alias("_h"), F.col("_hash").alias("_k")))
    # a set: a row repeated k times has each of its lines k times among the removed
    removed = (lines.join(above, lines["_host"].eqNullSafe(above["_h"]) & (lines["_hash"] == above["_k"]))
               .groupBy(F.col("_row").alias("_r"), F.col("doc_id").alias("_d"))
               .agg(F.sort_array(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_words").alias("words")))).alias("_x")))
    # split below the join, where a reader that drops the text drops the lines, too
    stats = text_stats(df, id_col, text_col).withColumn("_parts", F.split("text", "\n")).drop("text")
    out = stats.join(removed, (stats["_row"] == removed["_r"]) & stats["doc_id"].eqNullSafe(removed["_d"]), "left")
    out = out.withColumn("removed_lines", F.coalesce(F.col("_x.at"), F.array().cast("array<int>")))
    lost = F.coalesce(F.aggregate("_x", F.lit(0).cast("long"), lambda n, x: n + x["words"]), F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("removed_lines"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.size("removed_lines").cast("long").alias("n_lines_removed"), lost.alias("removed_words"),
        (~failed & (lost <= max_removed_share * F.col("n_words"))).alias("kept"), "removed_lines",
        F.when(F.col("_parts").isNotNull(), rest).alias("text"))


def rules_digest(ruled: DataFrame) -> DataFrame:
    """The counts and verdicts of ``quality_rules`` without its texts."""
    return ruled.drop("removed_lines", "text")


RULES_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
ll AS (SELECT doc_id, source, text, raw, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
lw AS (SELECT * FROM ll WHERE line <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lw GROUP BY 1),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS win FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k),
rw AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
       FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM r WHERE n > 1) GROUP BY 1),
h AS (SELECT source, count(DISTINCT doc_id) AS nd FROM d GROUP BY 1),
f AS (SELECT source, line, count(DISTINCT doc_id) AS n, count(DISTINCT text) AS nt FROM lw GROUP BY 1, 2),
a AS (SELECT f.source, f.line FROM f JOIN h USING (source) WHERE n > 10 AND nt >= 3 AND (n > 0.01 * nd OR n > 10000)),
x AS (SELECT doc_id, count(*) AS n_lines_removed, sum(len(string_split(lw.line, ' ')))::BIGINT AS removed_words
      FROM lw JOIN a ON lw.source = a.source AND lw.line = a.line GROUP BY 1),
o AS (SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
             coalesce(removed_words, 0) AS removed_words
      FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words <= 0.5 * n_words AS kept
FROM o
"""

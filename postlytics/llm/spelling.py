"""Spelling variants: words one edit apart, the more frequent one as the form.

Letters are hashed to a few symbols.  Every word sends the keys of the full one-edit
neighbourhood of its reduced form (itself, each deletion, replacement and insertion
over the few symbols) to the vocabulary, which is keyed by its own reduced forms.
Whatever is one edit apart in letters is at most one edit apart in symbols, so the join
on the key misses nothing; the original strings decide each pair that meets.  The
neighbourhood has (2 length + 1) x symbols entries, where the letters' own alphabet would
give ten times as many; fewer symbols make more words meet for nothing.  A key is a polynomial hash of the reduced string,
computed for an edit from the hashes in front of and behind it, so a long word costs
its length and not its square.

Handled without error: null texts have no words; a null id counts as the empty string;
repeated rows count as often as they stand; an empty table gives no rows; very long words
send their keys in blocks; other columns, whatever their names, are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlytics.llm.common import byte_rows, free_tables, slices, store

# fixed values: word runs are of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the byte C3 and
# one from 80 to BF), with A-Z lower-cased; other characters that begin with a byte above C1
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or 0x80 <= b <= 0xBF or b == 0xC3 else 0x20
                  for b in range(256))
OTHERS = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18  # keys in one Arrow batch, about


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_chars: int = 5,
                most: int = 200_000) -> DataFrame:
    """``word, k``: the runs of whole texts, A-Z lower-cased, added up in each task; a
    table of ``most`` words is sent on and begun anew.  Where ``every`` (0: never) divides
    the crc32 of ``<id>:<run>``, the run slips: it loses the code point at that crc32
    modulo its length.  Words under ``min_chars`` bytes are left out; who wants code
    points filters again."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        counts: dict[bytes, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, bounds = byte_rows(batch, "text")
                for i, name in enumerate(batch.column(0).to_pylist()):
                    data = OTHERS.sub(b" ", raw[bounds[i]:bounds[i + 1]].tobytes())
                    start = zlib.crc32(f"{name}:".encode())
                    for word, k in Counter(data.translate(RUN_BYTES).split()).items():
                        if len(word) < min_chars:
                            continue
                        if every and not (h := zlib.crc32(word, start)) % every:
                            text = word.decode()
                            at = h % len(text)
                            word = (text[:at] + text[at + 1:]).encode()
                        counts[word] = counts.get(word, 0) + k
                    if len(counts) >= most:
                        yield _counted(counts)
                        counts = {}
        yield _counted(counts)

    return rows.mapInArrow(run, "word string, k long")


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "k"])


def vocabulary(counts: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` from ``count_words``: words of enough code points and occurrences."""
    return (counts.where(F.length("word") >= min_chars).groupBy("word").agg(F.sum("k").alias("n"))
            .where(F.col("n") >= min_count))


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol (1 to ``symbols``) of each code point."""
    return (codes.astype(np.uint64) * np.uint64(BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def own_keys(s: np.ndarray) -> np.ndarray:
    """The keys of reduced words of one length (a row a word)."""
    return _sums(s)[0][:, -1] + np.uint64(s.shape[1])


def _sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of symbol x BASE^position (a column more than ``s``), and the powers."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(s.shape[1] + 1, BASE, np.uint64)]))
    sums = np.zeros((s.shape[0], s.shape[1] + 1), np.uint64)
    np.cumsum(s * powers[:s.shape[1]], axis=1, out=sums[:, 1:])
    return sums, powers


def edit_keys(s: np.ndarray, symbols: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every string at most one edit from a reduced word, each string
    once: of equal symbols in a row only the last is deleted, and a symbol is not
    inserted behind its like.  ``s`` holds words of one length, a row a word."""
    n, size = s.shape
    sums, powers = _sums(s)
    total = sums[:, -1:]
    rows = np.arange(n)
    yield rows, total[:, 0] + np.uint64(size)
    wide = max(1, block // n)
    for lo in range(0, size + 1, wide):
        hi = min(lo + wide, size)
        now, ahead = s[:, lo:hi], np.concatenate([s[:, lo + 1:hi + 1], np.zeros((n, 1 if hi == size else 0), np.uint64)], axis=1)
        row, at = np.nonzero(now != ahead)
        dropped = sums[row, lo + at] + (total[row, 0] - sums[row, lo + at + 1]) * np.uint64(INVERSE)
        yield row, dropped + np.uint64(size - 1)
        ends = min(lo + wide, size + 1)  # insertions have one place more
        behind = np.concatenate([np.zeros((n, 1 if lo == 0 else 0), np.uint64), s[:, max(lo - 1, 0):ends - 1]], axis=1)
        for c in range(1, symbols + 1):
            c = np.uint64(c)
            row, at = np.nonzero(now != c)
            yield row, total[row, 0] + (c - now[row, at]) * powers[lo + at] + np.uint64(size)
            row, at = np.nonzero(behind != c)
            front = sums[row, lo + at]
            yield row, front + c * powers[lo + at] + (total[row, 0] - front) * np.uint64(BASE) + np.uint64(size + 1)


def _keyed(words: DataFrame, symbols: int, edits: bool) -> DataFrame:
    """``word, n, _key``: with the key of each word's reduced form or, for ``edits``, of
    every string of its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            length = np.array([len(t) for t in texts], np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                step = max(1, BLOCK // int(size))
                for lo in range(0, len(mine), step):
                    part = mine[lo:lo + step]
                    codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32)
                    s = reduced(codes, symbols).reshape(len(part), size)
                    found = edit_keys(s, symbols) if edits else [(np.arange(len(part)), own_keys(s))]
                    for row, key in found:
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(part[row])).columns, pa.array(key.view(np.int64))],
                                                         ["word", "n", "_key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, _key long")


def near_words(words: DataFrame, symbols: int = 5) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of ``words`` (word, n; distinct words of
    one code point or more) that differ by one inserted, deleted or replaced code point."""
    own = _keyed(words, symbols, False).select(F.col("word").alias("near"), F.col("n").alias("near_n"), "_key").hint("shuffle_hash")
    meet = _keyed(words, symbols, True).select("word", "_key").join(own, "_key")
    return (meet.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")
            .dropDuplicates(["word", "near"]))  # two edits of one word could share a hash


def spelling_variants(words: DataFrame, symbols: int = 5, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (word, n;
    distinct, of one code point or more).  The form is the near word of largest n, the
    first in code-point order among equals, if its n is at least ``ratio`` (2 or more)
    times the word's; the root is where following the forms ends.  Counts grow along
    forms, so there are no cycles, and roots are found by doubling: each step, written to
    the shared scratch folder, halves the way that is left."""
    words = store(words.select("word", "n"), "spelling-words")
    best = near_words(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("_best"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("_best.n") >= ratio * F.col("n"), F.col("_best.near")).alias("form"),
        F.when(-F.col("_best.n") >= ratio * F.col("n"), -F.col("_best.n")).alias("form_n"))
    found = store(found, "spelling-forms")
    ways = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = store(ways.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                          F.col("_next").isNotNull().alias("_moved")), "spelling-ways")
        ways = step.select("word", "root")
        if step.where("_moved").isEmpty():
            break
    return found.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """The variants among the words of whole texts, with slips."""
    return spelling_variants(vocabulary(count_words(df, id_col, text_col, every)))


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return table


# crc32 byte by byte over the table of its 256 steps; near words meet on equal strings
# after one deletion on either side (at the same place for a replacement)
SPELLING_SQL = f"""
WITH RECURSIVE steps AS (SELECT {_crc_table()}::BIGINT[] AS crc),
raw AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, '{UPPER}', '{LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS r FROM documents)
),
per_doc AS (SELECT id, run, count(*) AS k FROM raw GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i - 1 AS INT), 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INT) + 1]))) AS h
  FROM per_doc, steps
),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n,
    (SELECT min(near) FROM near x WHERE x.word = w.word AND x.near_n = b.top AND b.top >= 2 * w.n) AS form
  FROM words w LEFT JOIN best b ON w.word = b.word
),
way AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON f.word = way.next
)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word AND way.next IS NULL
"""

"""How far the sources of a language diverge in their terms, with late strings.

Each task counts the terms of its own texts and writes one row a (language, source,
term) with the term's 64-bit digest.  From there on only digests and counts are read
and shuffled.  The strings are looked at twice: the smallest and the largest string of
each digest that may be kept show whether texts share it (such digests are split and
counted by string), and the few terms of the result get their text back by a join.  A
digest's document count is never below that of any of its terms, so no term that is
to be kept hides under a digest that is not.

Handled without error: null text, language or source counts as ''; repeated rows count
as often as they stand; a group without terms still has its rows of part ``pair``; an
empty table gives no rows; other columns, whatever their names, are not read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlytics.llm.common import byte_rows, free_tables, slices, store

# fixed values: terms are runs of A-Z, a-z and what is not ASCII, with A-Z lower-cased;
# in UTF-8 these are the bytes of the letters and all bytes from 0x80 on
TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCALE = 1_000_000_000
DOC = 1 << 40  # a task counts documents in steps of this and occurrences below it

TERM = ["lang", "digest", "slot"]


def term_digest(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def task_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                digest: Callable[[bytes], int] = term_digest, strings: bool = False, most: int = 600_000) -> DataFrame:
    """``lang, source, digest, n, docs, term``: occurrences and documents of each term's
    digest, added up in each task; a table of ``most`` entries is sent on and begun anew.
    The strings come in rows of their own (digest and term, no language), once a task
    as far as its table of digests reaches; a group's row without a digest says that it
    occurs.  With ``strings`` every row has its term and there are no rows of strings
    alone."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                       for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    names = ["lang", "source", "digest", "n", "docs", "term"]

    def out(counts: dict, digests: dict) -> Iterator[pa.RecordBatch]:
        new = []
        for (lang, source), terms in counts.items():
            ids = [None]
            for term in terms:
                found = digests.get(term)
                if found is None:
                    found = digests[term] = digest(term) & (1 << 64) - 1
                    new.append(term)
                ids.append(found)
            both = np.array([0, *terms.values()], np.int64)
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(ids, pa.uint64()).view(pa.int64()),
                 pa.array(both % DOC), pa.array(both // DOC),
                 pa.array([None, *terms], pa.binary()).cast(pa.string()) if strings else pa.nulls(k, pa.string())], names)
        if strings:
            return
        none = [pa.nulls(len(new), t) for t in (pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [none[0], none[0], pa.array([digests[t] for t in new], pa.uint64()).view(pa.int64()), none[1], none[1],
             pa.array(new, pa.binary()).cast(pa.string())], names)
        if len(digests) > 2 * most:
            digests.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables()
        counts, digests, held = {}, {}, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, bounds = byte_rows(batch, "text")
                for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    terms = counts.setdefault(group, {})
                    held -= len(terms)
                    for term, k in Counter(raw[bounds[i]:bounds[i + 1]].tobytes().translate(TERM_BYTES).split()).items():
                        terms[term] = terms.get(term, 0) + DOC + k
                    held += len(terms)
                    if held >= most:
                        yield from out(counts, digests)
                        counts, held = {}, 0
        yield from out(counts, digests)

    return rows.mapInArrow(run, "lang string, source string, digest long, n long, docs long, term string")


def kept_counts(base: DataFrame, min_docs: int, recount: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """From the stored task counts with digests: ``lang, source, digest, slot, n, n_lang``
    of the terms in at least ``min_docs`` documents of the language, and the names
    ``digest, slot, term``.  Slot 0 is a digest that one string has; the strings of a
    shared digest are numbered from 1, and ``recount`` gives their counts in a second
    pass over the texts, by string."""
    counts = store(base.where("lang IS NOT NULL AND digest IS NOT NULL").groupBy("lang", "source", "digest").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    often = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    often = store(often.select("digest").distinct(), "divergence-often")  # its size is known, so Spark can pick the join
    strings = base.where("term IS NOT NULL").select("digest", "term")
    names = store(strings.join(often, "digest", "left_semi").groupBy("digest").agg(
        F.min("term").alias("low"), F.max("term").alias("high")), "divergence-names")
    counts = counts.withColumn("slot", F.lit(0))
    shared = names.where("low <> high").select("digest")
    names = names.where("low = high").select("digest", F.lit(0).alias("slot"), F.col("low").alias("term"))
    if not shared.isEmpty():
        slots = store(strings.join(shared, "digest", "left_semi").distinct().withColumn(
            "slot", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "divergence-slots")
        parted = recount(slots).groupBy("lang", "source", "digest", "slot").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = counts.join(shared, "digest", "left_anti").unionByName(parted)
        names = names.unionByName(slots.select("digest", "slot", "term"))
    kept = counts.groupBy(*TERM).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    return store(counts.drop("docs").join(kept.drop("docs"), TERM), "divergence-kept"), names


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), exact: the product is a decimal."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * terms).cast("decimal(21,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so it fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = 10, top: int = 10, digest: Callable[[bytes], int] = term_digest) -> DataFrame:
    """``lang, source, part, item, value, rank``.  Part ``pair``: each other source of
    the language and the sum of ``gap`` over all kept terms; part ``term``: the ``top``
    terms that the source has more of than its language.

    The sum of a pair is that of two sources without terms, corrected for the terms that
    either has (from the counts of its distinct shares) and for those that both have (a
    join on the term), so that no row is made for a term that neither has.  A language
    with s sources has s (s - 1) rows of part ``pair``; that many is the result itself."""
    base = store(task_counts(df, text_col, lang_col, source_col, digest), "divergence-base", "snappy")  # digests hardly shrink

    def recount(slots: DataFrame) -> DataFrame:
        texts = task_counts(df, text_col, lang_col, source_col, digest, strings=True)
        return texts.drop("digest").join(slots, "term")

    kept, names = kept_counts(base, min_docs, recount)
    size = kept.select(*TERM, "n_lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    groups = (base.where("lang IS NOT NULL").select("lang", "source").distinct()
              .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(size, "lang", "left").na.fill(0, ["total", "terms", "total_lang"])
              .withColumn("rest", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))))  # of an absent term
    groups = store(groups, "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        *TERM, "source", "rest", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"))
    shares = store(shares, "divergence-shares")
    return _pairs(groups, shares).unionByName(_terms(shares, names, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    a, b = groups.alias("a"), groups.select("lang", "source", "rest").alias("b")
    none = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(
        "a.lang", F.col("a.source").alias("x"), F.col("b.source").alias("y"),
        F.coalesce(F.col("terms") * gap(F.col("a.rest"), F.col("b.rest")), F.lit(0)).alias("value"))
    same = shares.groupBy("lang", "source", "rest", "p").agg(F.count(F.lit(1)).alias("k")).alias("a")
    one = same.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        "a.lang", F.least("a.source", "b.source").alias("x"), F.greatest("a.source", "b.source").alias("y"),
        (F.col("k") * (gap(F.col("p"), F.col("b.rest")) - gap(F.col("a.rest"), F.col("b.rest")))).alias("value"))
    l, r = shares.drop("q").alias("l"), shares.drop("q").alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in TERM] + [F.col("l.source") < F.col("r.source")]
    both = l.join(r, on).select(
        "l.lang", F.col("l.source").alias("x"), F.col("r.source").alias("y"),
        (gap(F.col("l.p"), F.col("r.p")) - gap(F.col("l.p"), F.col("r.rest")) - gap(F.col("l.rest"), F.col("r.p"))
         + gap(F.col("l.rest"), F.col("r.rest"))).alias("value"))
    found = none.unionByName(one).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    found = found.select("lang", "value", F.inline(sides))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """Ties at the last rank keep their digests until the strings decide."""
    scored = shares.where(F.col("p") > F.col("q")).select(*TERM, "source", gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = scored.withColumn("_rank", F.rank().over(by_value)).where(F.col("_rank") <= top)
    named = first.join(names, ["digest", "slot"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
raw AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
by_doc AS (SELECT r, lang, source, term, count(*) AS n FROM raw GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM by_doc GROUP BY ALL HAVING count(*) >= 10),
counts AS (SELECT b.lang, b.source, b.term, sum(b.n) AS n FROM by_doc b SEMI JOIN kept k ON b.lang = k.lang AND b.term = k.term GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.n + 2 * s.v) AS p,
    1 + CAST({SCALE} AS HUGEINT) * (k.n + 2) // (s.n + 2 * s.v) AS q
  FROM groups g JOIN size s ON g.lang = s.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""

"""Keyword passes and word frequencies (I10, C8, I8 passes, D16, D17).

Keyword lists arrive as Python lists or as DataFrames.  A Python list is part of
the plan: a literal set in the projection (no join).  A DataFrame, of any size, is
joined to the exploded words; Spark chooses the join from the list's bytes.  Both
give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from postlytics.functions.text import keyword_counted, keyword_flag, keyword_matches, tokens
from postlytics.functions.urls import STORE_LABELS, domain_candidates, url_domain_keyword


def keyword_table(keywords: DataFrame) -> DataFrame:
    """(_w, _at): the distinct lower-case words of the first column of ``keywords``
    and the place of each in the list, which is the second column if there is one,
    else the word itself (alphabetical).  Null and empty words go."""
    word = F.lower(F.col(keywords.columns[0]))
    at = F.col(keywords.columns[1]) if len(keywords.columns) > 1 else word
    return (keywords.select(word.alias("_w"), at.alias("_at")).where(F.col("_w") != "")
                    .groupBy("_w").agg(F.min("_at").alias("_at")))


def row_key(text: str, id_col: str | None) -> Column:
    """What matches are grouped by: ``id_col``, unique per row, or else the hash of
    the text, as rows of one text have the same matches."""
    return F.col(id_col) if id_col is not None else F.sha2(F.col(text), 256)


def listed_words(df: DataFrame, text: str, words: Column, listed: DataFrame, id_col: str | None = None) -> DataFrame:
    """``df`` with ``_words``: those of its ``words`` (an array made from column
    ``text``) that ``listed`` (_w) holds, in text order, repeats kept.  Rows of one
    text that share a key add the same (position, word) pairs, which the set keeps
    once, so a text that many rows hold is reduced before the shuffle."""
    df = df.withColumn("_key", row_key(text, id_col))
    hits = (df.select("_key", F.posexplode(words).alias("_pos", "_w"))
              .join(listed.select("_w"), "_w", "inner")
              .groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("_pos", "_w"))).alias("_hits")))
    kept = F.coalesce(F.transform("_hits", lambda s: s["_w"]), F.array().cast("array<string>"))
    return df.join(hits, "_key", "left").withColumn("_words", kept).drop("_key", "_hits")


def default_stop_words(spark: SparkSession | None = None) -> list[str]:
    """The English stop-word list of ``plans.fixed`` (no JVM needed)."""
    from postlytics.plans.fixed import ENGLISH_STOP_WORDS
    return list(ENGLISH_STOP_WORDS)


def title_keywords(df: DataFrame, title: str, keywords, name: str, counted: bool = False,
                   id_col: str | None = None, words: Column | None = None) -> DataFrame:
    """Adds ``{name}_detail`` and ``contains_{name}``.

    flag mode: first matching word (or null) and 1/0; counted mode: the list of
    all matches and its size.  Null or empty title -> (null, 0).  ``id_col``, if
    given, is unique per row and spares a keyword DataFrame's join the text hash.
    ``words``, the title's ``tokens`` as a column of ``df``, spares several passes over
    one title their own.  The matches are a column, found once for detail and flag."""
    fn = keyword_counted if counted else keyword_flag
    words = tokens(title) if words is None else words
    if isinstance(keywords, list):
        found = df.withColumn("_words", keyword_matches(title, keywords, words))
    else:
        found = listed_words(df, title, words, keyword_table(keywords), id_col)
    detail, flag = fn(title, [], matches=F.col("_words"))
    return found.withColumns({f"{name}_detail": detail, f"contains_{name}": flag}).drop("_words")


def url_keywords(df: DataFrame, url: str, keywords, name: str, id_col: str | None = None,
                 lower_url: bool = False) -> DataFrame:
    """Adds ``{name}_detail`` and ``contains_{name}`` from the url domain (I8).
    Of keywords that match at the same place the first of the list wins; a keyword
    DataFrame gives the order in a second column (else alphabetical).  ``id_col``
    as in ``title_keywords``."""
    if isinstance(keywords, list):
        detail, flag = url_domain_keyword(url, keywords, lower_url)
        return df.withColumns({f"{name}_detail": detail, f"contains_{name}": flag})
    return _url_keywords_join(df, url, keywords, name, id_col, lower_url)


def _url_keywords_join(df, url, kw_df, name, id_col, lower_url: bool = False):
    """Join form of the url pass: candidates (``domain_candidates``) equi-joined with
    the keyword table; per url the match at the largest position wins, then the
    keyword that comes first in the list; a store label before it rejects the url,
    as in the pattern form."""
    df = df.withColumn("_key", row_key(url, id_col))
    src = df.select("_key", (F.lower(F.col(url)) if lower_url else F.col(url)).alias("_lu"))
    hits = (domain_candidates(src, "_lu", "_key")
              .join(keyword_table(kw_df).withColumnRenamed("_w", "candidate"), "candidate", "inner")
              .groupBy("_key")
              .agg(F.min(F.struct((-F.col("pos")).alias("p"), "_at", F.col("candidate").alias("kw"),
                                  F.col("label").alias("label"))).alias("_m")))
    ok = F.col("_m").isNotNull() & ~F.col("_m.label").isin(*STORE_LABELS)
    return (df.join(hits, "_key", "left")
              .withColumns({f"{name}_detail": F.when(ok, F.col("_m.kw")),
                            f"contains_{name}": F.when(ok, 1).otherwise(0).cast("int")})
              .drop("_m", "_key"))


def title_words(df: DataFrame, text: str, order_by: list[str], stop_words: list[str]) -> DataFrame:
    """One row per kept word: (order columns..., pos, word); stop words removed,
    null texts skipped."""
    sw = sorted(set(stop_words))
    # ``isin`` over many literals is a hash-set probe (InSet), not a list scan
    kept = F.filter(tokens(text), (lambda w: ~w.isin(*sw)) if sw else (lambda w: F.lit(True)))
    return (df.where(F.col(text).isNotNull())
              .select(*order_by, F.posexplode(kept).alias("pos", "word")))


def word_counts(df: DataFrame, text: str, stop_words: list[str], order_by: list[str]) -> DataFrame:
    """Frequency of every word over all texts; stop words removed."""
    return (title_words(df, text, order_by, stop_words)
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def _first_key(df: DataFrame, order_by: list[str]):
    """Sort key of a word occurrence (order columns, then position).  One
    integral order column packs with the position into one DECIMAL(38,0),
    ``order * 2^32 + pos`` (order preserving), so ``min`` stays a hash
    aggregation; otherwise a struct, which Spark aggregates by sorting."""
    if len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, IntegralType):
        d = "decimal(38,0)"
        return (F.col(order_by[0]).cast(d) * F.lit(1 << 32).cast(d) + F.col("pos").cast(d)).cast(d)
    return F.struct(*[F.col(c) for c in order_by], F.col("pos"))


def top_words(df: DataFrame, text: str, stop_words: list[str], order_by: list[str],
              n: int = 90) -> DataFrame:
    """The n most frequent words; equal counts are ordered by first
    appearance (text order, then word position).  Columns word, count, rank."""
    first = _first_key(df, order_by)
    counts = (title_words(df, text, order_by, stop_words)
                .groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("_first")))
    top = counts.orderBy(F.col("count").desc(), F.col("_first").asc()).limit(n)
    # n rows: numbering them needs no distributed index
    from pyspark.sql.window import Window
    w = Window.orderBy(F.col("count").desc(), F.col("_first").asc())
    return top.select("word", "count", F.row_number().over(w).cast("long").alias("rank"))

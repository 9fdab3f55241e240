"""Pipelines over posts and pages (M1-M4).

M1 ``build_features``: the post feature table -- snapshot join, time features,
lengths, topic one-hot, front-page lead and rolling median, hourly front-page median,
repeat-url counts, keyword passes, buzzword counts.  Every step is a
projection, a partial aggregation, a keyed join or a bucketed window; the
ordered steps share one dense index, the repeat counts share one shuffle.
What is measured over all posts (index, medians, repeats) reads narrow rows held once;
whole rows are joined to the results, after the topics, by whose key they already lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlytics.functions.text import char_length, concat_text, length_bucket, tokens
from postlytics.functions.timefeat import epoch_hour, hour_of_day, weekday, weekday_one_hot
from postlytics.operators import explore, keywords, ordering, repeats
from postlytics.operators.dedup import first_per_key, insert_or_ignore
from postlytics.operators.html import html_to_text
from postlytics.operators.textclean import clean_pages
from postlytics.plans import fixed
from postlytics.session import cut_lineage


def join_snapshots(left: DataFrame, right: DataFrame, on: str = "id", how: str = "inner",
                   suffix: str = "_right") -> DataFrame:
    """Equi-join two snapshots; right columns that clash get ``suffix``."""
    clash = set(left.columns) & set(right.columns) - {on}
    r = right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns])
    return left.join(r, on, how)


def infer_keywords(df: DataFrame, title_lists: dict, url_lists: dict,
                   title: str = "title", url: str = "url", id_col: str = "id") -> DataFrame:
    """M2: one keyword pass per list; each adds ``{name}_detail`` and
    ``contains_{name}``.  Title lists match whole words (flag mode), url lists
    match domain labels.  Python lists are one projection, DataFrames are joined on ``id_col``.
    A title is split into words once for all title lists."""
    if title_lists:
        df = df.withColumn("_tokens", tokens(title))
    for name, words in title_lists.items():
        df = keywords.title_keywords(df, title, words, name, id_col=id_col, words=F.col("_tokens"))
    df = df.drop("_tokens")
    for name, words in url_lists.items():
        df = keywords.url_keywords(df, url, words, name, id_col=id_col)
    return df


def keyword_reports(df: DataFrame, names: list[str], value: str = "score") -> dict:
    """The D13 counts and D14 box summaries behind each keyword pass's chart.  The
    passes run once: their flags and the value are checkpointed for all reports."""
    df = cut_lineage(df.select(value, *[f"contains_{name}" for name in names]))
    out = {}
    for name in names:
        flag = f"contains_{name}"
        out[f"{name}_counts"] = explore.value_counts(df, flag)
        out[f"{name}_box"] = explore.box_summary(df, flag, value, positive_only=True)
    return out


def topic_one_hot(topics: DataFrame, topic: str = "topic", k: int = 10, prefix: str = "topic_") -> list:
    """K 0/1 INT columns; an unknown topic gives all zeros."""
    return [(F.col(topic) == F.lit(i)).cast("int").alias(f"{prefix}{i}") for i in range(k)]


def build_features(posts30: DataFrame, posts240: DataFrame, front_page: DataFrame,
                   title_lists: dict | None = None, url_lists: dict | None = None,
                   stop_words: list[str] | None = None, topics: DataFrame | None = None,
                   order_by: list[str] | None = None, n_front: int = fixed.FRONT_PAGE_ROWS,
                   buzzword_count: int = fixed.BUZZWORD_COUNT,
                   bucket_rows: int = 100_000, dedupe_by: str | None = None) -> DataFrame:
    """M1.  ``posts30``/``posts240``: id, time, title, url, text, score,
    minutes_since_pub (+ any); ``front_page``: id, title, time, minutes_since_pub,
    score (several rows per id); ``topics``: id, topic, length.

    Buzzwords count front-page titles once per snapshot, as the reference does;
    ``dedupe_by="id"`` counts each post's title once (its first snapshot)."""
    order_by = order_by or ["time", "id"]
    stop_words = stop_words if stop_words is not None else keywords.default_stop_words()
    df = join_snapshots(posts30, posts240, "id")
    df = df.withColumns({
        "weekday": weekday("time", fixed.WEEKDAY_SHIFT_SECONDS),
    })
    df = df.select("*", *weekday_one_hot("time", fixed.WEEKDAY_SHIFT_SECONDS))
    df = df.withColumns({
        "hour": hour_of_day("time"),
        "title_length": char_length("title"),
        "body_length": char_length("text", null_as_zero=True),
        "scraped_at_hour": epoch_hour("time", "minutes_since_pub"),
    })
    posts = cut_lineage(df.select(*dict.fromkeys([*order_by, "time", "score", "url"])))
    topic_columns = []
    if topics is not None:  # an inner join: a post without topic is measured with, but not returned
        t = topics.select(F.col("id"), *topic_one_hot(topics),
                          F.col("length").alias("document_length"))
        topic_columns = t.columns[1:]
        df = df.join(t, "id", "inner")
    df = ordering.forward_features(posts, order_by, n_front,
                                   leads={"time_on_first_page": "time"},
                                   medians={"average_score_of_posts_before": "score"},
                                   bucket_rows=bucket_rows, rows=df)
    fp = front_page.withColumn("scraped_at_hour", epoch_hour("time", "minutes_since_pub"))
    df = explore.attach_group_median(df, fp, "scraped_at_hour", "score", "hourly_median_fp_score")
    df = repeats.repeat_counts(posts, "url", "time", {f"count_last_{h}h": h * 3600
                                                      for h in fixed.REPEAT_HORIZONS_HOURS}, rows=df)
    df = infer_keywords(df, title_lists or {}, url_lists or {})
    df = df.select(*[c for c in df.columns if c not in topic_columns], *topic_columns)
    fp_titles = front_page.select("id", "time", "title")
    if dedupe_by is not None:
        fp_titles = first_per_key(fp_titles, dedupe_by, ["time", "title"])
    top = keywords.top_words(fp_titles, "title", stop_words, ["time", "id"], buzzword_count)
    words = [r.word for r in top.collect()]      # at most ``buzzword_count`` words
    return keywords.title_keywords(df, "title", words, "buzzwords", counted=True)


def page_text(pages: DataFrame, target: DataFrame | None = None, id_col: str = "id",
              url_col: str = "url", html_col: str = "html", order_by: list[str] | None = None):
    """M3: fetched pages -> (rows to append to the page table, their plain text).

    ``pages`` (id, url, html) plays the part of the fetch results; rows clashing
    with ``target`` on id or url, or earlier in the batch on url, are ignored."""
    order_by = order_by or [id_col]
    new = pages if target is None else insert_or_ignore(target, pages, id_col, url_col, order_by,
                                                         not_null=[html_col])
    return new, html_to_text(new, id_col, html_col, "plain")


def prepare_documents(plain: DataFrame, posts: DataFrame, dictionary, stop_words: list[str],
                      id_col: str = "id") -> DataFrame:
    """M4: plain page text right-joined to posts, posts without title dropped, page
    text and post text cleaned (I13), length bucket of the cleaned page (I6),
    Document = title + ' ' + text + ' ' + page (I15).  Columns Id, Document, Length."""
    d = plain.join(posts, id_col, "right").where(F.col("title").isNotNull())
    d = clean_pages(d, "plain", dictionary, stop_words, out="_doc", id_col=id_col)
    d = clean_pages(d, "text", dictionary, stop_words, out="_text", id_col=id_col)
    return d.select(F.col(id_col).alias("Id"),
                    concat_text("title", "_text", "_doc").alias("Document"),
                    length_bucket("_doc").alias("Length"))

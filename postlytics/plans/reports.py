"""Report pipelines (M6 exploration, M7 front page): named result DataFrames.

Each entry is the data behind one chart or printed table of the studied
analysis; nothing is drawn.  Every entry is a lazy DataFrame built from the
operators in ``postlytics.operators`` -- only the scalars some operators need
to lay out bins (min and max) are computed while the report is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlytics.functions.text import char_length, flag_pattern
from postlytics.functions.timefeat import hour_of_day, weekday
from postlytics.operators import dedup, explore
from postlytics.operators.parts import Parts
from postlytics.plans import fixed


def front_page_report(front_page: DataFrame, posts: DataFrame, order_by: list[str],
                      mean_cols: list[str], median_cols: list[str], hist_cols: list[str],
                      key: str = "id", title: str | None = None, bins: int = 10) -> Parts:
    """M7: C1 -> E2 -> A14, D1, D2, D15.

    ``front_page`` holds several snapshots per ``key``; ``posts`` one row per
    ``key`` (its clashing columns get the suffix ``_right``).  The first snapshot
    per key in ``order_by`` order is taken *before* the inner join: with one post
    row per key the result is the same, and the join then sees one row per key
    instead of one per snapshot.  Returns ``summary`` (n_rows, average_*,
    median_*) and ``histograms`` (column, bin, breakpoint, count), each built when
    it is asked for."""
    from postlytics.plans.features import join_snapshots
    first = dedup.first_per_key(front_page, key, order_by)
    d = join_snapshots(first, posts, key, "inner")
    if title is not None:
        d = d.withColumn("title_length", char_length(title))
    return Parts({"summary": lambda: explore.global_stats(d, mean_cols, median_cols),
                  "histograms": lambda: explore.histograms(d, hist_cols, bins)})


def _flag_report(df: DataFrame, patterns: dict, text: str, value: str) -> dict:
    out = {}
    flagged = df.select(value, *[flag_pattern(text, p).alias(n) for n, p in patterns.items()])
    for name in patterns:
        out[f"{name}_counts"] = explore.value_counts(flagged, name)
        out[f"{name}_box"] = explore.box_summary(flagged, name, value)
    return out


def exploration_report(posts: DataFrame, title_patterns: dict | None = None,
                       url_patterns: dict | None = None) -> dict:
    """M6 over posts (id, time, by, score, descendants, title, url, user_karma,
    user_post_count): top lists (G1, G2), distributions (D6, D7, D20), time
    means and medians (I1, I3, D4, D5), author and karma buckets (D8-D11), and
    substring flags with their counts and box summaries (I7, D13, D14) on posts
    deduplicated by title and by url, keeping the best score per key (E1)."""
    title_patterns = fixed.TITLE_FLAG_PATTERNS if title_patterns is None else title_patterns
    url_patterns = fixed.URL_FLAG_PATTERNS if url_patterns is None else url_patterns
    timed = posts.withColumns({"weekday": weekday("time", fixed.WEEKDAY_SHIFT_SECONDS),
                               "hour": hour_of_day("time")})
    out = {
        "top_scores": explore.top_k(posts, "score", 5, tie=["id"]),
        "top_comments": explore.top_k(posts, "descendants", 5, tie=["id"], fill_zero=["descendants"]),
        "score_counts": explore.value_counts(posts, "score"),
        "weekday_mean": explore.group_stat(timed, "weekday", "score", "mean", "average_score"),
        "hour_mean": explore.group_stat(timed, "hour", "score", "mean", "average_score"),
        "hour_median": explore.group_stat(timed, "hour", "score", "median", "median_score"),
        "score_by_comments": explore.point_counts(posts, "descendants", "score"),
        "posts_per_author": explore.bucket_stats(
            posts, "by", None, "count", fixed.POSTS_PER_AUTHOR_BREAKS,
            fixed.POSTS_PER_AUTHOR_LABELS, bucket_name="posts_in_period"),
        "karma_points": explore.point_counts(posts, "user_karma", "score"),
        "karma_buckets": explore.row_bucket_stats(posts, "score", "user_karma", fixed.KARMA_BREAKS,
                                                  fixed.KARMA_LABELS, bucket_name="user_karma"),
    }
    for inner in ("median", "mean"):
        out[f"{inner}_by_post_count"] = explore.bucket_stats(
            posts, "by", "score", "user_post_count", fixed.POST_COUNT_BREAKS, fixed.POST_COUNT_LABELS,
            inner=inner, outer=inner, order_by=["time", "id"], bucket_name="total_post_count")
    by_title = dedup.keep_best(posts, "title", "score", "id")
    out.update(_flag_report(by_title, title_patterns, "title", "score"))
    by_url = dedup.keep_best(posts, "url", "score", "id")
    out.update(_flag_report(by_url, url_patterns, "url", "score"))
    return out

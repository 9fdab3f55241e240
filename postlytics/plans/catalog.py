"""Registered queries: each runs one operator (or pipeline) of the library over
the driver's tables, and most have a DuckDB twin computing the same result from
the same Parquet files.

Conventions shared by both sides: counts and indexes are BIGINT, flags INTEGER
(TINYINT for one-hot columns), doubles rounded to 6 places, timestamps turned
into whole epoch seconds, and every limit/first/lead bound to a unique order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlytics.functions.binning import cut
from postlytics.functions.text import WHITESPACE_CLASS, char_length, flag_pattern
from postlytics.functions.timefeat import epoch_hour, hour_of_day, weekday, weekday_one_hot
from postlytics.functions.urls import domain_pattern
from postlytics.operators import dedup, explore, keywords, ordering, permute, repeats
from postlytics.operators.html import html_to_text
from postlytics.plans import fixed, page_sql
from postlytics.session import ensure_checkpoint_dir
from postlytics.sources.tables import (front_page_from_lineitem, karma_posts_from_orders, load,
                                       load_spread, posts_from_events)

# Query parameters (caller input, chosen for the driver's tables) -----------
LANG_MARKERS = ["der", "die", "und", "la", "que", "les", "des"]
DOMAIN_KEYWORDS = ["blog", "cheap-pills", "free-bets", "adult-x", "thther", "ththth"]
MINUTES_AFTER_PUBLICATION = 30


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# SQL helpers
# --------------------------------------------------------------------------
T_SQL = "(epoch_us(ts) // 1000000)"
WS_SQL = WHITESPACE_CLASS.replace("\\\\", "\\")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def sql_cut(expr: str, breaks, labels) -> str:
    parts = [f"WHEN {expr} IS NULL THEN NULL"]
    parts += [f"WHEN {expr} <= {b} THEN {sql_str(lab)}" for b, lab in zip(breaks, labels)]
    return "CASE " + " ".join(parts) + f" ELSE {sql_str(labels[-1])} END"


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{WS_SQL}+'), lambda x: x <> '')"


# --------------------------------------------------------------------------
# time features, hourly medians
# --------------------------------------------------------------------------
def q_hourly_median(spark, sf):
    posts = posts_from_events(spark, sf).withColumn(
        "scraped_at_hour", epoch_hour("time", F.lit(MINUTES_AFTER_PUBLICATION)))
    # the front page is the same table of snapshots here
    out = explore.attach_group_median(posts, posts, "scraped_at_hour", "score", "hourly_median_fp_score")
    return out.select("id", "scraped_at_hour", r6(F.col("hourly_median_fp_score")).alias("hourly_median_fp_score"))


SQL_HOURLY_MEDIAN = f"""
WITH p AS (SELECT event_id AS id, ({T_SQL} + {MINUTES_AFTER_PUBLICATION} * 60) // 3600 AS scraped_at_hour,
                  value AS score FROM events),
m AS (SELECT scraped_at_hour, median(score) AS med FROM p GROUP BY scraped_at_hour)
SELECT p.id, p.scraped_at_hour, round(m.med, 6) AS hourly_median_fp_score
FROM p LEFT JOIN m ON p.scraped_at_hour = m.scraped_at_hour
"""


def q_time_features(spark, sf):
    posts = posts_from_events(spark, sf)
    return posts.select(
        "id", weekday("time", fixed.WEEKDAY_SHIFT_SECONDS).alias("weekday"),
        *weekday_one_hot("time", fixed.WEEKDAY_SHIFT_SECONDS),
        hour_of_day("time").alias("hour"),
        epoch_hour("time", F.lit(MINUTES_AFTER_PUBLICATION)).alias("scraped_at_hour"))


def _sql_weekday(t):
    return f"((({t} - {fixed.WEEKDAY_SHIFT_SECONDS}) // 86400) + 4) % 7"


SQL_TIME_FEATURES = f"""
WITH p AS (SELECT event_id AS id, {T_SQL} AS t FROM events),
w AS (SELECT id, t, {_sql_weekday('t')} AS weekday FROM p)
SELECT id, weekday,
  (weekday = 1)::TINYINT AS is_monday, (weekday = 2)::TINYINT AS is_tuesday,
  (weekday = 3)::TINYINT AS is_wednesday, (weekday = 4)::TINYINT AS is_thursday,
  (weekday = 5)::TINYINT AS is_friday, (weekday = 6)::TINYINT AS is_saturday,
  (weekday = 0)::TINYINT AS is_sunday,
  (t // 3600) % 24 AS hour, (t + {MINUTES_AFTER_PUBLICATION} * 60) // 3600 AS scraped_at_hour
FROM w
"""


def q_weekday_mean(spark, sf):
    p = posts_from_events(spark, sf).withColumn("weekday", weekday("time", fixed.WEEKDAY_SHIFT_SECONDS))
    return explore.group_stat(p, "weekday", "score", "mean", "mean_score").select(
        "weekday", r6(F.col("mean_score")).alias("mean_score"))


SQL_WEEKDAY_MEAN = f"""
SELECT {_sql_weekday(T_SQL)} AS weekday, round(avg(value), 6) AS mean_score FROM events GROUP BY 1
"""


def q_hour_mean(spark, sf):
    p = posts_from_events(spark, sf).withColumn("hour", hour_of_day("time"))
    return explore.group_stat(p, "hour", "score", "mean", "mean_score").select(
        "hour", r6(F.col("mean_score")).alias("mean_score"))


SQL_HOUR_MEAN = f"SELECT ({T_SQL} // 3600) % 24 AS hour, round(avg(value), 6) AS mean_score FROM events GROUP BY 1"


def q_hour_median(spark, sf):
    p = posts_from_events(spark, sf).withColumn("hour", hour_of_day("time"))
    return explore.group_stat(p, "hour", "score", "median", "median_score").select(
        "hour", r6(F.col("median_score")).alias("median_score"))


SQL_HOUR_MEDIAN = f"SELECT ({T_SQL} // 3600) % 24 AS hour, round(median(value), 6) AS median_score FROM events GROUP BY 1"


# --------------------------------------------------------------------------
# ordered operators
# --------------------------------------------------------------------------
def q_dense_index(spark, sf):
    p = posts_from_events(spark, sf)
    return ordering.with_dense_index(p, ["time", "id"], "idx").select("id", "idx")


SQL_DENSE_INDEX = f"""
SELECT event_id AS id, (row_number() OVER (ORDER BY {T_SQL}, event_id) - 1)::BIGINT AS idx FROM events
"""


def q_lag_difference(spark, sf):
    p = posts_from_events(spark, sf).select("id", "time", "score")
    return ordering.lag_difference(p, "score", ["time", "id"]).select("id", r6(F.col("diff")).alias("diff"))


SQL_LAG_DIFFERENCE = f"""
SELECT event_id AS id, round(value - lag(value) OVER (ORDER BY {T_SQL}, event_id), 6) AS diff FROM events
"""

PERMUTATION_SEED = 42


def q_keyed_permutation(spark, sf):
    p = posts_from_events(spark, sf).select("id", "time")
    idx, n = ordering.dense_index(p, ["time", "id"], "idx")
    return idx.select("id", "idx", permute.permuted(F.col("idx"), n, permute.round_keys(PERMUTATION_SEED)).alias("place"))


def _sql_keyed_permutation():
    """One pass of the network is a row a round; rows that land outside go again."""
    keys = permute.round_keys(PERMUTATION_SEED)
    t, prime = f"((r * 48271 + {keys}[k + 1]) % {permute.PRIME})", permute.PRIME
    added = f"(({t} * {t} + 40692 * {t} + {keys}[k + 1]) % {prime})"
    return f"""
WITH RECURSIVE i AS (SELECT event_id AS id, (row_number() OVER (ORDER BY {T_SQL}, event_id) - 1)::BIGINT AS idx FROM events),
n AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM i)),
walk AS (
  SELECT id, idx, 0 AS k, idx // b AS l, idx % b AS r, a AS p, b AS q FROM i, n
  UNION ALL
  SELECT id, idx, CASE WHEN k < {permute.ROUNDS} THEN k + 1 ELSE 0 END,
    CASE WHEN k < {permute.ROUNDS} THEN r ELSE (l * b + r) // b END,
    CASE WHEN k < {permute.ROUNDS} THEN (l + {added}) % p ELSE (l * b + r) % b END,
    CASE WHEN k < {permute.ROUNDS} THEN q ELSE p END, CASE WHEN k < {permute.ROUNDS} THEN p ELSE q END
  FROM walk, n WHERE k < {permute.ROUNDS} OR l * b + r >= n
)
SELECT id, idx, l * b + r AS place FROM walk, n WHERE k = {permute.ROUNDS} AND l * b + r < n
"""


def q_first_page_time(spark, sf):
    p = posts_from_events(spark, sf).select("id", "time")
    out = ordering.time_until_nth_next(p, "time", fixed.FRONT_PAGE_ROWS, ["time", "id"])
    return out.select("id", "time_on_first_page")


SQL_FIRST_PAGE_TIME = f"""
WITH p AS (SELECT event_id AS id, {T_SQL} AS t FROM events)
SELECT id, lead(t, {fixed.FRONT_PAGE_ROWS}) OVER (ORDER BY t, id) - t AS time_on_first_page FROM p
"""


def q_rolling_median_30(spark, sf):
    p = posts_from_events(spark, sf).select("id", "time", "score")
    out = ordering.rolling_median(p, "score", fixed.FRONT_PAGE_ROWS, ["time", "id"])
    return out.select("id", r6(F.col("average_score_of_posts_before")).alias("average_score_of_posts_before"))


SQL_ROLLING_MEDIAN_30 = f"""
WITH p AS (SELECT event_id AS id, {T_SQL} AS t, value AS score FROM events)
SELECT id,
  CASE WHEN lead(id, {fixed.FRONT_PAGE_ROWS}) OVER w IS NULL THEN NULL
       ELSE round(median(score) OVER (w ROWS BETWEEN CURRENT ROW AND {fixed.FRONT_PAGE_ROWS - 1} FOLLOWING), 6)
  END AS average_score_of_posts_before
FROM p WINDOW w AS (ORDER BY t, id)
"""


def _q_repeat(hours):
    name = f"count_last_{hours}h"

    def q(spark, sf):
        p = posts_from_events(spark, sf)
        return repeats.repeat_count(p, "url", "time", hours * 3600, name).select("id", name)
    return q


def _sql_repeat(hours):
    return f"""
WITH p AS (SELECT event_id AS id, props AS url, {T_SQL} AS t FROM events)
SELECT id, CASE WHEN url IS NULL OR t IS NULL THEN 0 ELSE
  count(*) OVER (PARTITION BY url ORDER BY t RANGE BETWEEN {hours * 3600} PRECEDING AND 1 PRECEDING)
  END::BIGINT AS count_last_{hours}h
FROM p
"""


# --------------------------------------------------------------------------
# top-k, buckets, global stats
# --------------------------------------------------------------------------
def q_top_scores(spark, sf):
    p = posts_from_events(spark, sf)
    return explore.top_k(p, "score", 5, nulls="first", tie=["id"]).select("id", "score")


SQL_TOP_SCORES = "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC NULLS FIRST, event_id LIMIT 5"


def _first_rows(last):
    def q(spark, sf):
        o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
        return explore.first_n(o, 500, ["o_orderdate", "o_orderkey"], last=last)
    return q


def _sql_first_rows(last):
    d = "DESC" if last else "ASC"
    return (f"SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
            f"ORDER BY o_orderdate {d}, o_orderkey {d} LIMIT 500")


def q_top_comments(spark, sf):
    p = karma_posts_from_orders(spark, sf)
    return explore.top_k(p, "user_post_count", 5, tie=["id"], fill_zero=["user_post_count"]).select(
        "id", "by", "user_post_count")


SQL_TOP_COMMENTS = """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey AS id, orders.o_custkey AS "by", coalesce(c.n, 0) AS user_post_count
FROM orders LEFT JOIN c ON orders.o_custkey = c.o_custkey
ORDER BY coalesce(c.n, 0) DESC NULLS FIRST, o_orderkey LIMIT 5
"""


def q_author_buckets(spark, sf):
    p = karma_posts_from_orders(spark, sf)
    return explore.bucket_stats(p, "by", None, "count", fixed.POSTS_PER_AUTHOR_BREAKS,
                                fixed.POSTS_PER_AUTHOR_LABELS, bucket_name="posts_in_period")


SQL_AUTHOR_BUCKETS = f"""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT {sql_cut('n', fixed.POSTS_PER_AUTHOR_BREAKS, fixed.POSTS_PER_AUTHOR_LABELS)} AS posts_in_period,
       count(*) AS entry_count
FROM a GROUP BY 1
"""


def q_karma_buckets(spark, sf):
    p = karma_posts_from_orders(spark, sf)
    out = explore.row_bucket_stats(p, "score", "user_karma", fixed.KARMA_BREAKS, fixed.KARMA_LABELS,
                                   bucket_name="user_karma_bucket")
    return out.select("user_karma_bucket", r6(F.col("median_score")).alias("median_score"), "entry_count")


SQL_KARMA_BUCKETS = f"""
WITH p AS (SELECT o.o_totalprice AS score, c.c_acctbal AS user_karma
           FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
b AS (SELECT score, {sql_cut('user_karma', fixed.KARMA_BREAKS, fixed.KARMA_LABELS)} AS user_karma_bucket FROM p)
SELECT user_karma_bucket, round(median(score), 6) AS median_score, count(*) AS entry_count
FROM b WHERE user_karma_bucket IS NOT NULL GROUP BY 1
"""


def _q_author_stat(inner):
    def q(spark, sf):
        p = karma_posts_from_orders(spark, sf)
        out = explore.bucket_stats(p, "by", "score", "user_post_count", fixed.POST_COUNT_BREAKS,
                                   fixed.POST_COUNT_LABELS, inner=inner, outer=inner,
                                   order_by=["id"], bucket_name="total_post_count")
        v = "median_value" if inner == "median" else "mean_value"
        return out.select("total_post_count", r6(F.col(v)).alias(v), "entry_count")
    return q


def _sql_author_stat(inner):
    fn = "median" if inner == "median" else "avg"
    v = "median_value" if inner == "median" else "mean_value"
    return f"""
WITH n AS (SELECT o_custkey, count(*) AS user_post_count FROM orders GROUP BY 1),
p AS (SELECT o.o_orderkey AS id, o.o_custkey AS "by", o.o_totalprice AS score, n.user_post_count
      FROM orders o LEFT JOIN n ON o.o_custkey = n.o_custkey),
a AS (SELECT "by", {fn}(score) AS v, arg_min(user_post_count, id) AS first_count FROM p GROUP BY "by"),
b AS (SELECT v, {sql_cut('first_count', fixed.POST_COUNT_BREAKS, fixed.POST_COUNT_LABELS)} AS total_post_count FROM a)
SELECT total_post_count, round({fn}(v), 6) AS {v}, count(*) AS entry_count
FROM b WHERE total_post_count IS NOT NULL GROUP BY 1
"""


def q_global_stats(spark, sf):
    p = karma_posts_from_orders(spark, sf)
    cols = ["score", "user_karma", "user_post_count"]
    out = explore.global_stats(p, cols, cols)
    return out.select(*[r6(F.col(c)).alias(c) if c != "n_rows" else F.col(c) for c in out.columns])


SQL_GLOBAL_STATS = """
WITH n AS (SELECT o_custkey, count(*) AS user_post_count FROM orders GROUP BY 1),
p AS (SELECT o.o_totalprice AS score, c.c_acctbal AS user_karma, n.user_post_count
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
      LEFT JOIN n ON o.o_custkey = n.o_custkey)
SELECT round(avg(score), 6) AS average_score, round(avg(user_karma), 6) AS average_user_karma,
       round(avg(user_post_count), 6) AS average_user_post_count,
       round(median(score), 6) AS median_score, round(median(user_karma), 6) AS median_user_karma,
       round(median(user_post_count), 6) AS median_user_post_count, count(*) AS n_rows
FROM p
"""


FRONT_PAGE_COLS = ["score", "user_post_count", "minutes_since_pub", "user_karma"]


def _front_page_report(spark, sf):
    from postlytics.plans.reports import front_page_report
    return front_page_report(front_page_from_lineitem(spark, sf), karma_posts_from_orders(spark, sf),
                             ["time", "minutes_since_pub", "l_partkey", "l_suppkey"],
                             FRONT_PAGE_COLS, FRONT_PAGE_COLS, FRONT_PAGE_COLS)


def q_front_page_summary(spark, sf):
    out = _front_page_report(spark, sf)["summary"]
    return out.select(*[r6(F.col(c)).alias(c) if c != "n_rows" else F.col(c) for c in out.columns])


def q_front_page_histograms(spark, sf):
    out = _front_page_report(spark, sf)["histograms"]
    return out.select("column", "bin", r6(F.col("breakpoint")).alias("breakpoint"), "count")


SQL_FRONT_PAGE = """
WITH n AS (SELECT o_custkey, count(*) AS user_post_count FROM orders GROUP BY 1),
p AS (SELECT o.o_orderkey AS id, o.o_totalprice AS score_right, c.c_acctbal AS user_karma, n.user_post_count
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN n ON o.o_custkey = n.o_custkey),
f AS (SELECT l_orderkey AS id, l_linenumber::BIGINT AS minutes_since_pub, l_quantity AS score,
             row_number() OVER (PARTITION BY l_orderkey
                                ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn
      FROM lineitem),
j AS (SELECT f.id, f.minutes_since_pub, f.score, p.user_karma, p.user_post_count
      FROM f JOIN p ON f.id = p.id WHERE f.rn = 1)"""


def _sql_front_page_summary():
    means = ", ".join(f"round(avg({c}), 6) AS average_{c}" for c in FRONT_PAGE_COLS)
    meds = ", ".join(f"round(median({c}), 6) AS median_{c}" for c in FRONT_PAGE_COLS)
    return f"{SQL_FRONT_PAGE}\nSELECT {means}, {meds}, count(*) AS n_rows FROM j"


def _sql_front_page_histograms():
    parts = []
    for c in FRONT_PAGE_COLS:
        parts.append(f"""SELECT '{c}' AS "column", spine.bin,
  round(s.lo + spine.bin::DOUBLE * ((s.hi - s.lo) / 10), 6) AS breakpoint, coalesce(k.n, 0)::BIGINT AS count
FROM (SELECT range::INTEGER AS bin FROM range(1, 11)) spine
CROSS JOIN (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM j) s
LEFT JOIN (SELECT least(greatest(ceil(({c}::DOUBLE - s2.lo) / ((s2.hi - s2.lo) / 10)), 1), 10)::INTEGER AS bin,
                  count(*) AS n
           FROM j, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM j) s2
           WHERE {c} IS NOT NULL GROUP BY 1) k ON spine.bin = k.bin""")
    return SQL_FRONT_PAGE + "\n" + "\nUNION ALL\n".join(parts)


def q_value_counts(spark, sf):
    return explore.value_counts(load(spark, sf, "events"), "event_type")


SQL_VALUE_COUNTS = "SELECT event_type, count(*) AS count FROM events GROUP BY 1"


def q_score_points(spark, sf):
    p = posts_from_events(spark, sf).withColumn("hour", hour_of_day("time"))
    return explore.point_counts(p.withColumn("score_bin", F.floor(F.col("score")).cast("long")),
                                "hour", "score_bin")


SQL_SCORE_POINTS = f"""
SELECT ({T_SQL} // 3600) % 24 AS hour, floor(value)::BIGINT AS score_bin, count(*) AS count FROM events GROUP BY 1, 2
"""


PAIR_COLS = ["l_quantity", "l_discount", "l_tax", "p_size"]


def q_feature_pairs(spark, sf):
    return explore.pair_points(regression_frame(spark, sf), PAIR_COLS)


def _sql_feature_pairs():
    parts = [f"SELECT '{x}' AS x, '{y}' AS y, {x} AS x_value, {y} AS y_value, count(*) AS count FROM reg GROUP BY ALL"
             for i, x in enumerate(PAIR_COLS) for y in PAIR_COLS[i + 1:]]
    return f"WITH {SQL_REG}\n" + "\nUNION ALL\n".join(parts)


def q_csv_bad_cells(spark, sf):
    """Orders written as CSV with cells damaged by rule, read back and accounted for."""
    import uuid
    from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType
    from postlytics.sources import files
    o = load(spark, sf, "orders")
    damage = {"o_custkey": (13, "12x"), "o_totalprice": (7, "n/a, \"unknown\""), "o_orderdate": (11, "1996-13-45")}
    cells = [F.when(F.col("o_orderkey") % k == 0, F.lit(text)).otherwise(
        F.col(c).cast("date" if c == "o_orderdate" else o.schema[c].dataType).cast("string")).alias(c) for c, (k, text) in damage.items()]
    path = f"{ensure_checkpoint_dir(spark)}/damaged-{uuid.uuid4().hex}"
    files.write_csv(o.select("o_orderkey", *cells), path)
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                         StructField("o_totalprice", DoubleType()), StructField("o_orderdate", DateType())])
    read = files.read_csv_audited(spark, path, schema)
    total = read.agg(F.sum("o_orderkey").alias("o_orderkey"), F.sum("o_custkey").alias("o_custkey"),
                     F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("o_totalprice"),
                     F.sum(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")).alias("o_orderdate"))
    total = total.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in schema.names])))
    return files.cell_account(read).join(total, "column")


def _sql_csv_bad_cells():
    def one(c, k, value):
        bad = f"count(*) FILTER (o_orderkey % {k} = 0)" if k else "0"
        left = f"FILTER (o_orderkey % {k} <> 0)" if k else ""
        return (f"SELECT '{c}' AS \"column\", count(*) AS n_rows, {bad} AS n_bad, {bad} AS n_null, CAST(sum({value}) {left} AS BIGINT) AS total "
                "FROM orders")
    return "\nUNION ALL\n".join([
        one("o_orderkey", 0, "o_orderkey"), one("o_custkey", 13, "o_custkey"), one("o_totalprice", 7, "CAST(round(o_totalprice * 100) AS BIGINT)"),
        one("o_orderdate", 11, "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))")])


def _box_cols(group):
    return [group, r6(F.col("min")).alias("min"), r6(F.col("q1")).alias("q1"),
            r6(F.col("median")).alias("median"), r6(F.col("q3")).alias("q3"),
            r6(F.col("max")).alias("max"), r6(F.col("mean")).alias("mean"), "n"]


def q_box_by_lang(spark, sf):
    d = load(spark, sf, "documents")
    return explore.box_summary(d, "lang", "n_chars").select(*_box_cols("lang"))


def _sql_box(group_expr, group, value, source):
    return f"""
WITH d AS (SELECT {group_expr} AS {group}, {value} AS v FROM {source})
SELECT {group}, round(min(v)::DOUBLE, 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
       round(max(v)::DOUBLE, 6) AS max, round(avg(v), 6) AS mean, count(v) AS n
FROM d WHERE {group} IS NOT NULL GROUP BY {group}
"""


SQL_BOX_BY_LANG = _sql_box("lang", "lang", "n_chars", "documents")


def q_box_by_flag(spark, sf):
    d = load(spark, sf, "documents").withColumn(
        "contains_programming_language",
        flag_pattern("text", fixed.TITLE_FLAG_PATTERNS["contains_programming_language"]))
    return explore.box_summary(d, "contains_programming_language", "n_chars").select(
        *_box_cols("contains_programming_language"))


SQL_BOX_BY_FLAG = _sql_box(
    f"regexp_matches(text, '(?i){fixed.TITLE_FLAG_PATTERNS['contains_programming_language']}')",
    "contains_programming_language", "n_chars", "documents")


def q_histogram10(spark, sf):
    out = explore.histogram(load(spark, sf, "events"), "value", 10)
    return out.select("bin", r6(F.col("breakpoint")).alias("breakpoint"), "count")


SQL_HISTOGRAM10 = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(greatest(ceil((value - lo) / ((hi - lo) / 10)), 1), 10)::INTEGER AS bin
      FROM events, s WHERE value IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
spine AS (SELECT range::INTEGER AS bin FROM range(1, 11))
SELECT spine.bin, round(s.lo + spine.bin::DOUBLE * ((s.hi - s.lo) / 10), 6) AS breakpoint,
       coalesce(c.n, 0)::BIGINT AS count
FROM spine CROSS JOIN s LEFT JOIN c ON spine.bin = c.bin
"""


# --------------------------------------------------------------------------
# dedup (E1-E3, A12) and membership
# --------------------------------------------------------------------------
def q_keep_best(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    return dedup.keep_best(d, "text", "n_chars", "doc_id")


SQL_KEEP_BEST = """
SELECT doc_id, text, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC NULLS LAST, doc_id DESC) AS rn
  FROM documents) WHERE rn = 1
"""


def q_first_per_key(spark, sf):
    p = posts_from_events(spark, sf)
    return dedup.first_per_key(p, "by", ["time", "id"]).select("by", "id", "time", "score", "type")


SQL_FIRST_PER_KEY = f"""
SELECT "by", id, time, score, type FROM (
  SELECT user_id AS "by", event_id AS id, {T_SQL} AS time, value AS score, event_type AS type,
         row_number() OVER (PARTITION BY user_id ORDER BY {T_SQL}, event_id) AS rn FROM events)
WHERE rn = 1
"""


def q_keep_duplicated(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return dedup.keep_duplicated(d, "text").select("doc_id", "n_chars")


SQL_KEEP_DUPLICATED = """
SELECT doc_id, n_chars FROM (
  SELECT doc_id, n_chars, text, count(*) OVER (PARTITION BY text) AS c FROM documents)
WHERE c > 1 AND text IS NOT NULL
"""


def q_insert_or_ignore(spark, sf):
    target = load(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", "html")
    batch = load(spark, sf, "documents").select(F.col("doc_id").alias("id"),
                                                F.col("source").alias("url"),
                                                F.col("text").alias("html"))
    out = dedup.insert_or_ignore(target, batch, "id", "url", ["id"], not_null=["html"])
    return out.select("id", "url", char_length("html").alias("html_chars"))


SQL_INSERT_OR_IGNORE = """
WITH b AS (SELECT doc_id AS id, source AS url, text AS html FROM documents
           WHERE source IS NOT NULL AND text IS NOT NULL),
k AS (SELECT * FROM b WHERE id NOT IN (SELECT page_id FROM pages WHERE page_id IS NOT NULL)
                         AND url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM k)
SELECT id, url, length(html)::BIGINT AS html_chars FROM f WHERE rn = 1
"""


def q_membership_flag(spark, sf):
    from postlytics.operators.classify import membership_flag
    return membership_flag(load(spark, sf, "documents").select("doc_id"), "doc_id",
                           load(spark, sf, "labels"), name="in_labels")


SQL_MEMBERSHIP_FLAG = """
SELECT doc_id, (CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END)::INTEGER AS in_labels
FROM documents
"""


# --------------------------------------------------------------------------
# text flags and keywords
# --------------------------------------------------------------------------
def q_title_flags(spark, sf):
    d = load_spread(spark, sf, "documents")
    return d.select("doc_id", *[flag_pattern("text", p).alias(n) for n, p in fixed.TITLE_FLAG_PATTERNS.items()])


SQL_TITLE_FLAGS = "SELECT doc_id, " + ", ".join(
    f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in fixed.TITLE_FLAG_PATTERNS.items()) + " FROM documents"


def q_url_flags(spark, sf):
    d = load(spark, sf, "pages")
    return d.select("page_id", *[flag_pattern("url", p).alias(n) for n, p in fixed.URL_FLAG_PATTERNS.items()])


SQL_URL_FLAGS = "SELECT page_id, " + ", ".join(
    f"regexp_matches(url, '(?i){p}') AS {n}" for n, p in fixed.URL_FLAG_PATTERNS.items()) + " FROM pages"


def q_title_keywords(spark, sf):
    d = load_spread(spark, sf, "documents").select("doc_id", "text")
    return keywords.title_keywords(d, "text", LANG_MARKERS, "lang_marker").select(
        "doc_id", "lang_marker_detail", "contains_lang_marker")


SQL_TITLE_KEYWORDS = f"""
WITH m AS (SELECT doc_id, text, list_filter({sql_tokens('text')}, lambda w: list_contains({sql_list(sorted(set(LANG_MARKERS)))}, w)) AS hits
           FROM documents)
SELECT doc_id,
  CASE WHEN text IS NULL OR text = '' THEN NULL ELSE hits[1] END AS lang_marker_detail,
  (CASE WHEN text IS NULL OR text = '' THEN 0 WHEN len(hits) > 0 THEN 1 ELSE 0 END)::INTEGER AS contains_lang_marker
FROM m
"""


def _stop_words(spark):
    return keywords.default_stop_words(spark)


def q_word_counts(spark, sf):
    d = load_spread(spark, sf, "documents")
    return keywords.word_counts(d, "text", _stop_words(spark), ["doc_id"])


def _sql_words(stop_words):
    return f"""
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
  SELECT doc_id, list_filter({sql_tokens('text')}, lambda x: NOT list_contains({sql_list(sorted(set(stop_words)))}, x)) AS w
  FROM documents WHERE text IS NOT NULL))"""


def q_top_words(spark, sf):
    d = load_spread(spark, sf, "documents")
    return keywords.top_words(d, "text", _stop_words(spark), ["doc_id"], fixed.BUZZWORD_COUNT)


def q_buzzwords(spark, sf):
    """M1's buzzword step: the 90 most frequent words of one text table become the
    keyword list of a counted pass over another."""
    d = load_spread(spark, sf, "documents")
    top = keywords.top_words(d, "text", _stop_words(spark), ["doc_id"], fixed.BUZZWORD_COUNT)
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = keywords.title_keywords(c, "text", [r.word for r in top.collect()], "buzzwords", counted=True)
    return out.select("conv_id", "turn", F.array_join("buzzwords_detail", "|").alias("buzzwords_detail"),
                      "contains_buzzwords")


KEYWORD_REPORT_LISTS = {"german": ["der", "die", "und"], "french": ["les", "des"], "spanish": ["que", "los"]}


def q_keyword_reports(spark, sf):
    """M2 and its reports (D13, D14): per list and flag the rows, and the box summary
    of the positive lengths; the lists are DataFrames, so the join form runs."""
    from postlytics.plans.features import infer_keywords, keyword_reports
    d = load_spread(spark, sf, "documents").select("doc_id", "text", "n_chars")
    lists = {n: spark.createDataFrame([(w, i) for i, w in enumerate(ws)], "word string, at int")
             for n, ws in KEYWORD_REPORT_LISTS.items()}
    flagged = infer_keywords(d, lists, {}, title="text", id_col="doc_id")
    made = keyword_reports(flagged, list(lists), "n_chars")
    out = None
    for n in lists:
        box = made[f"{n}_box"].withColumnRenamed(f"contains_{n}", "flag")
        part = (made[f"{n}_counts"].withColumnRenamed(f"contains_{n}", "flag").join(box, "flag", "left")
                .select(F.lit(n).alias("list"), "flag", "count", "n",
                        *[r6(F.col(c).cast("double")).alias(c) for c in BOX_COLUMNS]))
        out = part if out is None else out.unionByName(part)
    return out


BOX_COLUMNS = ["min", "q1", "median", "q3", "max", "mean"]


def _sql_keyword_reports():
    parts = []
    for n, ws in KEYWORD_REPORT_LISTS.items():
        hit = f"len(list_filter({sql_tokens('text')}, lambda w: list_contains({sql_list(ws)}, w))) > 0"
        parts.append(f"""
SELECT '{n}' AS list, flag, count(*) AS count, count(n_chars) FILTER (WHERE n_chars > 0) AS n,
  min(n_chars) FILTER (WHERE n_chars > 0)::DOUBLE AS min,
  round(quantile_cont(n_chars::DOUBLE, 0.25) FILTER (WHERE n_chars > 0), 6) AS q1,
  round(quantile_cont(n_chars::DOUBLE, 0.5) FILTER (WHERE n_chars > 0), 6) AS median,
  round(quantile_cont(n_chars::DOUBLE, 0.75) FILTER (WHERE n_chars > 0), 6) AS q3,
  max(n_chars) FILTER (WHERE n_chars > 0)::DOUBLE AS max,
  round(avg(n_chars) FILTER (WHERE n_chars > 0), 6) AS mean
FROM (SELECT n_chars, (CASE WHEN text IS NOT NULL AND {hit} THEN 1 ELSE 0 END)::INTEGER AS flag FROM documents)
GROUP BY flag""")
    return "\nUNION ALL".join(parts)


def q_url_domain(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url")
    return keywords.url_keywords(p, "url", DOMAIN_KEYWORDS, "domain").select(
        "page_id", "domain_detail", "contains_domain")


def _sql_url_domain():
    pat = domain_pattern(DOMAIN_KEYWORDS).replace("'", "''")
    ok = (f"(url IS NOT NULL AND regexp_matches(url, '{pat}') AND "
          f"regexp_extract(url, '{pat}', 1) NOT IN ('apps.', 'play.', 'chromewebstore.'))")
    return f"""
SELECT page_id, CASE WHEN {ok} THEN regexp_extract(url, '{pat}', 2) END AS domain_detail,
       (CASE WHEN {ok} THEN 1 ELSE 0 END)::INTEGER AS contains_domain FROM pages
"""


def q_html_text(spark, sf):
    p = load_spread(spark, sf, "pages")
    return html_to_text(p, "page_id", "html", "plain")


def q_page_text(spark, sf):
    """M3: fetched pages that clash with no stored page on id or url, with their plain text."""
    from postlytics.plans.features import page_text
    stored = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url"))
    fetched = load_spread(spark, sf, "pages").select((-F.col("page_id") - 1).alias("id"), "url", "html")
    new, plain = page_text(fetched, stored)
    return new.select("id", "url").join(plain, "id")


# --------------------------------------------------------------------------
# pipelines: M1 post features, M4 document prep
# --------------------------------------------------------------------------
EVENT_KIND_KEYWORDS = ["error", "purchase"]


def _events_posts(spark, sf, minutes):
    p = posts_from_events(spark, sf)
    return p.select("id", "time", "by", "score", "url", F.col("type").alias("title"),
                    F.lit(None).cast("string").alias("text"),
                    F.lit(minutes).cast("long").alias("minutes_since_pub"))


POST_FEATURE_COLUMNS = [
    "id", "time", "by", "score", "score_right", "url", "title", "weekday", "is_monday",
    "is_tuesday", "is_wednesday", "is_thursday", "is_friday", "is_saturday", "is_sunday", "hour",
    "title_length", "body_length", "scraped_at_hour", "time_on_first_page",
    "average_score_of_posts_before", "hourly_median_fp_score", "count_last_12h", "count_last_48h",
    "event_kind_detail", "contains_event_kind", "domain_detail", "contains_domain",
    "buzzwords_detail", "contains_buzzwords"]


#: Keyword lists of the whole feature table: four over title words, five over url labels.
TITLE_LISTS = {"articles": ["the", "la", "der"], "links": ["and", "und", "et"], "verbs": ["is", "was", "are"],
               "prepositions": ["of", "in", "de"]}
URL_LISTS = {"blogs": ["blog"], "classical_news": ["thther", "ththan"], "startup_news": ["tionsh", "ththth"],
             "academic": ["tiontion"], "tech_companies": ["cheap-pills", "spam-farm", "example"]}


def _feature_columns(out, columns):
    rounded = {"average_score_of_posts_before", "hourly_median_fp_score"}
    return out.select(*[r6(F.col(c)).alias(c) if c in rounded else F.array_join(c, "|").alias(c) if c == "buzzwords_detail"
                        else F.col(c) for c in columns])


def q_post_features(spark, sf):
    from postlytics.plans.features import build_features
    posts30 = _events_posts(spark, sf, 30)
    posts240 = _events_posts(spark, sf, 240).drop("by")
    front = _events_posts(spark, sf, 30).select("id", "title", "time", "minutes_since_pub", "score")
    out = build_features(posts30, posts240, front,
                         title_lists={"event_kind": EVENT_KIND_KEYWORDS},
                         url_lists={"domain": DOMAIN_KEYWORDS})
    return _feature_columns(out, POST_FEATURE_COLUMNS)


def q_post_features_full(spark, sf):
    """M1 with text, all nine keyword lists and topics: events take the first line and the
    text of the document, the url of the page and the topic of the embedding of their id."""
    from postlytics.functions.text import length_bucket
    from postlytics.plans.features import build_features
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("_title"),
                                               F.col("text").alias("_text"))
    urls = load(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("_url"))

    def posts(minutes):
        p = _events_posts(spark, sf, minutes).join(docs, "id", "left").join(urls, "id", "left")
        return p.withColumns({"title": F.coalesce("_title", "title"), "text": F.col("_text"),
                              "url": F.coalesce("_url", "url")}).drop("_title", "_text", "_url")

    lengths = docs.select("id", length_bucket("_text").alias("_length"))  # before the join: no text travels for it
    topics = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic")).join(
        lengths, "id", "left").select("id", "topic", F.coalesce("_length", length_bucket(F.lit(None).cast("string"))).alias("length"))
    front = posts(30).select("id", "title", "time", "minutes_since_pub", "score")
    out = build_features(posts(30), posts(240).drop("by"), front, title_lists=TITLE_LISTS, url_lists=URL_LISTS, topics=topics)
    lists = [c for name in [*TITLE_LISTS, *URL_LISTS] for c in (f"{name}_detail", f"contains_{name}")]
    fixed_columns = [c for c in POST_FEATURE_COLUMNS if not c.endswith(("event_kind_detail", "contains_event_kind",
                                                                        "domain_detail", "contains_domain"))]
    return _feature_columns(out, [*fixed_columns, *lists, *[f"topic_{i}" for i in range(10)], "document_length"])


SQL_EVENT_POSTS = f"""SELECT event_id AS id, {T_SQL} AS time, user_id AS "by", value AS score, props AS url,
                  event_type AS title, NULL::VARCHAR AS text FROM events"""
SQL_FULL_POSTS = f"""SELECT event_id AS id, {T_SQL} AS time, user_id AS "by", value AS score, coalesce(g.url, props) AS url,
                  coalesce(split_part(d.text, chr(10), 1), event_type) AS title, d.text
           FROM events LEFT JOIN documents d ON d.doc_id = event_id LEFT JOIN pages g ON g.page_id = event_id"""


def _sql_post_features(posts, title_lists, url_lists, topics=False):
    n = fixed.FRONT_PAGE_ROWS
    words, flags = [], []
    for name, listed in title_lists.items():
        words.append(f"list_filter({sql_tokens('title')}, lambda x: list_contains({sql_list(sorted(set(listed)))}, x)) AS k_{name},")
        flags += [f"CASE WHEN title IS NULL OR title = '' THEN NULL ELSE k_{name}[1] END AS {name}_detail",
                  f"(CASE WHEN title IS NULL OR title = '' THEN 0 WHEN len(k_{name}) > 0 THEN 1 ELSE 0 END)::INTEGER AS contains_{name}"]
    for name, listed in url_lists.items():
        pat = domain_pattern(listed).replace("'", "''")
        ok = (f"(url IS NOT NULL AND regexp_matches(url, '{pat}') AND "
              f"regexp_extract(url, '{pat}', 1) NOT IN ('apps.', 'play.', 'chromewebstore.'))")
        flags += [f"CASE WHEN {ok} THEN regexp_extract(url, '{pat}', 2) END AS {name}_detail",
                  f"(CASE WHEN {ok} THEN 1 ELSE 0 END)::INTEGER AS contains_{name}"]
    topic_join = topic_columns = ""
    if topics:
        topic_columns = "".join(f", (e.label = {i})::INTEGER AS topic_{i}" for i in range(10)) + """,
  (CASE WHEN length(b.text) > 200 THEN 3 WHEN length(b.text) > 50 THEN 2 ELSE 1 END)::INTEGER AS document_length"""
        topic_join = "JOIN embeddings e ON e.vec_id = b.id"
    sw = sql_list(sorted(set(fixed.ENGLISH_STOP_WORDS)))
    return f"""
WITH p AS ({posts}),
fp AS (SELECT title, time, id, score, (time + 30 * 60) // 3600 AS scraped_at_hour FROM p),
hm AS (SELECT scraped_at_hour, median(score) AS med FROM fp GROUP BY 1),
fw AS (SELECT id, time, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
        SELECT id, time, list_filter({sql_tokens('title')}, lambda x: NOT list_contains({sw}, x)) AS w
        FROM fp WHERE title IS NOT NULL)),
fc AS (SELECT word, count(*) AS cnt, min((time, id, pos)) AS first FROM fw GROUP BY word),
kw AS (SELECT list(word) AS kw FROM (SELECT word FROM fc ORDER BY cnt DESC, first LIMIT {fixed.BUZZWORD_COUNT})),
b AS (SELECT p.*, p.score AS score_right, {_sql_weekday('time')} AS weekday,
             (time // 3600) % 24 AS hour, length(title)::BIGINT AS title_length,
             coalesce(length(text), 0)::BIGINT AS body_length,
             (time + 30 * 60) // 3600 AS scraped_at_hour,
             CASE WHEN lead(id, {n}) OVER w IS NULL THEN NULL ELSE lead(time, {n}) OVER w - time END AS time_on_first_page,
             CASE WHEN lead(id, {n}) OVER w IS NULL THEN NULL
                  ELSE round(median(score) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), 6) END
               AS average_score_of_posts_before,
             CASE WHEN url IS NULL OR time IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY url ORDER BY time
               RANGE BETWEEN {12 * 3600} PRECEDING AND 1 PRECEDING) END::BIGINT AS count_last_12h,
             CASE WHEN url IS NULL OR time IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY url ORDER BY time
               RANGE BETWEEN {48 * 3600} PRECEDING AND 1 PRECEDING) END::BIGINT AS count_last_48h,
             {' '.join(words)}
             list_filter({sql_tokens('title')}, lambda x: list_contains(kw.kw, x)) AS bz
      FROM p CROSS JOIN kw WINDOW w AS (ORDER BY time, id))
SELECT id, time, "by", score, score_right, url, title, weekday,
  (weekday = 1)::TINYINT AS is_monday, (weekday = 2)::TINYINT AS is_tuesday,
  (weekday = 3)::TINYINT AS is_wednesday, (weekday = 4)::TINYINT AS is_thursday,
  (weekday = 5)::TINYINT AS is_friday, (weekday = 6)::TINYINT AS is_saturday,
  (weekday = 0)::TINYINT AS is_sunday, hour, title_length, body_length, b.scraped_at_hour,
  time_on_first_page, average_score_of_posts_before, round(hm.med, 6) AS hourly_median_fp_score,
  count_last_12h, count_last_48h,
  {', '.join(flags)},
  CASE WHEN title IS NULL OR title = '' THEN NULL ELSE array_to_string(bz, '|') END AS buzzwords_detail,
  (CASE WHEN title IS NULL OR title = '' THEN 0 ELSE len(bz) END)::INTEGER AS contains_buzzwords{topic_columns}
FROM b LEFT JOIN hm ON b.scraped_at_hour = hm.scraped_at_hour {topic_join}
"""


def _benchmark_dictionary(spark, sf):
    from postlytics.operators.textclean import dictionary_from_text
    return dictionary_from_text(load(spark, sf, "benchmark"), "text")


def q_clean_pages(spark, sf):
    from postlytics.operators.textclean import clean_pages
    d = load_spread(spark, sf, "documents").select("doc_id", "text")
    out = clean_pages(d, "text", _benchmark_dictionary(spark, sf), fixed.ENGLISH_STOP_WORDS,
                      out="cleaned", id_col="doc_id")
    return out.select("doc_id", "cleaned")


def _sql_clean():
    sw = sql_list(sorted(set(fixed.ENGLISH_STOP_WORDS)))
    letters = "lower(regexp_replace(replace({x}, chr(10), ' '), '[^a-zA-Z" + WS_SQL[1:-1] + "]', '', 'g'))"
    dict_words = f"""dict AS (SELECT list(DISTINCT w) AS d FROM (
        SELECT unnest({sql_tokens(letters.replace('{x}', 'text'))}) AS w FROM benchmark)
        WHERE length(w) >= 2 AND NOT list_contains({sw}, w))"""
    return dict_words, letters


def _sql_clean_pages():
    dict_words, letters = _sql_clean()
    return f"""
WITH {dict_words}
SELECT doc_id, CASE WHEN text IS NULL THEN ' ' ELSE
  array_to_string(list_filter({sql_tokens(letters.replace('{x}', 'text'))}, lambda x: list_contains(dict.d, x)), ' ')
  END AS cleaned
FROM documents CROSS JOIN dict
"""


def q_length_bucket(spark, sf):
    from postlytics.functions.text import length_bucket
    c = q_clean_pages(spark, sf)
    return c.select("doc_id", length_bucket("cleaned").alias("length"))


def _sql_length_bucket():
    dict_words, letters = _sql_clean()
    return f"""
WITH {dict_words},
c AS (SELECT doc_id, CASE WHEN text IS NULL THEN ' ' ELSE
  array_to_string(list_filter({sql_tokens(letters.replace('{x}', 'text'))}, lambda x: list_contains(dict.d, x)), ' ')
  END AS cleaned FROM documents CROSS JOIN dict)
SELECT doc_id, (CASE WHEN length(cleaned) > 200 THEN 3 WHEN length(cleaned) > 50 THEN 2 ELSE 1 END)::INTEGER AS length
FROM c
"""


def q_prepare_documents(spark, sf):
    """M4 over the driver tables: plain text of pages (I20) right-joined to
    documents as posts (id = doc_id, title = first line of the text)."""
    from postlytics.plans.features import prepare_documents
    plain = html_to_text(load_spread(spark, sf, "pages"), "page_id", "html", "plain").withColumnRenamed(
        "page_id", "id")
    posts = load(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    return prepare_documents(plain, posts, _benchmark_dictionary(spark, sf),
                             fixed.ENGLISH_STOP_WORDS, "id")


def _sql_prepare_documents():
    dict_words, letters = _sql_clean()
    return page_sql.sql_prepare_documents(dict_words, lambda col: sql_tokens(letters.replace("{x}", col)))


# --------------------------------------------------------------------------
# statistics (K1-K10, D19) and sampling
# --------------------------------------------------------------------------
REG_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
REG_LABEL = "l_extendedprice"
UNDERSAMPLE_LIMIT = 300000.0
QQ_POINTS = 99


def regression_frame(spark, sf, spread_scan=False):
    """lineitem joined to part: label l_extendedprice, five numeric features and a
    unique row id orderkey-linenumber-partkey-suppkey-shipdate(us) (lineitem has
    no unique key of its own here).  Part is joined by key; AQE picks broadcast
    or sort-merge from the runtime size.  ``spread_scan`` spreads a single-split
    scan over the cores (model queries); the SQL-checked queries keep the scan's
    partitioning, so their floating sums keep one summation order."""
    li = (load_spread if spread_scan else load)(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_shipdate", "l_quantity", "l_discount", "l_tax",
                                            "l_extendedprice")
    pa = load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate"))
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", us)
    return j.select(rid.alias("id"), *[F.col(c).cast("double").alias(c) for c in REG_FEATURES],
                    F.col(REG_LABEL).cast("double").alias(REG_LABEL)).dropna(subset=REG_FEATURES + [REG_LABEL])


SQL_REG = f"""reg AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate)) AS id,
  {", ".join(f"{c}::DOUBLE AS {c}" for c in REG_FEATURES)}, {REG_LABEL}::DOUBLE AS {REG_LABEL}
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def q_pearson_long(spark, sf):
    from postlytics.operators.stats import pearson_long
    out = pearson_long(regression_frame(spark, sf), REG_FEATURES + [REG_LABEL])
    return out.select("x", "y", r6(F.col("z")).alias("z"))


def _sql_pearson():
    cols = REG_FEATURES + [REG_LABEL]
    parts = []
    for a in cols:
        for b in cols:
            z = (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END" if a == b else f"corr({a}, {b})")
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, round({z}, 6) AS z FROM reg")
    return f"WITH {SQL_REG}\n" + "\nUNION ALL\n".join(parts)


SPEARMAN_COLS = ["score", "user_karma", "user_post_count"]


def q_spearman_long(spark, sf):
    from postlytics.operators.stats import spearman_long
    p = karma_posts_from_orders(spark, sf).fillna(0.0, subset=SPEARMAN_COLS)
    out = spearman_long(p, SPEARMAN_COLS)
    return out.select("x", "y", r6(F.col("rho")).alias("rho"), r6(F.col("p_value")).alias("p_value"))


def _sql_spearman():
    cols = SPEARMAN_COLS
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, corr(r_{a}, r_{b}) AS rho, count(*) - 2.0 AS d FROM r")
    return f"""
WITH n AS (SELECT o_custkey, count(*) AS user_post_count FROM orders GROUP BY 1),
p AS (SELECT coalesce(o.o_totalprice, 0) AS score, coalesce(c.c_acctbal, 0) AS user_karma,
             coalesce(n.user_post_count, 0) AS user_post_count
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN n ON o.o_custkey = n.o_custkey),
r AS (SELECT {ranks} FROM p),
c AS ({" UNION ALL ".join(parts)}),
t AS (SELECT *, abs(rho) * sqrt(d / (1 - rho * rho)) AS t FROM c)
SELECT x, y, round(rho, 6) AS rho, round(2 * 0.0005 * sum(exp(lgamma((d + 1) / 2) - lgamma(d / 2) - ln(d * pi()) / 2
  - (d + 1) / 2 * ln(1 + (t + u) * (t + u) / d))), 6) AS p_value
FROM t, (SELECT (range + 0.5) * 0.0005 AS u FROM range(100000)) GROUP BY x, y, rho
"""


def q_standardise(spark, sf):
    from postlytics.operators.stats import standardise
    out = standardise(regression_frame(spark, sf), REG_FEATURES)
    return out.select("id", *[r6(F.col(c)).alias(c) for c in REG_FEATURES])


def _sql_standardise():
    cols = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in REG_FEATURES)
    return f"WITH {SQL_REG} SELECT id, {cols} FROM reg"


def q_dispersion(spark, sf):
    from postlytics.operators.stats import dispersion
    out = dispersion(regression_frame(spark, sf), REG_LABEL)
    return out.select(r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


def _sql_dispersion():
    return f"WITH {SQL_REG} SELECT round(avg({REG_LABEL}), 6) AS mean, round(var_pop({REG_LABEL}), 6) AS variance FROM reg"


def q_vif(spark, sf):
    from postlytics.operators.stats import vif
    out = vif(regression_frame(spark, sf, spread_scan=True), REG_FEATURES)
    return out.select("feature", r6(F.col("vif")).alias("vif"))


def _sql_swept(src: str, pivots: list[str], targets: list[str], name: str, centred: bool) -> str:
    """CTEs that sweep ``pivots`` out of ``targets`` one by one: in the last, ``name``,
    the targets are residuals of least squares on the pivots (and 1 if ``centred``)."""
    cols = pivots + targets
    first = [f"{c} - avg({c}) OVER () AS {c}" if centred else c for c in cols]
    steps = [f"{name}_0 AS (SELECT {', '.join(first)} FROM {src})"]
    for i, p in enumerate(pivots):
        left = [f"{c} - {p} * (sum({c} * {p}) OVER () / sum({p} * {p}) OVER ()) AS {c}" for c in cols[i + 1:]]
        at = name if i == len(pivots) - 1 else f"{name}_{i + 1}"
        steps.append(f"{at} AS (SELECT {', '.join(left)} FROM {name}_{i})")
    return ",\n".join(steps)


def _sql_vif():
    others = {c: [x for x in REG_FEATURES if x != c] for c in REG_FEATURES}
    steps = ",\n".join(_sql_swept("reg", others[c], [c], f"v_{c}", False) for c in REG_FEATURES)
    parts = [f"SELECT '{c}' AS feature, round((SELECT sum({c} * {c}) FROM reg) / sum({c} * {c}), 6) AS vif FROM v_{c}"
             for c in REG_FEATURES]
    return f"WITH {SQL_REG},\n{steps}\n" + "\nUNION ALL\n".join(parts)


def _sql_ols_ctes():
    """CTE ols: one row of the slopes b_<feature> and the intercept b0, fitted on the
    rows outside the test split."""
    steps = [SQL_REG, f"train AS (SELECT * FROM reg WHERE ({HASH_SQL.format(x='id', seed=42)} % 10000) >= 2500)"]
    for c in REG_FEATURES:
        steps.append(_sql_swept("train", [x for x in REG_FEATURES if x != c], [c, REG_LABEL], f"s_{c}", True))
        steps.append(f"c_{c} AS (SELECT sum({c} * {REG_LABEL}) / sum({c} * {c}) AS b_{c} FROM s_{c})")
    means = ", ".join(f"avg({c}) AS m_{c}" for c in REG_FEATURES)
    fit = " - ".join(["m_y"] + [f"b_{c} * m_{c}" for c in REG_FEATURES])
    steps.append(f"m AS (SELECT avg({REG_LABEL}) AS m_y, {means} FROM train)")
    steps.append(f"ols AS (SELECT *, {fit} AS b0 FROM m, {', '.join(f'c_{c}' for c in REG_FEATURES)})")
    return ",\n".join(steps)


def _sql_ols_coefficients():
    parts = [f"SELECT '{c}' AS feature, round(b_{c}, 4) AS coefficient FROM ols" for c in REG_FEATURES]
    parts.append("SELECT '(intercept)' AS feature, round(b0, 4) AS coefficient FROM ols")
    return f"WITH {_sql_ols_ctes()}\n" + "\nUNION ALL\n".join(parts)


SQL_OLS_RESIDUAL = " - ".join([REG_LABEL, "b0"] + [f"b_{c} * {c}" for c in REG_FEATURES])


def _sql_ols_summary():
    return f"""
WITH {_sql_ols_ctes()},
e AS (SELECT {REG_LABEL} AS y, {SQL_OLS_RESIDUAL} AS e FROM reg, ols
      WHERE ({HASH_SQL.format(x='id', seed=42)} % 10000) < 2500)
SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS test_r2, round(avg(e * e), 2) AS test_mse,
       count(*) AS n_test FROM e
"""


def _sql_ols_residuals():
    return f"WITH {_sql_ols_ctes()}\nSELECT id, round({SQL_OLS_RESIDUAL}, 3) AS resid FROM reg, ols"


def _sql_breusch_pagan():
    """The p-values are the midpoint sums of the chi-square and F densities from the
    statistic on (k = 5 degrees of freedom)."""
    k = len(REG_FEATURES)
    return f"""
WITH {_sql_ols_ctes()},
e AS (SELECT {", ".join(REG_FEATURES)}, ({SQL_OLS_RESIDUAL}) ** 2 AS e2 FROM reg, ols),
{_sql_swept("e", REG_FEATURES, ["e2"], "w", True)},
r AS (SELECT count(*) AS n, 1 - sum(e2 * e2) / (SELECT var_pop(e2) * count(*) FROM e) AS r2 FROM w),
s AS (SELECT n, (n - {k + 1})::DOUBLE AS d, n * r2 AS lm, (r2 / {k}) / ((1 - r2) / (n - {k + 1})) AS f FROM r),
x AS (SELECT sum(exp({k / 2 - 1} * ln(lm + u) - (lm + u) / 2 - {k / 2} * ln(2) - lgamma({k / 2}))) * 0.002 AS p
      FROM s, (SELECT (range + 0.5) * 0.002 AS u FROM range(200000))),
y AS (SELECT sum(exp(lgamma(({k} + d) / 2) - lgamma({k / 2}) - lgamma(d / 2) + {k / 2} * ln({k} / d)
                     + {k / 2 - 1} * ln(f + u) - ({k} + d) / 2 * ln(1 + {k} * (f + u) / d))) * 0.0005 AS p
      FROM s, (SELECT (range + 0.5) * 0.0005 AS u FROM range(200000)))
SELECT round(lm, 4) AS lm, round(x.p, 6) AS lm_p_value, round(f, 4) AS f_value, round(y.p, 6) AS f_p_value, n
FROM s, x, y
"""


def q_durbin_watson(spark, sf):
    from postlytics.operators.stats import durbin_watson
    p = posts_from_events(spark, sf)
    return durbin_watson(p, "score", ["time", "id"]).select(r6(F.col("durbin_watson")).alias("durbin_watson"))


SQL_DURBIN_WATSON = f"""
WITH p AS (SELECT event_id AS id, {T_SQL} AS t, value AS score FROM events),
d AS (SELECT score, score - lag(score) OVER (ORDER BY t, id) AS d FROM p)
SELECT round(sum(d * d) / sum(score * score), 6) AS durbin_watson FROM d
"""


def q_qq_points(spark, sf):
    from postlytics.operators.stats import qq_points
    out = qq_points(load(spark, sf, "events"), "value", QQ_POINTS)
    return out.select(r6(F.col("p")).alias("p"), r6(F.col("theoretical")).alias("theoretical"),
                      r6(F.col("sample")).alias("sample"))


def _sql_qq():
    from postlytics.operators.distributions import norm_ppf
    ps = [(i - 0.5) / QQ_POINTS for i in range(1, QQ_POINTS + 1)]
    plist = "[" + ", ".join(repr(p) for p in ps) + "]::DOUBLE[]"
    tlist = "[" + ", ".join(repr(norm_ppf(p)) for p in ps) + "]::DOUBLE[]"
    return f"""
WITH z AS (SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(z, {plist}) AS s FROM z)
SELECT round(unnest({plist}), 6) AS p, round(unnest({tlist}), 6) AS theoretical, round(unnest(s), 6) AS sample FROM q
"""


def q_normal_points(spark, sf):
    from postlytics.operators.stats import normal_points
    out = normal_points(_ols(spark, sf)["residuals"], "resid", "id")
    return out.select("rank", *[r6(F.col(c)).alias(c) for c in ("p", "theoretical")],
                      *[F.round(c, 3).alias(c) for c in ("sample", "line")])


def _sql_ratio(pair, x):
    """A ratio of two polynomials of ``x`` in SQL, as ``functions.normal`` evaluates it."""
    parts = []
    for first, *others in pair:
        text = f"{first:.17e}"
        for c in others:
            text = f"({text} * {x} + {c:.17e})"
        parts.append(text)
    return " / ".join(parts)


def _sql_normal_points():
    from postlytics.functions import normal
    return f"""
WITH {_sql_ols_ctes()},
e AS (SELECT {SQL_OLS_RESIDUAL} AS v, id FROM reg, ols),
k AS (SELECT v, row_number() OVER (ORDER BY v, id) AS rank, count(*) OVER () AS n, avg(v) OVER () AS mean,
             stddev_pop(v) OVER () AS sd FROM e),
p AS (SELECT *, rank / (n + 1)::DOUBLE AS p FROM k),
q AS (SELECT *, p - 0.5::DOUBLE AS q, 0.180625::DOUBLE - (p - 0.5::DOUBLE) ** 2 AS m, sqrt(-ln(least(p, 1 - p))) AS r FROM p),
u AS (SELECT *, r - 1.6::DOUBLE AS a, r - 5 AS b FROM q),
t AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_sql_ratio(normal.QUANTILE_MIDDLE, "m")}
                     WHEN r <= 5 THEN sign(q) * {_sql_ratio(normal.QUANTILE_TAIL, "a")}
                     ELSE sign(q) * {_sql_ratio(normal.QUANTILE_FAR, "b")} END AS z FROM u)
SELECT rank, round(p, 6) AS p, round(z, 6) AS theoretical, round(v, 3) AS sample, round(mean + sd * z, 3) AS line FROM t
"""


def q_normality_distance(spark, sf):
    from postlytics.operators.stats import normality_distance
    return normality_distance(_ols(spark, sf)["residuals"], "resid").select(r6(F.col("distance")).alias("distance"), "n")


def _sql_normality_distance():
    """The distribution function as the midpoint sum of the density, 20,000 steps a unit."""
    return f"""
WITH {_sql_ols_ctes()},
e AS (SELECT {SQL_OLS_RESIDUAL} AS v FROM reg, ols),
k AS (SELECT (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z, row_number() OVER (ORDER BY v) AS rank, count(*) OVER () AS n FROM e),
g AS (SELECT range AS cell, sum(exp(-power((range + 0.5) / 20000 - 9, 2) / 2) / 20000 / sqrt(2 * pi())) OVER (ORDER BY range) AS below
      FROM range(360000)),
c AS (SELECT rank, n, below + exp(-z * z / 2) / sqrt(2 * pi()) * (z + 9 - (cell + 1) / 20000) AS f
      FROM k JOIN g ON cell = floor((z + 9) * 20000)::BIGINT)
SELECT round(max(greatest(rank / n - f, f - (rank - 1) / n)), 6) AS distance, max(n) AS n FROM c
"""


def q_normality(spark, sf):
    from postlytics.operators.stats import normality
    return normality(load(spark, sf, "events"), "value")


def q_breusch_pagan(spark, sf):
    out = _ols(spark, sf)["breusch_pagan"]
    return out.select(F.round("lm", 4).alias("lm"), r6("lm_p_value").alias("lm_p_value"),
                      F.round("f_value", 4).alias("f_value"), r6("f_p_value").alias("f_p_value"), "n")


HASH_SQL = "('0x' || substr(md5({x}::VARCHAR || '#' || '{seed}'), 1, 8))::BIGINT"


def q_hash_split(spark, sf):
    from postlytics.operators.sampling import hash_split
    o = load(spark, sf, "orders").select("o_orderkey")
    return hash_split(o, "o_orderkey", 0.25, 42)


SQL_HASH_SPLIT = f"SELECT o_orderkey, ({HASH_SQL.format(x='o_orderkey', seed=42)} % 10000) < 2500 AS is_test FROM orders"


def q_undersample(spark, sf):
    from postlytics.operators.sampling import undersample
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return undersample(o, "o_totalprice", "o_orderkey", UNDERSAMPLE_LIMIT, 42)


SQL_UNDERSAMPLE = f"""
WITH hi AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= {UNDERSAMPLE_LIMIT}),
lo AS (SELECT o_orderkey, o_totalprice, {HASH_SQL.format(x='o_orderkey', seed=42)} AS h FROM orders
       WHERE o_totalprice < {UNDERSAMPLE_LIMIT}),
pick AS (SELECT o_orderkey, o_totalprice FROM lo ORDER BY h, o_orderkey LIMIT (SELECT count(*) FROM hi))
SELECT * FROM pick UNION ALL SELECT * FROM hi
"""


def q_sample_rows(spark, sf):
    from postlytics.operators.sampling import sample_rows
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sample_rows(o, "o_orderkey", 10, 42)


SQL_SAMPLE_ROWS = f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {HASH_SQL.format(x='o_orderkey', seed=42)}, o_orderkey LIMIT 10
"""


def q_kfold(spark, sf):
    from postlytics.operators.sampling import with_folds
    o = load(spark, sf, "orders").select("o_orderkey")
    return with_folds(o, 3, ["o_orderkey"])


SQL_KFOLD = """
WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders),
s AS (SELECT o_orderkey, idx, n // 3 AS q, n % 3 AS r FROM i)
SELECT o_orderkey, (CASE WHEN idx < (q + 1) * r THEN idx // (q + 1) ELSE r + (idx - (q + 1) * r) // q END)::INTEGER AS fold
FROM s
"""


def q_stratified_folds(spark, sf):
    from postlytics.operators.sampling import with_folds
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    return with_folds(lab, 5, ["doc_id"], stratify="quality")


# class c (rows start .. start+cnt-1 in (class, doc_id) order) fills fold f with the
# positions p, p mod 5 = f, of its range: floor((start+cnt-1-f)/5) - floor((start-1-f)/5)
SQL_STRATIFIED_FOLDS = """
WITH c AS (SELECT quality, count(*) AS cnt FROM labels WHERE quality IS NOT NULL GROUP BY quality),
s AS (SELECT quality, cnt, sum(cnt) OVER (ORDER BY quality) - cnt AS start FROM c),
z AS (SELECT quality, t.g AS f,
             (floor((start + cnt - 1 - t.g) / 5.0) - floor((start - 1 - t.g) / 5.0))::BIGINT AS size
      FROM s CROSS JOIN range(0, 5) AS t(g)),
e AS (SELECT quality, f, sum(size) OVER (PARTITION BY quality ORDER BY f) AS edge FROM z),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS loc
      FROM labels WHERE quality IS NOT NULL)
SELECT r.doc_id, r.quality, coalesce(min(e.f) FILTER (WHERE r.loc < e.edge), 4)::INTEGER AS fold
FROM r JOIN e ON r.quality = e.quality GROUP BY r.doc_id, r.quality
"""


# --------------------------------------------------------------------------
# models (L1-L23, K12) -- rows-only except where SQL can express the result
# --------------------------------------------------------------------------
# Search space of forest_search_classifier and forest_study (cost-bounded; the
# library default, which forest_search_regressor searches with the default draws
# and folds, is the full reference grid in ``fixed.FOREST_GRID``).
SMALL_FOREST_GRID = {"n_estimators": [10, 20], "max_depth": [5, 10], "min_samples_split": [2, 10],
                     "min_samples_leaf": [2, 8], "max_features": ["sqrt", "log2"]}
FOREST_PARAMS = {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}
CLS_FEATURES = ["n_chars", "n_words", "n_lines", "is_en", "is_fr", "is_de", "is_es"]
CLS_LABEL = "quality"


def _lasso(spark, sf):
    from postlytics.operators.regress import lasso_report
    return lasso_report(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL, "id", diagnostics=False)


def q_lasso_coefficients(spark, sf):
    return _lasso(spark, sf)["coefficients"]


def q_lasso_summary(spark, sf):
    return _lasso(spark, sf)["summary"]


def _ols(spark, sf):
    from postlytics.operators.regress import ols_report
    return ols_report(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL)


def q_ols_coefficients(spark, sf):
    return _ols(spark, sf)["coefficients"].select("feature", F.round("coefficient", 4).alias("coefficient"))


def q_ols_summary(spark, sf):
    return _ols(spark, sf)["summary"].select(r6("test_r2").alias("test_r2"), F.round("test_mse", 2).alias("test_mse"), "n_test")


def q_ols_residuals(spark, sf):
    return _ols(spark, sf)["residuals"].select("id", F.round("resid", 3).alias("resid"))


def q_lasso_kkt(spark, sf):
    return _lasso(spark, sf)["certificate"].select("feature", r6(F.col("gap")).alias("gap"), "n")


def q_poisson_score(spark, sf):
    from postlytics.operators.regress import poisson_report
    out = poisson_report(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL, "id")["certificate"]
    return out.select("feature", F.round("gap", 4).alias("gap"), "n")


def _sql_certificate(rows):
    """An optimal fit has no gap: its rows, features and the constant."""
    names = ", ".join(f"('{c}')" for c in [*REG_FEATURES, "(intercept)"])
    return f"""
WITH {SQL_REG}
SELECT feature, 0.0::DOUBLE AS gap, (SELECT count(*) FROM reg WHERE {rows}) AS n FROM (VALUES {names}) f(feature)
"""


def q_regression_study(spark, sf):
    """M8 in one call: every correlation, and the optimality gaps of its lasso and Poisson fits."""
    from postlytics.plans.studies import regression_study
    parts = regression_study(regression_frame(spark, sf), REG_FEATURES, REG_LABEL, "id")
    out = parts["pearson_all"].select(F.lit("pearson").alias("part"), F.concat_ws("|", "x", "y").alias("item"), r6(F.col("z")).alias("value"))
    for part in ("lasso", "poisson"):
        gaps = parts[f"{part}_certificate"]
        out = out.unionByName(gaps.select(F.lit(part).alias("part"), F.col("feature").alias("item"),
                                          F.round("gap", 4 if part == "poisson" else 6).alias("value")))
    return out


def _sql_regression_study():
    gaps = "\n".join(f"UNION ALL SELECT '{part}' AS part, feature AS item, gap AS value FROM ({sql})" for part, sql in (
        ("lasso", _sql_certificate(f"{REG_LABEL} > 0")), ("poisson", _sql_certificate("true"))))
    return f"SELECT 'pearson' AS part, x || '|' || y AS item, z AS value FROM ({_sql_pearson()}) {gaps}"


def q_forest_study(spark, sf):
    """M9 in one call over low, medium and high prices (string classes): search, scores and
    the three importances, permutation and SHAP of every class among them, as (part, class,
    feature, value)."""
    from postlytics.plans.studies import forest_study
    parts = forest_study(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL, "id", "classifier", n_iter=2,
                         folds=3, grid=SMALL_FOREST_GRID, class_breaks=PRICE_BREAKS, permutation_repeats=3)
    none = F.lit(None).cast("int").alias("class")
    value = {"impurity_importance": "importance", "permutation_importance": "importance_mean"}
    out = parts["cv_scores"].select(F.lit("cv_accuracy").alias("part"), none, F.lit(None).cast("string").alias("feature"),
                                    F.col("cv_accuracy").alias("value"))
    for part, col in value.items():
        out = out.unionByName(parts[part].select(F.lit(part).alias("part"), none, "feature", F.col(col).alias("value")))
    shap = parts["shap_importance_by_class"]
    col = next(c for c in shap.columns if c not in ("class", "feature"))
    return out.unionByName(shap.select(F.lit("shap_importance").alias("part"), F.col("class").cast("int").alias("class"), "feature",
                                       F.col(col).alias("value")))


def q_poisson_summary(spark, sf):
    from postlytics.operators.regress import poisson_report
    return poisson_report(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL, "id")["summary"]


def q_decision_tree_r2(spark, sf):
    from postlytics.operators.regress import decision_tree_r2
    return decision_tree_r2(regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL, "id")


def _forest_data(spark, sf, kind):
    from postlytics.operators import forest
    from postlytics.operators.sampling import hash_split
    if kind == "regressor":
        df, feats, label = regression_frame(spark, sf, spread_scan=True), REG_FEATURES, REG_LABEL
        df = df.where(F.col(label) > 0).withColumn(label, F.log(label))
    else:
        df, feats, label = classification_frame(spark, sf), CLS_FEATURES, CLS_LABEL
        df = df.withColumn(label, F.col(label).cast("double"))
    d = hash_split(forest.prepare(df, feats, label, kind), "id", 0.25, 42, "_test")
    return d.where(~F.col("_test")), d.where(F.col("_test")), feats, label


def classification_frame(spark, sf):
    """documents joined to labels: text-shape features and the quality label."""
    from postlytics.functions.text import tokens
    d = load_spread(spark, sf, "documents")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "inner")
    return j.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(tokens("text")).cast("double").alias("n_words"),
                    F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
                    *[(F.col("lang") == F.lit(x)).cast("double").alias(f"is_{x}") for x in ["en", "fr", "de", "es"]],
                    F.col("quality"))


def _forest_query(kind, what):
    def q(spark, sf):
        from postlytics.operators import forest
        tr, te, feats, label = _forest_data(spark, sf, kind)
        if what == "search":
            small = {} if kind == "regressor" else {"n_iter": 2, "folds": 3, "grid": SMALL_FOREST_GRID}
            best = forest.random_search(tr, label, kind, "id", **small)
            scores = forest.cv_scores(tr, label, kind, best, "id", folds=3)
            return scores.withColumn("params", F.lit(str(sorted(best.items()))))
        model = forest.fit_forest(tr, label, kind, FOREST_PARAMS)
        if what == "importance":
            return forest.impurity_importance(model, feats)
        if what == "best_tree":
            return forest.best_tree(model, te, label, kind, feats)
        if what == "permutation":
            return forest.permutation_importance(model, te, feats, label, kind, id_col="id")
        if what == "shap":
            return forest.shap_importance(model, te, feats, "id", kind)
        if what == "mean_median":
            return forest.tree_mean_median(model, te, label, "id")
        if what == "in_out":
            return forest.in_out_sample(model, tr, te, label, kind)
        if what == "high":
            return forest.high_scored_error(model, te, label, kind, high_class=1.0)
        raise ValueError(what)
    return q


def _shap_gap(kind):
    """TreeSHAP's identity on the test rows: base plus the row's values is the forest's
    output, for the regressor's mean and for each class's probability."""
    def q(spark, sf):
        from postlytics.operators import forest
        tr, te, feats, label = _forest_data(spark, sf, kind)
        model = forest.fit_forest(tr, label, kind, FOREST_PARAMS)
        parts = []
        for cls in ([0, 1] if kind == "classifier" else [0]):
            sv = forest.shap_values(model, te, feats, "id", kind, cls)
            gap = sum((F.col(f"phi_{f}") for f in feats), F.col("base")) - F.col("output")
            parts.append(sv.agg(F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(gap))).alias("max_gap"))
                         .select(F.lit(cls).alias("class"), "n", "max_gap"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    return q


SQL_SHAP_GAP = f"""
WITH {SQL_REG}
SELECT 0 AS class, count(*) AS n, CASE WHEN count(*) > 0 THEN 0.0::DOUBLE END AS max_gap
FROM reg WHERE {REG_LABEL} > 0 AND ({HASH_SQL.format(x='id', seed=42)} % 10000) < 2500
"""
SQL_SHAP_GAP_CLASSIFIER = f"""
SELECT c.class, count(*) AS n, 0.0::DOUBLE AS max_gap
FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (VALUES (0), (1)) AS c(class)
WHERE d.text IS NOT NULL AND d.lang IS NOT NULL AND d.n_chars IS NOT NULL AND l.quality IS NOT NULL
  AND ({HASH_SQL.format(x='d.doc_id', seed=42)} % 10000) < 2500
GROUP BY c.class
"""


PRICE_BREAKS = [20000.0, 50000.0]


def _three_classes(spark, sf):
    """Line items of low, medium and high price: (model, test rows, features)."""
    from postlytics.operators import forest
    from postlytics.operators.sampling import hash_split
    price = F.when(F.col(REG_LABEL) <= PRICE_BREAKS[0], 0.0).when(F.col(REG_LABEL) <= PRICE_BREAKS[1], 1.0).otherwise(2.0)
    d = hash_split(regression_frame(spark, sf, spread_scan=True).withColumn("price_class", price), "id", 0.25, 42, "_test")
    d = forest.prepare(d, REG_FEATURES, "price_class", "classifier")
    model = forest.fit_forest(d.where(~F.col("_test")), "price_class", "classifier", FOREST_PARAMS)
    return model, d.where(F.col("_test"))


def q_shap_gap_by_class(spark, sf):
    """TreeSHAP's identity for each of three classes, all from one evaluation."""
    from postlytics.operators import forest
    model, te = _three_classes(spark, sf)
    gap = sum((F.col(f"phi_{f}") for f in REG_FEATURES), F.col("base")) - F.col("output")
    return forest.shap_values_by_class(model, te, REG_FEATURES, "id").groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(gap))).alias("max_gap"))


def q_shap_importance_by_class(spark, sf):
    from postlytics.operators import forest
    model, te = _three_classes(spark, sf)
    return forest.shap_importance_by_class(model, te, REG_FEATURES, "id")


SQL_SHAP_GAP_BY_CLASS = f"""
WITH {SQL_REG}
SELECT c.class, count(*) AS n, 0.0::DOUBLE AS max_gap FROM reg CROSS JOIN (VALUES (0), (1), (2)) AS c(class)
WHERE ({HASH_SQL.format(x='id', seed=42)} % 10000) < 2500 GROUP BY c.class
"""


def q_split_limit(spark, sf):
    """A forest that splits no node of under ``SPLIT_LIMIT`` rows: its nodes that break
    this, whether the limit cut anything, and the training rows that reach a leaf of each tree."""
    from postlytics.operators import forest
    tr, _, _, label = _forest_data(spark, sf, "regressor")
    return forest.split_account(forest.fit_forest(tr, label, "regressor", FOREST_PARAMS), tr, SPLIT_LIMIT)


SPLIT_LIMIT = 100
SQL_SPLIT_LIMIT = f"""
WITH {SQL_REG}, n AS (SELECT count(*) AS n FROM reg WHERE {REG_LABEL} > 0 AND ({HASH_SQL.format(x='id', seed=42)} % 10000) >= 2500)
SELECT t::INTEGER AS tree, 0::BIGINT AS small_splits, true AS cut, n FROM n CROSS JOIN range({FOREST_PARAMS['numTrees']}) r(t)
"""


def q_tree_mean_gap(spark, sf):
    """The mean of the trees' predictions is the forest's, on the sampled test rows."""
    from postlytics.operators import forest
    tr, te, _, label = _forest_data(spark, sf, "regressor")
    model = forest.fit_forest(tr, label, "regressor", FOREST_PARAMS)
    rows = forest.tree_mean_median(model, te, label, "id")
    whole = model.transform(te).select("id", "prediction")
    return rows.join(whole, "id").select("id", r6(label).alias("log_price"),
                                         r6(F.abs(F.col("tree_mean") - F.col("prediction"))).alias("gap")).distinct()


SQL_TREE_MEAN_GAP = f"""
WITH {SQL_REG},
s AS (SELECT id, {REG_LABEL} FROM reg WHERE {REG_LABEL} > 0 AND ({HASH_SQL.format(x='id', seed=42)} % 10000) < 2500
      ORDER BY {HASH_SQL.format(x='id', seed=42)}, id LIMIT 10)
SELECT DISTINCT id, round(ln({REG_LABEL}), 6) AS log_price, 0.0::DOUBLE AS gap FROM s
"""


def q_kmeans_silhouette(spark, sf):
    from postlytics.operators.stats import silhouette_sweep
    p = karma_posts_from_orders(spark, sf)
    return silhouette_sweep(p, SPEARMAN_COLS, range(2, 11), seed=42)


def q_topics(spark, sf):
    from postlytics.operators.topics import topic_table
    docs = load_spread(spark, sf, "documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Document"))
    from postlytics.functions.text import length_bucket
    docs = docs.withColumn("Length", length_bucket("Document"))
    return topic_table(docs, "Id", "Document", "Length", fixed.ENGLISH_STOP_WORDS)


def q_topic_one_hot(spark, sf):
    from postlytics.plans.features import topic_one_hot
    e = load(spark, sf, "embeddings").select("vec_id", F.col("label").alias("topic"))
    return e.select("vec_id", *topic_one_hot(e, "topic", 10))


SQL_TOPIC_ONE_HOT = "SELECT vec_id, " + ", ".join(
    f"(label = {i})::INTEGER AS topic_{i}" for i in range(10)) + " FROM embeddings"


def q_title_vectors(spark, sf):
    from postlytics.operators.topics import title_vectors
    c = load(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    v = title_vectors(c, "text", "id", fixed.ENGLISH_STOP_WORDS)
    return v.select("id", "vector")


def q_title_vector_norms(spark, sf):
    """Length of each title's vector: 1, or 0 for a title without a word."""
    return q_title_vectors(spark, sf).select("id", r6(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


def _sql_title_vector_norms():
    kept = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_" + WS_SQL[1:-1] + "]', '', 'g')"
    stop = sql_list(sorted(set(fixed.ENGLISH_STOP_WORDS)))
    return f"""
SELECT conv_id * 1000 + turn AS id,
       (CASE WHEN len(list_filter({sql_tokens(kept)}, lambda w: NOT list_contains({stop}, w))) > 0 THEN 1 ELSE 0 END)::DOUBLE AS norm
FROM conversations
"""


def q_prototype_label(spark, sf):
    from postlytics.operators.classify import prototype_label, prototypes
    e = load(spark, sf, "embeddings")
    out = prototype_label(e, "embedding", prototypes(e, "embedding", "label"))
    return out.select("vec_id", "label", "predicted_label")


SQL_PROTOTYPE_LABEL = """
WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(v::DOUBLE) AS mv FROM x GROUP BY label, pos),
p AS (SELECT label AS plabel, list(mv ORDER BY pos) AS proto FROM m GROUP BY label),
s AS (SELECT e.vec_id, e.label, p.plabel,
             list_cosine_similarity(e.embedding::DOUBLE[], p.proto) AS sim FROM embeddings e CROSS JOIN p)
SELECT vec_id, label, arg_max(plabel, (sim, -plabel)) AS predicted_label FROM s GROUP BY vec_id, label
"""


def q_text_classifier(spark, sf):
    from postlytics.operators.classify import text_classifier
    d = load_spread(spark, sf, "documents").select("doc_id", "text")
    train = d.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return text_classifier(train, d, "text", "quality", "doc_id")["predictions"]


def q_text_classifier_accuracy(spark, sf):
    from postlytics.operators.classify import text_classifier
    d = load_spread(spark, sf, "documents").select("doc_id", "text")
    train = d.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return text_classifier(train, d, "text", "quality", "doc_id")["test_accuracy"]


def q_last_url_per_id(spark, sf):
    """A3/E5 over events: a user's url (props) of the latest event."""
    from postlytics.sources.files import last_url_per_id
    p = posts_from_events(spark, sf).select(F.col("by").alias("user"), "time", F.col("id").alias("event"), "url")
    return last_url_per_id(p, ["time", "event"], "user")


SQL_LAST_URL_PER_ID = f"""
SELECT user_id AS "user", arg_max(props, ({T_SQL}, event_id)) AS url FROM events GROUP BY user_id
"""


# --------------------------------------------------------------------------
def spark_queries() -> dict:
    q = {
        "hourly_median": q_hourly_median,
        "time_features": q_time_features,
        "weekday_mean": q_weekday_mean,
        "hour_mean": q_hour_mean,
        "hour_median": q_hour_median,
        "dense_index": q_dense_index,
        "lag_difference": q_lag_difference,
        "keyed_permutation": q_keyed_permutation,
        "first_page_time": q_first_page_time,
        "rolling_median_30": q_rolling_median_30,
        "repeat_12h": _q_repeat(12),
        "repeat_48h": _q_repeat(48),
        "top_scores": q_top_scores,
        "top_comments": q_top_comments,
        "first_rows": _first_rows(False),
        "last_rows": _first_rows(True),
        "author_buckets": q_author_buckets,
        "karma_buckets": q_karma_buckets,
        "median_of_medians": _q_author_stat("median"),
        "mean_of_means": _q_author_stat("mean"),
        "global_stats": q_global_stats,
        "front_page_summary": q_front_page_summary,
        "front_page_histograms": q_front_page_histograms,
        "value_counts": q_value_counts,
        "score_points": q_score_points,
        "feature_pairs": q_feature_pairs,
        "csv_bad_cells": q_csv_bad_cells,
        "box_by_lang": q_box_by_lang,
        "box_by_flag": q_box_by_flag,
        "histogram10": q_histogram10,
        "keep_best": q_keep_best,
        "first_per_key": q_first_per_key,
        "keep_duplicated": q_keep_duplicated,
        "insert_or_ignore": q_insert_or_ignore,
        "membership_flag": q_membership_flag,
        "title_flags": q_title_flags,
        "url_flags": q_url_flags,
        "title_keywords": q_title_keywords,
        "word_counts": q_word_counts,
        "top_words": q_top_words,
        "buzzwords": q_buzzwords,
        "url_domain": q_url_domain,
        "keyword_reports": q_keyword_reports,
        "html_text": q_html_text,
        "page_text": q_page_text,
        "post_features": q_post_features,
        "post_features_full": q_post_features_full,
        "clean_pages": q_clean_pages,
        "length_bucket": q_length_bucket,
        "prepare_documents": q_prepare_documents,
        "pearson_long": q_pearson_long,
        "spearman_long": q_spearman_long,
        "standardise": q_standardise,
        "dispersion": q_dispersion,
        "vif": q_vif,
        "durbin_watson": q_durbin_watson,
        "qq_points": q_qq_points,
        "normality": q_normality,
        "normal_points": q_normal_points,
        "normality_distance": q_normality_distance,
        "hash_split": q_hash_split,
        "undersample": q_undersample,
        "sample_rows": q_sample_rows,
        "kfold": q_kfold,
        "stratified_folds": q_stratified_folds,
        "breusch_pagan": q_breusch_pagan,
        "lasso_coefficients": q_lasso_coefficients,
        "lasso_summary": q_lasso_summary,
        "lasso_kkt": q_lasso_kkt,
        "poisson_score": q_poisson_score,
        "ols_coefficients": q_ols_coefficients,
        "ols_summary": q_ols_summary,
        "ols_residuals": q_ols_residuals,
        "poisson_summary": q_poisson_summary,
        "decision_tree_r2": q_decision_tree_r2,
        "forest_search_regressor": _forest_query("regressor", "search"),
        "forest_search_classifier": _forest_query("classifier", "search"),
        "forest_importance": _forest_query("regressor", "importance"),
        "best_tree_rules": _forest_query("regressor", "best_tree"),
        "best_tree_rules_classifier": _forest_query("classifier", "best_tree"),
        "permutation_importance": _forest_query("regressor", "permutation"),
        "shap_gap": _shap_gap("regressor"),
        "shap_gap_classifier": _shap_gap("classifier"),
        "tree_mean_gap": q_tree_mean_gap,
        "shap_gap_by_class": q_shap_gap_by_class,
        "shap_importance_by_class": q_shap_importance_by_class,
        "shap_importance": _forest_query("regressor", "shap"),
        "shap_importance_classifier": _forest_query("classifier", "shap"),
        "split_limit": q_split_limit,
        "regression_study": q_regression_study,
        "forest_study": q_forest_study,
        "tree_mean_median": _forest_query("regressor", "mean_median"),
        "in_out_sample": _forest_query("classifier", "in_out"),
        "in_out_sample_regressor": _forest_query("regressor", "in_out"),
        "high_scored_error": _forest_query("classifier", "high"),
        "high_scored_error_regressor": _forest_query("regressor", "high"),
        "kmeans_silhouette": q_kmeans_silhouette,
        "topics": q_topics,
        "topic_one_hot": q_topic_one_hot,
        "title_vectors": q_title_vectors,
        "title_vector_norms": q_title_vector_norms,
        "prototype_label": q_prototype_label,
        "text_classifier": q_text_classifier,
        "text_classifier_accuracy": q_text_classifier_accuracy,
        "last_url_per_id": q_last_url_per_id,
    }
    return q


def oracle_sql() -> dict:
    words = _sql_words(fixed.ENGLISH_STOP_WORDS)
    top = f"""
WITH {words},
c AS (SELECT word, count(*) AS count, min(doc_id * 10000000 + pos) AS first FROM words GROUP BY word),
t AS (SELECT word, count, first FROM c ORDER BY count DESC, first LIMIT {fixed.BUZZWORD_COUNT})
SELECT word, count, row_number() OVER (ORDER BY count DESC, first)::BIGINT AS rank FROM t
"""
    buzz = f"""
WITH {words},
c AS (SELECT word, count(*) AS count, min(doc_id * 10000000 + pos) AS first FROM words GROUP BY word),
t AS (SELECT list(word) AS kw FROM (SELECT word FROM c ORDER BY count DESC, first LIMIT {fixed.BUZZWORD_COUNT})),
m AS (SELECT conv_id, turn, text, list_filter({sql_tokens('text')}, lambda w: list_contains(t.kw, w)) AS hits
      FROM conversations CROSS JOIN t)
SELECT conv_id, turn,
  CASE WHEN text IS NULL OR text = '' THEN NULL ELSE array_to_string(hits, '|') END AS buzzwords_detail,
  (CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(hits) END)::INTEGER AS contains_buzzwords
FROM m
"""
    return {
        "hourly_median": SQL_HOURLY_MEDIAN,
        "time_features": SQL_TIME_FEATURES,
        "weekday_mean": SQL_WEEKDAY_MEAN,
        "hour_mean": SQL_HOUR_MEAN,
        "hour_median": SQL_HOUR_MEDIAN,
        "dense_index": SQL_DENSE_INDEX,
        "first_page_time": SQL_FIRST_PAGE_TIME,
        "rolling_median_30": SQL_ROLLING_MEDIAN_30,
        "repeat_12h": _sql_repeat(12),
        "repeat_48h": _sql_repeat(48),
        "top_scores": SQL_TOP_SCORES,
        "top_comments": SQL_TOP_COMMENTS,
        "first_rows": _sql_first_rows(False),
        "last_rows": _sql_first_rows(True),
        "author_buckets": SQL_AUTHOR_BUCKETS,
        "karma_buckets": SQL_KARMA_BUCKETS,
        "median_of_medians": _sql_author_stat("median"),
        "mean_of_means": _sql_author_stat("mean"),
        "global_stats": SQL_GLOBAL_STATS,
        "front_page_summary": _sql_front_page_summary(),
        "front_page_histograms": _sql_front_page_histograms(),
        "value_counts": SQL_VALUE_COUNTS,
        "score_points": SQL_SCORE_POINTS,
        "box_by_lang": SQL_BOX_BY_LANG,
        "box_by_flag": SQL_BOX_BY_FLAG,
        "histogram10": SQL_HISTOGRAM10,
        "keep_best": SQL_KEEP_BEST,
        "first_per_key": SQL_FIRST_PER_KEY,
        "keep_duplicated": SQL_KEEP_DUPLICATED,
        "insert_or_ignore": SQL_INSERT_OR_IGNORE,
        "membership_flag": SQL_MEMBERSHIP_FLAG,
        "title_flags": SQL_TITLE_FLAGS,
        "url_flags": SQL_URL_FLAGS,
        "title_keywords": SQL_TITLE_KEYWORDS,
        "word_counts": f"WITH {words} SELECT word, count(*) AS count FROM words GROUP BY word",
        "top_words": top,
        "buzzwords": buzz,
        "url_domain": _sql_url_domain(),
        "keyword_reports": _sql_keyword_reports(),
        "shap_gap": SQL_SHAP_GAP,
        "shap_gap_by_class": SQL_SHAP_GAP_BY_CLASS,
        "shap_gap_classifier": SQL_SHAP_GAP_CLASSIFIER,
        "split_limit": SQL_SPLIT_LIMIT,
        "regression_study": _sql_regression_study(),
        "tree_mean_gap": SQL_TREE_MEAN_GAP,
        "post_features": _sql_post_features(SQL_EVENT_POSTS, {"event_kind": EVENT_KIND_KEYWORDS}, {"domain": DOMAIN_KEYWORDS}),
        "post_features_full": _sql_post_features(SQL_FULL_POSTS, TITLE_LISTS, URL_LISTS, topics=True),
        "clean_pages": _sql_clean_pages(),
        "html_text": page_sql.sql_html_text(),
        "page_text": page_sql.sql_page_text(),
        "prepare_documents": _sql_prepare_documents(),
        "length_bucket": _sql_length_bucket(),
        "pearson_long": _sql_pearson(),
        "spearman_long": _sql_spearman(),
        "standardise": _sql_standardise(),
        "dispersion": _sql_dispersion(),
        "vif": _sql_vif(),
        "breusch_pagan": _sql_breusch_pagan(),
        "ols_coefficients": _sql_ols_coefficients(),
        "ols_summary": _sql_ols_summary(),
        "ols_residuals": _sql_ols_residuals(),
        "last_url_per_id": SQL_LAST_URL_PER_ID,
        "durbin_watson": SQL_DURBIN_WATSON,
        "feature_pairs": _sql_feature_pairs(),
        "csv_bad_cells": _sql_csv_bad_cells(),
        "lag_difference": SQL_LAG_DIFFERENCE,
        "keyed_permutation": _sql_keyed_permutation(),
        "lasso_kkt": _sql_certificate(f"{REG_LABEL} > 0"),
        "poisson_score": _sql_certificate(f"({HASH_SQL.format(x='id', seed=42)} % 10000) >= 2500"),
        "qq_points": _sql_qq(),
        "normal_points": _sql_normal_points(),
        "normality_distance": _sql_normality_distance(),
        "hash_split": SQL_HASH_SPLIT,
        "undersample": SQL_UNDERSAMPLE,
        "sample_rows": SQL_SAMPLE_ROWS,
        "kfold": SQL_KFOLD,
        "stratified_folds": SQL_STRATIFIED_FOLDS,
        "topic_one_hot": SQL_TOPIC_ONE_HOT,
        "title_vector_norms": _sql_title_vector_norms(),
        "prototype_label": SQL_PROTOTYPE_LABEL,
    }

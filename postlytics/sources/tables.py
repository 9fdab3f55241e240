"""The driver's Parquet tables and the post-shaped views the operators expect.

Posts are rows with ``id, time (unix s), by (author), score, url, title``.  The
driver has no post table, so two views map its tables onto that shape:

* ``posts_from_events``: id = event_id, time = whole epoch seconds of ts,
  by = user_id, score = value, url = props (about 100 events per key), type = event_type.
* ``karma_posts_from_orders``: one post per order, author = customer, score =
  o_totalprice, user_karma = c_acctbal, user_post_count = orders of the customer.
* ``front_page_from_lineitem``: the line items of an order are the front-page
  snapshots of that post: id = l_orderkey, time = l_shipdate, minutes_since_pub
  = l_linenumber, score = l_quantity; part and supplier key break ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlytics.functions.timefeat import epoch_seconds
from postlytics.session import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for CPU-heavy per-row work (tokenising, cleaning, parsing, wide
    aggregates), spread over the cores when its files give fewer splits than
    cores."""
    return spread(load(spark, sf_dir, name))


def posts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        epoch_seconds("ts").alias("time"),
        F.col("user_id").alias("by"),
        F.col("value").alias("score"),
        F.col("props").alias("url"),
        F.col("event_type").alias("type"),
    )


def karma_posts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    per_customer = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("user_post_count"))
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(per_customer, "o_custkey", "left")
             .select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("by"),
                     F.col("o_totalprice").alias("score"), F.col("c_acctbal").alias("user_karma"),
                     F.col("user_post_count")))


def front_page_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("time"),
                     F.col("l_linenumber").cast("long").alias("minutes_since_pub"),
                     F.col("l_quantity").alias("score"), "l_partkey", "l_suppkey")

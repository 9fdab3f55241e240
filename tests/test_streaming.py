"""The streaming hourly median equals the batch one (D3) on the driver's events."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from postlytics.functions.timefeat import epoch_hour, epoch_seconds
from postlytics.operators import explore
from postlytics.streaming.hourly import start_hourly_median

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def _prepare(raw):
    return raw.select(epoch_seconds("ts").alias("time"), F.lit(30).cast("long").alias("minutes_since_pub"),
                      F.col("value").alias("score"))


def _batch(spark):
    snaps = _prepare(spark.read.parquet(f"{SF}/events.parquet")).withColumn(
        "scraped_at_hour", epoch_hour("time", "minutes_since_pub"))
    return {r.scraped_at_hour: r.m for r in
            explore.group_stat(snaps, "scraped_at_hour", "score", "median", "m").collect()}


def test_complete_mode_equals_batch(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    name = "hm_" + uuid.uuid4().hex[:8]
    q = start_hourly_median(spark, f"{SF}/events.parque[t]", schema, _prepare, name=name,
                            output_mode="complete")
    q.awaitTermination(300)
    got = {r.scraped_at_hour: r.hourly_median_fp_score for r in spark.table(name).collect()}
    assert got == _batch(spark)


def test_append_mode_emits_only_closed_hours(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    name = "hma_" + uuid.uuid4().hex[:8]
    q = start_hourly_median(spark, f"{SF}/events.parque[t]", schema, _prepare, name=name,
                            output_mode="append", lateness="0 seconds")
    q.awaitTermination(300)
    got = {r.scraped_at_hour: r.hourly_median_fp_score for r in spark.table(name).collect()}
    batch = _batch(spark)
    # after the data batch a no-data batch moves the watermark to the newest
    # snapshot: every hour but the newest is closed and emitted, once
    assert set(got) == set(batch) - {max(batch)}
    assert all(batch[h] == v for h, v in got.items())


def test_streaming_repeat_counts_equal_batch(spark):
    from postlytics.operators.repeats import repeat_counts
    from postlytics.streaming.hourly import checkpoint_location
    from postlytics.streaming.repeats import repeat_counts_stream
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{SF}/events.parque[t]")
    ev = raw.select(F.col("event_id").alias("id"), F.col("props").alias("url"), epoch_seconds("ts").alias("time"))
    hs = {"c12": 12 * 3600, "c48": 48 * 3600}
    name = "rc_" + uuid.uuid4().hex[:8]
    q = (repeat_counts_stream(ev, "url", "time", "id", hs, lateness="0 seconds")
         .writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint_location(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.id: (r.c12, r.c48) for r in spark.table(name).collect()}
    batch_in = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_id").alias("id"), F.col("props").alias("url"), epoch_seconds("ts").alias("time"))
    want = {r.id: (r.c12, r.c48) for r in repeat_counts(batch_in, "url", "time", hs).collect()}
    newest = batch_in.agg(F.max("time")).first()[0]
    assert got and all(want[i] == v for i, v in got.items())
    # everything older than the final watermark (the newest time) was emitted
    older = {r.id for r in batch_in.where(F.col("url").isNotNull() & (F.col("time") < newest)).collect()}
    assert older <= set(got)

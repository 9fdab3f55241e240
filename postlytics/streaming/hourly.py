"""Incremental hourly front-page median (D3) with Structured Streaming.

Front-page snapshots arrive as files.  Each snapshot belongs to the hour it was
scraped in, ``(time + minutes_since_pub * 60) // 3600`` -- the batch rule of
I4 -- which is a one-hour tumbling event-time window (windows are aligned to
the epoch, so window start / 3600 is that hour).  The watermark bounds the state:
in append mode an hour is emitted once, when the watermark has passed its end,
and its state is dropped; snapshots later than the allowed lateness are ignored.
``complete`` mode re-emits every hour and keeps all state (small inputs, tests).

State and the file sink's commit log live under the cluster's shared
``spark.checkpoint.dir``, so a restarted query (or a lost executor) resumes from
the last committed micro-batch with exactly-once output files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postlytics.session import ensure_checkpoint_dir


def hourly_median_stream(snapshots: DataFrame, time: str = "time", minutes: str = "minutes_since_pub",
                         value: str = "score", lateness: str = "2 hours") -> DataFrame:
    """Streaming (scraped_at_hour, hourly_median_fp_score, n) from a streaming
    frame of snapshots with epoch-second ``time`` and ``minutes`` since publication."""
    scraped = F.timestamp_seconds(F.col(time) + F.col(minutes) * F.lit(60))
    return (snapshots.withColumn("_scraped", scraped)
                     .withWatermark("_scraped", lateness)
                     .groupBy(F.window("_scraped", "1 hour"))
                     .agg(F.median(value).alias("hourly_median_fp_score"),
                          F.count(F.lit(1)).alias("n"))
                     .select(F.floor(F.unix_seconds(F.col("window.start")) / F.lit(3600))
                              .cast("long").alias("scraped_at_hour"),
                             "hourly_median_fp_score", "n"))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A per-query folder inside the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def start_hourly_median(spark: SparkSession, source: str, schema, prepare, sink: str | None = None,
                        name: str = "hourly_median", output_mode: str = "append",
                        available_now: bool = True, lateness: str = "2 hours") -> StreamingQuery:
    """Read Parquet files at ``source`` (a directory or glob) with ``schema``, map
    them to snapshots with ``prepare`` (raw streaming frame -> time, minutes,
    score), and write hourly medians to ``sink`` (Parquet, append) or, when
    ``sink`` is None, to an in-memory table called ``name``."""
    raw = spark.readStream.schema(schema).parquet(source)
    out = hourly_median_stream(prepare(raw), lateness=lateness)
    w = (out.writeStream.outputMode(output_mode)
            .option("checkpointLocation", checkpoint_location(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    if sink is None:
        return w.format("memory").queryName(name).start()
    return w.format("parquet").option("path", sink).start()

"""Session helpers: one place for the Spark settings the operators assume."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session built here carries.  AQE re-plans joins and coalesces
# small shuffles at run time; skew-join splitting guards the equi-joins on keys
# that may be hot (url, author, text).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a correlation matrix or Gram matrix is one aggregate with hundreds of
    # buffer fields; above this limit the stage would run interpreted
    "spark.sql.codegen.maxFields": "512",
    # the range-partitioned operators checkpoint to the shared folder; delete a
    # checkpoint once nothing references its data any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "postlytics",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; where none is set, a local
    run falls back to a fresh local folder and a cluster run is refused, as its
    machines could not read each other's files."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="postlytics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (reliable checkpoint).

    Used where two branches of a plan must see the *same* rows (range bounds are
    sampled, so re-running a range shuffle may move rows between partitions) and
    to keep long lineages short so a lost executor recomputes little."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files (and, where it is set to, checkpoints)
    of frames that nothing refers to any more.  The cleaner follows the garbage collection of
    the driver, which a small driver heap may not need for as long as a job of many steps lasts."""
    gc.collect()
    spark._jvm.System.gc()


def fit_held(estimator, train: DataFrame, label: str):
    """``estimator`` fitted to ``train``'s columns ``features`` and ``label``, which are held
    while it fits: a learner scans its rows many times (the forest three times before it
    keeps its own copy, the linear models once a step), and each scan would repeat
    the joins and hashes behind ``train``.  Partitions and order stay, so the model does."""
    if train.storageLevel.useMemory or train.storageLevel.useDisk:
        return estimator.fit(train)
    held = train.select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(held)
    finally:
        held.unpersist()


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin ``df`` over ``factor`` x the cluster's cores when its scan gives
    fewer partitions than there are cores (one large Parquet row group is read by
    one task).  Used in front of per-row text work -- tokenising, regex cleaning,
    HTML parsing -- which is CPU-bound.  A large table already has many more
    splits than cores and is passed through without a shuffle.

    Call it on a scan (or a projection or filter of one): for a plan that already
    contains a shuffle, AQE would have to run that shuffle to count partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(factor * cores)

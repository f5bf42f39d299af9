"""Session settings, and the shared folder for state that must outlive executors."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch after which the next one begins, where the session names no limit.
BATCH_BYTES = 4 << 20


def local_session(cores: int | str = "*", app_name: str = "moodtide") -> SparkSession:
    """A session for tests and benches. On a cluster, use the one spark-submit gives."""
    partitions = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.minPartitionNum", str(partitions))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All times are zone-free; streams pass through zoned timestamps and need UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches bounded by bytes, not by their number alone.

    Executors build a batch outside of their heap, in buffers that double as they grow, and a worker
    holds it whole; 10,000 whole texts, or pairs of texts' cells, take tens of megabytes for every task.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode without one, a temporary folder."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named is None:
        named = spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the whole cluster shares")
    return (named or _temporary_dir(spark.sparkContext.applicationId)).rstrip("/")


@functools.cache
def _temporary_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"moodtide-{application}-")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

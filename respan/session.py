"""Session construction and shared-folder helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # broadcast only what the planner can prove small; explicit broadcasts in the
    # library are limited to tables with a constant size bound
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "respan") -> SparkSession:
    """Return the active session or build one with the library defaults.

    On a cluster the session is normally created by the launcher; this helper then
    only returns it.  Locally it builds ``local[*]`` with AQE on and the UI off.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RESPAN_MASTER", "local[*]"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RESPAN_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; we only pick a local scratch
    folder when the setting is absent (tests, local runs).
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    # unset only in local runs and tests: pick a scratch folder and remember it
    local = tempfile.mkdtemp(prefix="respan-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # static conf on some deployments; the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def stored(df, name: str):
    """Write ``df`` once below the shared folder and read it back: the work before it is done
    once, and what is read survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.  Spark deletes them once the driver's JVM has collected
    what refers to them; with a large heap that may be long after a query of many shuffles has filled the disk."""
    for _ in range(2):  # the first collection lets go of what refers to the handles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)

"""Spark session defaults and the shared checkpoint folder.

Every operator in the package is a DataFrame -> DataFrame function and never
creates its own session; this module is only used by tests, ``bench.py`` and
scripts.  The settings below matter at scale:

* AQE on, with skew-join splitting: hot conversations / sources are split at
  runtime when an aggregated side is joined back to the detail rows.
* ``autoBroadcastJoinThreshold`` is left at Spark's default: AQE only turns a
  join into a broadcast after measuring the real size of the small side, which
  is the size check required before broadcasting.
* The UI is off (no server is started).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "colloquy") -> SparkSession:
    master = master or os.environ.get("COLLOQUY_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("COLLOQUY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    A folder is only created here when the session has none *and* runs in
    local mode (tests, bench); on a cluster the setting must name shared
    storage and is used as is.
    """
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="colloquy-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path

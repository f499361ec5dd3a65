"""SparkSession helpers.

Library code never creates its own session; callers (tests, bench, the
pipeline job) use :func:`get_spark` or pass their own session in.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "gridpulse") -> SparkSession:
    """The session of a job. Started by spark-submit, master, shuffle partitions
    and memory stay as the launcher has set them; a plain Python process gets
    a local session for tests."""
    builder = SparkSession.builder.appName(app_name)
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = (builder.master(master or os.environ.get("GRIDPULSE_MASTER", "local[8]"))
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
                   .config("spark.driver.memory", os.environ.get("GRIDPULSE_DRIVER_MEM", "8g")))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (spark.checkpoint.dir).

    On a cluster the folder is set by the deployment and is read as is; only
    when it is unset (local tests) a scratch folder is made.
    """
    cp = spark.conf.get("spark.checkpoint.dir", None)
    if not cp:
        cp = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not cp and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not cp:
        cp = tempfile.mkdtemp(prefix="gridpulse-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", cp)
    spark.sparkContext.setCheckpointDir(cp)
    return cp


def case_sensitive(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, in which names that differ in case only are two columns: frames made in it can be written."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.caseSensitive", "true")
    return own

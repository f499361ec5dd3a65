"""S12 as a stream: new daily load files arrive in a folder; each micro-batch is a load of the bucketed stage.

A batch rewrites only the buckets its keys fall into, and commits under its batch id: a batch that the engine repeats after a failure is known
and does nothing. Progress is in the stream checkpoint, which must sit in the cluster's shared folder.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.incremental import BucketedStage


def current_snapshot(spark: SparkSession, staging: str) -> DataFrame | None:
    """The staging table as last committed; None before the first batch."""
    return BucketedStage(spark, staging).frame()


def upsert_batch(staging: str, key, order_col: str = "load_ts", buckets: int = 64):
    def fn(batch: DataFrame, batch_id: int) -> None:
        BucketedStage(batch.sparkSession, staging, key, buckets, order_col).load(batch, f"batch-{batch_id}")
    return fn


def start_incremental_upsert(spark: SparkSession, source_dir: str, schema: StructType, key, staging: str,
                             checkpoint: str | None = None, order_col: str = "load_ts", fmt: str = "parquet",
                             available_now: bool = True, buckets: int = 64):
    """Start the stream; with available_now it processes what is there and stops."""
    if checkpoint is None:
        checkpoint = os.path.join(spark.conf.get("spark.checkpoint.dir"), "incremental-upsert")
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = src.writeStream.foreachBatch(upsert_batch(staging, key, order_col, buckets)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 day")
    return w.start()

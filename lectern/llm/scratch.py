"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from ..scratch import drop_scratch, materialise, scratch_dir

__all__ = ["drop_scratch", "materialise", "release", "scratch_dir"]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it keeps until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

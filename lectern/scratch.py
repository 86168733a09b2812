"""Intermediate tables in the folder that driver and executors share.

A lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs a re-read and not a recomputation.  The setting is
read from the session; only where it is unset and the master is local (tests, a laptop) a
temporary folder takes its place, and on a cluster without the setting the job stops with an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new, unique path below the shared checkpoint folder (not created yet)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")  # the setting itself can't be changed in a running session
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lectern-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Registered queries that run as streams over a table's files, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir
from ..streaming import jobs as J
from .common import ORACLES, QUERIES, table
from .table_queries import _ACTIONS

_STORE = "spark.sql.streaming.stateStore.providerClass"


def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job states of ``l1_job_states`` from an available-now stream over the files of ``events``.

    Files come in no order of time, so no action counts as late: the watermark stays behind all of them.
    """
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be a file or a folder
    acts = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.get(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") % 10).cast("int")).alias("action"))
    folder, before = scratch_dir(spark), spark.conf.get(_STORE)
    try:
        J.use_state_store(spark)
        states = J.watched_jobs(acts, "user_id", "ts", "event_id", "action", late="36500 days")
        states.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    rows = spark.read.schema("job long, status string, resume_count long, rejected long, version long").parquet(f"{folder}/rows")
    last = rows.groupBy(F.col("job").alias("user_id")).agg(F.max_by(F.struct("status", "resume_count", "rejected"), "version").alias("s"))
    return last.select("user_id", "s.status", F.col("s.resume_count").cast("int").alias("resume_count"), F.col("s.rejected").cast("int").alias("rejected"))


QUERIES["l1_job_stream"] = job_stream
ORACLES["l1_job_stream"] = ORACLES["l1_job_states"]

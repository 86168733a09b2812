"""Job life cycle and resource samples as streams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import status_transition

_ALLOWED = {
    "start": ({"pending"}, "generating"),
    "finish": ({"generating"}, "completed"),
    "pause": ({"pending", "parsing", "analyzing", "generating", "processing"}, "paused"),
    "resume": ({"paused", "failed", "cancelled"}, "generating"),
}
_ENDED = {"completed", "failed", "cancelled"}
_NEVER = -(1 << 62)


def events_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with ts as an event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sampled_peaks(stream: DataFrame, time: str = "ts", value: str = "value", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, peak, samples for each window; rows later than ``late`` are dropped with its state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w")).agg(F.max(value).alias("peak"), F.count("*").alias("samples")).select(F.col("w.start").alias("start"), "peak", "samples")


def next_status(status: str, action: str) -> str:
    """As ``status_transition``, for one row."""
    if action in ("fail", "cancel"):
        return status if status in _ENDED else "failed" if action == "fail" else "cancelled"
    allowed, to = _ALLOWED.get(action, (set(), status))
    return to if status in allowed else status


def job_states(stream: DataFrame, job: str, time: str, action: str) -> DataFrame:
    """job, status, resume_count, rejected after each micro-batch; state is three fields for each job."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, resumed, rejected = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        for a in rows["a"]:
            to = next_status(status, a)
            resumed, rejected, status = resumed + (to != status and a == "resume"), rejected + (to == status), to
        state.update((status, int(resumed), int(rejected)))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "resume_count": [int(resumed)], "rejected": [int(rejected)]})

    rows = stream.select(F.col(job).cast("long").alias("job"), F.col(time).alias("t"), F.col(action).alias("a"))
    return rows.groupBy("job").applyInPandasWithState(step, "job long, status string, resume_count long, rejected long", "status string, resumed long, rejected long", "update", GroupStateTimeout.NoTimeout)


class _Jobs(StatefulProcessor):
    """State of one job: where it stands by all actions older than the watermark, and the younger ones as they came."""

    def __init__(self, stalled: int, keep: int | None) -> None:
        self.stalled, self.keep = stalled, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, resumed long, rejected long, last long, id long, newest long, seen long")
        self.pending = handle.getListState("pending", "t long, id long, action string")

    def _state(self) -> list:
        return list(self.settled.get()) if self.settled.exists() else ["pending", 0, 0, _NEVER, 0, _NEVER, 0]

    def _apply(self, state: list, rows: list[tuple]) -> list:
        status, resumed, rejected, last, number, newest, seen = state
        for t, i, a in rows:
            to = next_status(status, a)
            resumed, rejected, status, last, number = resumed + (to != status and a == "resume"), rejected + (to == status), to, t, i
        return [status, resumed, rejected, last, number, newest, seen]

    def _settle(self, state: list, rows: list[tuple], watermark: int) -> tuple[list, list[tuple]]:
        """The state after the rows that no earlier one can precede any more, which are all before the watermark, and the rest."""
        rows.sort()
        cut = bisect_left(rows, (watermark * 1000,))
        return self._apply(state, rows[:cut]), rows[cut:]

    def _row(self, key, state: list, rows: list[tuple], stalled: bool) -> pd.DataFrame:
        status, resumed, rejected = self._apply(state, rows)[:3]
        return pd.DataFrame({"job": [key[0]], "status": [status], "resume_count": [resumed], "rejected": [rejected], "stalled": [stalled], "version": [state[6]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, watermark = self._state(), timerValues.getCurrentWatermarkInMs()
        if self.keep is not None and state[5] != _NEVER and state[5] // 1000 + self.keep < watermark:  # its timer is due in this batch
            self.settled.clear()
            self.pending.clear()
            state = self._state()
        known = {(t, i): a for t, i, a in self.pending.get()}
        for part in rows:
            for t, i, a in zip(part["us"].tolist(), part["id"].tolist(), part["a"].tolist(), strict=True):
                if (t, i) > (state[3], state[4]):  # what is not after the settled actions is one of them, come again
                    known.setdefault((t, i), a)
        newest = max([state[5], *(t for t, _ in known)])
        state, left = self._settle(state, [(t, i, a) for (t, i), a in known.items()], watermark)
        if newest > state[5]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            for wait in (0, self.stalled, self.keep):
                if wait is not None:
                    self.handle.registerTimer(newest // 1000 + wait + 1)
        state[5], state[6] = newest, state[6] + 1
        self._put(state, left)
        yield self._row(key, state, left, False)

    def _put(self, state: list, left: list[tuple]) -> None:
        self.settled.update(tuple(state))
        if left:
            self.pending.put(left)
        else:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, state = expiredTimerInfo.getExpiryTimeInMs(), self._state()
        state, left = self._settle(state, [tuple(r) for r in self.pending.get()], timerValues.getCurrentWatermarkInMs())
        since = at - state[5] // 1000 - 1
        if self.keep is not None and since >= self.keep:
            self.settled.clear()
            self.pending.clear()
            return
        still = since >= self.stalled and state[0] == "generating"
        state[6] += still
        self._put(state, left)
        if still:
            yield self._row(key, state, left, True)

    def close(self) -> None:
        pass


def watched_jobs(stream: DataFrame, job: str, time: str, number: str, action: str, late: str = "10 minutes", stalled_ms: int = 3_600_000, keep_ms: int | None = None) -> DataFrame:
    """job, status, resume_count, rejected, stalled, version: a row for each job of each micro-batch, the highest version holds.

    Actions count in the order of (time, number), however they come, and once if they come again;
    later than ``late`` they are dropped.  A job that generates and has no action for ``stalled_ms``
    gives a row that says so; its state goes after ``keep_ms`` without an action (None: never), and a
    job that comes back after that begins anew, at version 1.  Rows without job, time or number are left
    out; an unknown or null action is rejected.  State is what stands and the actions younger than
    the watermark.  The session needs the RocksDB state store (``use_state_store``).
    """
    if keep_ms is not None and keep_ms < stalled_ms:
        raise ValueError("state must be kept for as long as a job may stall")
    rows = stream.select(F.col(job).cast("long").alias("job"), F.col(time).alias("t"), F.col(number).cast("long").alias("id"), F.coalesce(F.col(action), F.lit("")).alias("a"))
    rows = rows.where("job is not null and t is not null and id is not null").withWatermark("t", late).withColumn("us", F.unix_micros("t"))
    kind = "job long, status string, resume_count long, rejected long, stalled boolean, version long"
    return rows.groupBy("job").transformWithStateInPandas(_Jobs(stalled_ms, keep_ms), kind, "Append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """The state store that typed state and timers need, for the streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cancel_tagged(spark: SparkSession, tag: str) -> None:
    """Stop a job's running Spark work by its tag, and streams of that name."""
    spark.sparkContext.cancelJobsWithTag(tag)
    for q in spark.streams.active:
        if q.name == tag:
            q.stop()


def poll_seconds(active: bool) -> int:
    return 5 if active else 30


__all__ = ["cancel_tagged", "events_stream", "job_states", "next_status", "poll_seconds", "sampled_peaks", "status_transition", "use_state_store", "watched_jobs"]

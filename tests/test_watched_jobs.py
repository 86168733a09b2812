"""Job states as a stream with late and repeated actions, stalled jobs and state that expires."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import tables as T
from lectern.streaming import jobs as J

KIND = "job long, t timestamp, n long, a string"
START = datetime(2024, 1, 1, tzinfo=UTC)
ACTIONS = ["start", "pause", "resume", "finish", "fail", "cancel", "start", "resume", None, "other"]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    J.use_state_store(spark)

    def go(batches, **kw):
        folder = str(tmp_path_factory.mktemp("jobs"))
        for rows in batches:
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = J.watched_jobs(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "job", "t", "n", "a", **kw)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        q.awaitTermination(300)
        assert q.exception() is None
        return spark.read.parquet(f"{folder}/out").collect()

    yield go
    spark.conf.set(key, before)


def test_late_and_repeated_actions_equal_a_replay(spark, run):
    rng = random.Random(3)
    rows = [(rng.randrange(6), START + timedelta(minutes=i // 2), i, rng.choice(ACTIONS)) for i in range(400)]
    moved = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 60))  # up to half an hour late
    batches = [moved[i : i + 80] for i in range(0, 400, 80)]
    batches = [b + rng.sample(b, 20) + (rng.sample(batches[k - 1], 10) if k else []) for k, b in enumerate(batches)]
    last = {}
    for r in run(batches, late="6 hours"):
        last[r["job"]] = max(last.get(r["job"], (0,)), (r["version"], r["status"], r["resume_count"], r["rejected"]))
    want = T.replay(spark.createDataFrame(rows, KIND).withColumn("a", F.coalesce("a", F.lit(""))), "job", ["t", "n"], "a")
    assert {j: v[1:] for j, v in last.items()} == {r["job"]: (r["status"], r["resume_count"], r["rejected"]) for r in want.collect()}


def test_settled_actions_are_left_behind(spark, run):
    """Micro-batches in order with a short watermark: state is settled on the way, to the same end."""
    rng = random.Random(5)
    rows = [(i % 3, START + timedelta(minutes=i), i, rng.choice(ACTIONS)) for i in range(300)]
    last = {}
    for r in run([rows[i : i + 60] for i in range(0, 300, 60)], late="1 minute", stalled_ms=10**12):
        last[r["job"]] = max(last.get(r["job"], (0,)), (r["version"], r["status"], r["resume_count"], r["rejected"]))
    want = T.replay(spark.createDataFrame(rows, KIND).withColumn("a", F.coalesce("a", F.lit(""))), "job", ["t", "n"], "a")
    assert {j: v[1:] for j, v in last.items()} == {r["job"]: (r["status"], r["resume_count"], r["rejected"]) for r in want.collect()}


def test_stalled_jobs_and_expiry(run):
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [(1, at(0), 1, "start"), (2, at(0), 2, "start"), (2, at(0.1), 3, "finish"), (None, at(0), 4, "start"), (4, None, 5, "start")],
        [(3, at(3), 6, "start")], [(3, at(4), 7, "pause")], [(3, at(30), 8, "resume")], [(1, at(31), 9, "pause"), (3, at(31), 10, "pause")],
    ]
    rows = run(batches, late="1 minute", stalled_ms=3_600_000, keep_ms=20 * 3_600_000)
    assert {r["job"] for r in rows} == {1, 2, 3}
    assert [(r["job"], r["status"]) for r in rows if r["stalled"]] == [(1, "generating")]
    assert max((r["version"], r["status"]) for r in rows if r["job"] == 2) == (1, "completed")
    assert [r["status"] for r in rows if r["job"] == 1 and r["version"] == 1] == ["generating", "paused"]  # forgotten after 20 hours
    with pytest.raises(ValueError):
        J.watched_jobs(None, "job", "t", "n", "a", stalled_ms=10, keep_ms=5)

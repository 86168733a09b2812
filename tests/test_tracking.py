"""Pitch and tempo on sounds of known pitch and tempo."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio as S
from lectern.functions import tracking as T


def clicks(beats: float, rate: int, seconds: int = 10) -> np.ndarray:
    x, n = np.zeros(rate * seconds), rate // 50
    for s in np.arange(0, len(x) - n, 60 * rate / beats).astype(int):
        x[s : s + n] += np.exp(-np.arange(n) / (rate / 200)) * np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    return x


@pytest.mark.parametrize("rate", [4000, 22050])
@pytest.mark.parametrize("beats", [60, 90, 120])
def test_tempo_of_click_tracks(beats, rate):
    noise = np.random.default_rng(beats).normal(size=rate * 10)
    assert abs(T.tempo_of(clicks(beats, rate), rate) / beats - 1) < 0.002
    assert abs(T.tempo_of(clicks(beats, rate) + 0.01 * noise, rate) / beats - 1) < 0.02


@pytest.mark.parametrize("octaves", [2, -1])
@pytest.mark.parametrize("harmonics", [1, 6])
def test_pitch_of_glides(octaves, harmonics):
    rate, start = 22050, 220.0
    t = np.arange(rate * 3) / rate
    hz = start * 2 ** (octaves * t / 3)
    x = sum(np.sin(k * 2 * np.pi * np.cumsum(hz) / rate) / k for k in range(1, harmonics + 1))
    x[rate : 3 * rate // 2] = 0  # a rest, without pitch
    track = T.pitch_track(x, rate, hop=512)
    at = np.arange(len(track)) * 512
    rest = (at > rate + 1400) & (at < 3 * rate // 2 - 1400)
    clear = ((at > 1400) & (at < rate - 1400)) | ((at > 3 * rate // 2 + 1400) & (at < len(x) - 1400))
    assert np.isnan(track[rest]).all() and np.isfinite(track[clear]).all()
    assert np.abs(track[clear] / hz[at[clear]] - 1).max() < 0.02


def test_no_pitch_and_no_beat():
    noise = np.random.default_rng(1).normal(size=22050)
    assert np.isnan(T.pitch_track(noise, 22050)).mean() > 0.95
    for flat in (np.zeros(5000), np.ones(5000), np.zeros(1), np.zeros(0)):
        assert np.isnan(T.pitch_track(flat, 8000)).all() and T.tempo_of(flat, 8000) == 120.0


def test_blocks_of_frames_agree(monkeypatch):
    x = np.concatenate([np.sin(2 * np.pi * 200 * np.arange(20000) / 8000), clicks(90, 8000)])
    whole = T.pitch_track(x, 8000), T.tempo_of(x, 8000)
    monkeypatch.setattr(T, "BLOCK", 7)
    parts = T.pitch_track(x, 8000), T.tempo_of(x, 8000)
    assert np.array_equal(np.isnan(whole[0]), np.isnan(parts[0])) and np.allclose(whole[0], parts[0], equal_nan=True) and np.isclose(whole[1], parts[1])


def test_tracked_rows(spark):
    rate = 4000
    tone = [float(v) for v in np.sin(2 * np.pi * 150 * np.arange(rate) / rate)]
    rows = [(1, tone), (2, None), (3, []), (4, [0.0] * 500), (5, [None, float("nan"), float("inf")] * 100), (6, [float(v) for v in clicks(90, rate)])]
    sounds = spark.createDataFrame(rows, "id int, x array<double>").repartition(2)
    got = {r["id"]: r for r in T.tracked(sounds, "x", rate).collect()}
    assert np.allclose([v for v in got[1]["pitch_track"] if v], 150, rtol=0.01) and sum(v is None for v in got[1]["pitch_track"]) <= 4
    assert got[2]["pitch_track"] == got[3]["pitch_track"] == [] and set(got[4]["pitch_track"]) == set(got[5]["pitch_track"]) == {None}
    assert {got[i]["tempo"] for i in (2, 3, 4, 5)} == {120.0} and abs(got[6]["tempo"] / 90 - 1) < 0.01
    p = T.tracked(sounds, "x", rate).select("id", S.prosody(F.col("x"), rate, 100, 100, F.col("tempo"), F.col("pitch_track")).alias("p")).select("id", "p.*")
    out = {r["id"]: r for r in p.collect()}
    assert abs(out[1]["pitch_mean"] / 150 - 1) < 0.01 and None not in out[1]["pitch_contour"] and out[6]["tempo"] == got[6]["tempo"]
    assert (out[4]["pitch_mean"], out[4]["pitch_std"], out[4]["pitch_contour"]) == (150.0, 0.0, [150.0])
    assert T.tracked(sounds.limit(0), "x", rate).count() == 0
    with pytest.raises(ValueError):
        T.tracked(sounds.withColumn("tempo", F.lit(1)), "x", rate)


def test_speech_is_passed_on_in_bounded_batches(spark, monkeypatch):
    from lectern.operators import backends as B

    rows = [(i, None if i == 3 else "" if i == 4 else "word " * (i + 1), "v", i) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, t string, voice string, seed int").coalesce(1)
    sizes = lambda: sorted((r["id"], r["samples"] and len(r["samples"])) for r in B.synthesise(df, "t", "voice", "seed", B.tone(1000)).collect())
    whole = sizes()
    monkeypatch.setattr(B, "HELD_SAMPLES", 1000)
    assert sizes() == whole and [i for i, n in whole if n is None] == [3, 4]


def test_tempo_alone_and_clicks_by_period(spark):
    from lectern.plans import audio_queries as Q
    from lectern.plans.common import spread_out

    rate, seconds = 4000, 10
    rows = spark.createDataFrame([(k,) for k in (50, 77, 120, 149)], "beats int").coalesce(1)
    period = F.floor(60 * rate / F.col("beats")).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.lit(rate * seconds - 1)), lambda i: F.when(i % period < 40, F.sin((i % period) * 1.5) * (1 - (i % period) / 40)).otherwise(0.0))
    sounds = rows.select("beats", Q._clicks(F.col("beats"), rate, seconds).alias("x"), whole.alias("w"))
    assert sounds.where("x = w").count() == 4
    both = {r["beats"]: r["tempo"] for r in T.tracked(sounds.select("beats", "x"), "x", rate).collect()}
    assert {r["beats"]: r["tempo"] for r in T.timed(sounds.select("beats", "x"), "x", rate).collect()} == both
    assert T.tracked(sounds.select("beats", "x"), "x", rate, pitch_only=True).columns == ["beats", "x", "pitch_track"]
    with pytest.raises(ValueError):
        T.timed(rows.withColumn("tempo", F.lit(1)), "beats", rate)
    # a file of few bytes is one task, so the work is dealt out
    assert spread_out(rows, "beats").rdd.getNumPartitions() >= 8


def test_tempo_query_neither_tracks_pitch_nor_runs_in_one_task(spark):
    from lectern.plans.registry import queries

    plan = queries()["s22_tempo"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "pitch_track" not in plan and "REPARTITION_BY_NUM" in plan


def test_paths_of_many_sounds_go_on_together(monkeypatch):
    rate, rng = 4000, np.random.default_rng(5)
    tones = [np.sin(2 * np.pi * hz * np.arange(n) / rate) for hz, n in ((80, 9000), (310, 500), (150, 4000))]
    glide = np.sin(2 * np.pi * np.cumsum(np.linspace(90, 600, 8000)) / rate) + 0.3 * rng.normal(size=8000)
    sounds = [*tones, np.zeros(0), rng.normal(size=3000), np.zeros(700), glide, np.ones(1), tones[2]]
    together = T.pitch_tracks(sounds, rate)
    assert [len(t) for t in together] == [-(-len(x) // 63) for x in sounds]
    assert all(np.array_equal(t, T.pitch_track(x, rate), equal_nan=True) for t, x in zip(together, sounds, strict=True))
    assert T.pitch_tracks([], rate) == [] and [len(t) for t in T.pitch_tracks([np.zeros(0)] * 2, rate)] == [0, 0]
    # one step of the path for each frame of the longest sound, not of every sound
    calls = []
    logs = np.log
    monkeypatch.setattr(T.np, "log", lambda *a: calls.append(1) or logs(*a))
    T.pitch_tracks([tones[2]] * 20, rate)
    assert len(calls) < 2 * len(together[2])


def test_pitch_query_tracks_pitch_alone_in_many_tasks(spark):
    from lectern.plans.registry import queries

    plan = queries()["s22_pitch_track"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "tempo" not in plan and "REPARTITION_BY_NUM" in plan

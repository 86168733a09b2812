"""Quality reports on signals: all checks in order, with issues, warnings, score; and what is made of many reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio as S

# Limits of the checks.
LIMITS = {
    "text_similarity_fail": 0.6, "text_similarity_warn": 0.75, "duration_ratio_fail": 2.5, "duration_ratio_warn": 1.8, "duration_ratio_short": 0.3,
    "max_silence_s_fail": 3.0, "max_silence_s_warn": 1.5, "silence_ratio_fail": 0.4, "clipping_level": 0.999, "clipping_ratio_fail": 0.01,
    "clipping_ratio_warn": 0.001, "repetition_score_fail": 0.7, "repetition_score_warn": 0.5,
}


def _say(condition: Column, text: str, *values: Column) -> Column:
    return F.when(condition, F.format_string(text, *values))


def quality_report(rows: DataFrame, samples: str, rate: int, expected_seconds: str, similarity: str | None = None, limits: Mapping[str, float] | None = None, window_samples: int | None = None) -> DataFrame:
    """``rows`` with duration, metrics, issues, warnings, passed and score of each signal.

    Duration, silence, clipping, repetition and transcript are checked in this order.  A
    null or 0 expected duration, a signal shorter than one window and a null similarity skip
    their check.  ``window_samples``: samples in a window of the silence check, by default 50 ms.
    """
    window = window_samples or int(rate * 0.05)
    at = LIMITS | dict(limits or {})
    x = F.col(samples)
    no = F.lit(None).cast("double")
    a = rows.withColumns({
        "duration_s": F.size(x) / F.lit(float(rate)), "_silence": S.silence_report(x, rate, window / rate), "_measured": F.size(x) >= window,
        "clipping_ratio": S.clipping_ratio(x, at["clipping_level"]), "repetition_score": S.repetition_score(x, rate),
        "text_similarity": F.col(similarity).cast("double") if similarity else no,
    })
    expected = F.col(expected_seconds).cast("double")
    b = a.withColumns({
        "duration_ratio": F.when(expected > 0, F.col("duration_s") / expected), "silence_ratio": F.col("_silence.ratio"),
        "max_silence_s": F.col("_silence.longest_s"), "_silent": F.col("_silence.silent"),
    })
    ratio, gap, quiet, silent = F.col("duration_ratio"), F.col("max_silence_s"), F.col("silence_ratio"), F.col("_silent")
    clip, repeat, same, sound = F.col("clipping_ratio"), F.col("repetition_score"), F.col("text_similarity"), F.col("_measured") & ~F.col("_silent")
    seconds = F.col("duration_s")
    issues = [
        _say(ratio > at["duration_ratio_fail"], "RUNAWAY: audio is %.1fs but expected ~%.1fs (%.1fx longer)", seconds, expected, ratio),
        _say(F.col("_measured") & silent, "SILENT: entire audio is silence"),
        _say(sound & (gap > at["max_silence_s_fail"]), "SILENCE_GAP: %.1fs silence detected", gap),
        _say(sound & (quiet > at["silence_ratio_fail"]), "MOSTLY_SILENT: %.0f%% of audio is silence", quiet * 100),
        _say(clip > at["clipping_ratio_fail"], "CLIPPING: %.1f%% of samples clipped", clip * 100),
        _say(repeat > at["repetition_score_fail"], "REPETITION: strong repeating pattern detected (score=%.2f)", repeat),
        _say(same < at["text_similarity_fail"], "GIBBERISH: transcript matches the text to %.0f%%", same * 100),
    ]
    warnings = [
        _say((ratio > at["duration_ratio_warn"]) & (ratio <= at["duration_ratio_fail"]), "LONG: audio is %.1fs, expected ~%.1fs (%.1fx)", seconds, expected, ratio),
        _say(ratio < at["duration_ratio_short"], "SHORT: audio is %.1fs, expected ~%.1fs", seconds, expected),
        _say(sound & (gap > at["max_silence_s_warn"]) & (gap <= at["max_silence_s_fail"]), "SILENCE_GAP: %.1fs silence", gap),
        _say((clip > at["clipping_ratio_warn"]) & (clip <= at["clipping_ratio_fail"]), "MINOR_CLIPPING: %.2f%% of samples", clip * 100),
        _say((repeat > at["repetition_score_warn"]) & (repeat <= at["repetition_score_fail"]), "POSSIBLE_REPETITION: moderate pattern (score=%.2f)", repeat),
        _say((same >= at["text_similarity_fail"]) & (same < at["text_similarity_warn"]), "MISMATCH: transcript matches the text to %.0f%%", same * 100),
    ]
    c = b.withColumns({"issues": F.array_compact(F.array(*issues)), "warnings": F.array_compact(F.array(*warnings))})
    score = S.score(F.size("issues"), F.size("warnings"), F.coalesce(same, F.lit(1.0)), repeat)
    return c.withColumns({"passed": F.size("issues") == 0, "score": score}).drop("_silence", "_measured", "_silent")


def summary(reports: DataFrame) -> DataFrame:
    """passed, failed, warned (passed with warnings) and avg_score over reports (issues, warnings, score)."""
    ok = F.size("issues") == 0
    return reports.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.size("warnings") > 0)).alias("warned"), (F.coalesce(F.sum("score"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_score"))


def issue_histogram(reports: DataFrame) -> DataFrame:
    """issue, n: what stands before the colon of every issue and warning, most frequent first."""
    every = reports.select(F.explode(F.concat("issues", "warnings")).alias("i")).groupBy(F.split_part("i", F.lit(":"), F.lit(1)).alias("issue"))
    return every.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")

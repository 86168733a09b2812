"""Signal operators on array<double> columns; higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's body is computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty() -> Column:
    return F.array().cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def rms(x: Column) -> Column:
    """Root of the mean square; 0 for an empty signal."""
    return F.coalesce(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.nullif(F.size(x), F.lit(0))), F.lit(0.0))


def _scaled(x: Column, gain: Column) -> Column:
    return let(gain, lambda g: F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * g))))


def rms_normalise(x: Column, target: float) -> Column:
    return F.when(rms(x) < 1e-8, x).otherwise(_scaled(x, F.lit(float(target)) / rms(x)))


def loudness(x: Column) -> Column:
    return 20 * F.log10(rms(x) + 1e-10)


def loudness_normalise(x: Column, target: float = -16.0) -> Column:
    return F.when(rms(x) < 1e-10, x).otherwise(_scaled(x, F.pow(F.lit(10.0), (F.lit(float(target)) - loudness(x)) / 20)))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def peak_normalise(x: Column, target: float = 0.95) -> Column:
    return let(peak(x), lambda p: F.when(p == 0, x).otherwise(F.transform(x, lambda v: v * target / p)))


def silence(ms: Column | int, rate: int) -> Column:
    n = F.floor(F.lit(rate) * (ms if isinstance(ms, Column) else F.lit(ms)) / 1000).cast("int")
    return F.array_repeat(F.lit(0.0), n)


def _blend(a: Column, b: Column, n: int, fade) -> Column:
    if n <= 0:
        return F.concat(a, b)
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _blended(p["a"], p["b"], n, fade))


def _blended(a: Column, b: Column, n: int, fade) -> Column:
    step = F.lit(1.0 / max(1, n - 1))
    tail, head = F.slice(a, F.size(a) - n + 1, n), F.slice(b, 1, n)
    mixed = F.zip_with(F.zip_with(tail, head, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.sequence(F.lit(0), F.lit(n - 1)), lambda p, i: fade(p["x"], p["y"], i * step))
    rest = F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0)))
    front = F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))
    return F.when((F.size(a) < n) | (F.size(b) < n), F.concat(a, b)).otherwise(F.concat(front, mixed, rest))


def hann_crossfade(a: Column, b: Column, n: int) -> Column:
    """cos and sin squared over n samples; a plain join if either is shorter."""
    half = 1.5707963267948966
    return _blend(a, b, n, lambda x, y, t: x * F.pow(F.cos(t * half), F.lit(2)) + y * F.pow(F.sin(t * half), F.lit(2)))


def linear_crossfade(a: Column, b: Column, n: int) -> Column:
    return _blend(a, b, n, lambda x, y, t: x * (1 - t) + y * t)


def windows(x: Column, n: int) -> Column:
    """Whole windows of ``n`` samples."""
    count = F.floor(F.size(x) / n).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x, i * n + 1, F.lit(n)))).otherwise(F.array().cast("array<array<double>>"))


def energies(x: Column, n: int) -> Column:
    return F.transform(windows(x, n), rms)


def longest_run(flags: Column) -> Column:
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, f: Column) -> Column:
        now = F.when(f, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(flags, state, step, lambda s: s["most"])


def silence_report(x: Column, rate: int, window_s: float = 0.05) -> Column:
    """struct(ratio, longest_s, silent): windows 40 dB below the mean level of those with sound."""
    return let(energies(x, max(1, round(rate * window_s, 6).__floor__())), lambda e: let(F.coalesce(mean(F.filter(e, lambda v: v > 0)), F.lit(0.0)), lambda level: _silence(e, level, window_s)))


def _silence(e: Column, level: Column, window_s: float) -> Column:
    quiet = F.transform(e, lambda v: v < level * 0.01)
    known = F.size(e) > 0
    all_silent = known & (level == 0)
    return F.struct(
        F.when(all_silent, F.lit(1.0)).when(known, F.size(F.filter(quiet, lambda q: q)) / F.size(e)).otherwise(0.0).alias("ratio"),
        F.when(all_silent | ~known, F.lit(0.0)).otherwise(longest_run(quiet) * window_s).alias("longest_s"),
        all_silent.alias("silent"),
    )


def clipping_ratio(x: Column, limit: float = 0.999) -> Column:
    return F.coalesce(F.size(F.filter(x, lambda v: F.abs(v) > limit)) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))


def repetition_score(x: Column, rate: int) -> Column:
    """The strongest autocorrelation of one-second levels at lags 2 to 9; 0 if there are ten seconds or fewer."""
    spread = lambda e, m: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.nullif(F.size(e), F.lit(0)))
    scaled = lambda e, m: let(spread(e, m), lambda sd: F.when((F.size(e) > 10) & (sd >= 1e-8), F.transform(e, lambda v: (v - m) / (sd + 1e-10))))
    z = let(energies(x, rate), lambda e: let(mean(e), lambda m: scaled(e, m)))
    product = lambda z, k: F.aggregate(F.zip_with(F.slice(z, 1, F.size(z) - k), F.slice(z, k + 1, F.size(z) - k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    best = lambda z: F.array_max(F.transform(F.sequence(F.lit(2), F.lit(9)), lambda k: product(z, k)))
    return F.coalesce(let(z, lambda z: F.greatest(F.lit(0.0), best(z) / (product(z, F.lit(0)) + 1e-10))), F.lit(0.0))


def zero_crossings(x: Column) -> Column:
    """Share of neighbouring samples whose signs differ."""
    n = F.size(x)
    turns = F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (F.when(a >= 0, 1).otherwise(0) != F.when(b >= 0, 1).otherwise(0)))
    return F.coalesce(F.size(F.filter(turns, lambda t: t)) / F.nullif(n, F.lit(0)), F.lit(0.0))


def speaking_rate(x: Column) -> Column:
    return F.greatest(F.lit(1.5), F.least(F.lit(5.0), 2 + 20 * zero_crossings(x)))


def frame_levels(x: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Levels of frames centred on every ``hop`` samples; the signal is taken as 0 beyond its ends."""
    half = frame // 2
    at = lambda i: F.slice(x, F.greatest(i * hop - half, F.lit(0)) + 1, F.least(F.size(x), i * hop + half) - F.greatest(i * hop - half, F.lit(0)))
    power = lambda own: F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v) / frame)
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / hop).cast("int")), lambda i: power(at(i)))).otherwise(empty())


def spread(x: Column) -> Column:
    """Population standard deviation; null for an empty array."""
    return let(mean(x), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.nullif(F.size(x), F.lit(0))))


def pitch_contour(x: Column, rate: int, frame: int, low: float = 65.40639132514966, high: float = 2093.004522404789, voiced: float = 0.5) -> Column:
    """A pitch for each whole frame by its strongest autocorrelation between ``low`` and ``high`` Hz; null where unvoiced.

    The deterministic default of a pluggable tracker: a frame is voiced if that
    autocorrelation is at least ``voiced`` of its power.
    """
    first, last = max(1, int(rate / high)), max(1, min(int(rate / low), frame // 2))
    product = lambda w, k: F.aggregate(F.zip_with(F.slice(w, 1, F.lit(frame) - k), F.slice(w, k + 1, F.lit(frame) - k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def pitch(w: Column) -> Column:
        lags = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.struct(product(w, k).alias("r"), (-k).alias("k")))
        return let(F.array_max(lags), lambda best: F.when((best["r"] > 0) & (best["r"] >= voiced * product(w, F.lit(0))), F.lit(float(rate)) / (-best["k"])))

    return F.transform(windows(x, frame), pitch)


def pitch_mean(contour: Column) -> Column:
    """Mean of the voiced frames; 150 Hz without one."""
    return F.coalesce(mean(F.filter(contour, lambda v: v.isNotNull())), F.lit(150.0))


def prosody(x: Column, rate: int, frame: int, hop: int, tempo: Column | None = None, contour: Column | None = None, **pitch) -> Column:
    """struct of pitch (mean, deviation, contour with gaps at the mean), level (mean, deviation), tempo, speaking rate, duration.

    Without a voiced frame the pitch is 150 Hz throughout; without a ``tempo`` it is 120.  ``tempo``
    and ``contour`` may come from ``tracking.tracked``; without a contour it is that of ``pitch_contour``,
    whose low, high and voiced are ``pitch``.
    """
    def described(contour: Column, levels: Column) -> Column:
        own = F.filter(contour, lambda v: v.isNotNull())
        center = pitch_mean(contour)
        filled = let(center, lambda c: F.when(F.size(own) > 0, F.transform(contour, lambda v: F.coalesce(v, c))).otherwise(F.array(F.lit(150.0))))
        return F.struct(
            center.alias("pitch_mean"), F.coalesce(spread(own), F.lit(0.0)).alias("pitch_std"), filled.alias("pitch_contour"), F.coalesce(mean(levels), F.lit(0.0)).alias("energy_mean"),
            F.coalesce(spread(levels), F.lit(0.0)).alias("energy_std"), (tempo if tempo is not None else F.lit(120.0)).alias("tempo"), speaking_rate(x).alias("speaking_rate"), (F.size(x) / F.lit(float(rate))).alias("duration"),
        )

    return let(contour if contour is not None else pitch_contour(x, rate, frame, **pitch), lambda c: let(frame_levels(x, frame, hop), lambda e: described(c, e)))


def duration_issue(actual: Column, expected: Column) -> Column:
    ratio = actual / F.when(expected > 0, expected)
    return F.when(ratio > 2.5, "RUNAWAY").when(ratio > 1.8, "LONG").when(ratio < 0.3, "SHORT")


def score(issues: Column, warnings: Column, similarity: Column, repetition: Column) -> Column:
    """100 less 20 an issue, 5 a warning, 40 for lost words and 30 for repetition; 0 to 100."""
    s = 100 - 20 * issues - 5 * warnings - F.when(similarity < 1, (1 - similarity) * 40).otherwise(0) - F.when(repetition > 0.3, repetition * 30).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s.cast("double")))


def token_cap(seconds: Column) -> Column:
    return F.greatest(F.lit(72), F.least(F.lit(180), F.floor(seconds * 12 * 1.3).cast("int")))


def or_silence(x: Column, words: Column, rate: int = 24000) -> Column:
    """Silence as long as the words would take, where there is no signal."""
    n = F.floor(F.lit(rate) * F.greatest(F.lit(0.5), words * 0.15)).cast("int")
    return F.when(x.isNull() | (F.size(x) == 0), F.array_repeat(F.lit(0.0), n)).otherwise(x)


def splice(chunks: Column, rate: int, crossfade_ms: int = 100, sentence_ms: int = 200, paragraph_ms: int = 500, target: float = -16.0) -> Column:
    """One signal from an array of struct(samples, is_end, fade_ms), in order.

    Empty chunks are left out before flags and fades are read by position.  Each chunk is made
    equally loud; silence follows the signal so far, then the next chunk fades in.  A fade is one
    of 0, the default, or three times the default.
    """
    full = F.transform(F.filter(chunks, lambda c: F.size(c["samples"]) > 0), lambda c: loudness_normalise(c["samples"], target))
    flags = F.transform(chunks, lambda c: F.struct(c["is_end"].alias("is_end"), c["fade_ms"].alias("fade_ms")))

    def joined(full: Column, flags: Column) -> Column:
        at = F.when(F.size(full) > 1, F.sequence(F.lit(1), F.size(full) - 1)).otherwise(F.array().cast("array<int>"))
        n, wide = int(rate * crossfade_ms / 1000), int(rate * 3 * crossfade_ms / 1000)

        def join(out: Column, i: Column) -> Column:
            before = F.get(flags, i - 1)
            padded = F.concat(out, F.when(F.coalesce(before["is_end"], F.lit(False)), silence(paragraph_ms, rate)).otherwise(silence(sentence_ms, rate)))
            nxt = F.get(full, i)
            return F.when(before["fade_ms"] == 0, F.concat(padded, nxt)).when(before["fade_ms"] == 3 * crossfade_ms, hann_crossfade(padded, nxt, wide)).otherwise(hann_crossfade(padded, nxt, n))

        return F.when(F.size(full) == 0, empty()).otherwise(F.aggregate(at, F.get(full, F.lit(0)), join))

    return let(full, lambda x: let(flags, lambda f: joined(x, f)))
